"""Tables that later steps start from anew."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """The same rows, computed once and reread from the shared folder of spark.checkpoint.dir, so that
    plans stay short and a lost executor costs nothing. A local folder serves only where none is set and
    all runs in one process."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="rubrica-"))
    return df.checkpoint(eager=True)
