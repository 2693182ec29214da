"""Secret scans over a ledger of content-addressed blobs.

Every version of a text is addressed by its SHA-256. A blob is scanned once for each version of the
rules, however many paths (documents) hold it or held it; findings are kept in the ledger and joined
back to all paths. A later run with the same ledger scans only new blobs, or all blobs for new rules.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rubrica.llm.common import cut

#: Name, pattern, least length of the named group, and what a text must hold (lower-cased or not)
#: for the pattern to match at all. Matches are leftmost and do not overlap; those that are too
#: short are dropped afterwards, so they still take up their text. The first three are the base.
RULES = (
    ("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, ("password", "passwd", "secret", "token", "apikey", "api_key"), True),
    ("access", r"AKIA[A-Z0-9]+", 0, 16, ("AKIA",), False),
    ("hex", r"[0-9a-f]{32,}", 0, 32, (), False),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]*PRIVATE KEY-----", 0, 1, ("PRIVATE KEY-----",), False),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), False),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1, ("xox",), False),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 1, ("AIza",), False),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 1, ("eyJ",), False),
)
RULES_VERSION = "3"
KINDS = tuple(r[0] for r in RULES)
BASE = KINDS[:3]
SPANS = "array<struct<start:bigint,rank:int,stop:bigint>>"


def find_spans(text: str, compiled=None) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of all findings, by start and then kind, in code points."""
    found, lower = [], text.lower() if text.isascii() else None
    for rank, (_, pattern, group, least, needs, fold) in enumerate(RULES):
        if needs:
            # lower() may change lengths outside ASCII, but never hides an ASCII word
            where = text if not fold else lower if lower is not None else text.lower()
            if not any(n in where for n in needs):
                continue
        for m in (compiled[rank] if compiled else re.compile(pattern)).finditer(text):
            if len(m.group(group)) >= least:
                found.append((m.start(), rank, m.end()))
    return sorted(found)


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    compiled = [re.compile(r[1]) for r in RULES]
    for batch in batches:
        yield pd.DataFrame({"blob": batch["blob"], "rules": RULES_VERSION, "spans": [[{"start": a, "rank": k, "stop": b} for a, k, b in find_spans(t, compiled)] for t in batch["text"]]})


def address(docs: DataFrame, text_col: str = "text"):
    return F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))


def _unseen(docs: DataFrame, ledger: DataFrame | None, text_col: str) -> DataFrame:
    blobs = docs.select(address(docs, text_col).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is not None:
        blobs = blobs.join(ledger.where(F.col("rules") == RULES_VERSION).select("blob"), "blob", "left_anti")
    return blobs


def scan_unseen(docs: DataFrame, ledger: DataFrame | None = None, *, text_col: str = "text") -> DataFrame:
    """(blob, rules, spans) of the blobs of docs that the ledger lacks for these rules.

    Copies are merged before the shuffle, so each blob travels and is scanned once. Null texts are the
    blob of the empty text. An empty table gives an empty result.
    """
    return _unseen(docs, ledger, text_col).mapInPandas(_scan, f"blob binary, rules string, spans {SPANS}")


class Ledger:
    """A ledger in a folder, which outlives a run: every blob that was ever scanned, by rules.

    History is scanned by handing over every version of every path: a version that another path or an
    earlier run held already is not scanned again, and its findings are joined to all that hold it.
    Findings are appended before they are used; a run that is repeated finds them there. Two runs at a
    time may both add a blob, which reading merges.
    """

    def __init__(self, folder: str):
        self.folder = folder

    def read(self, spark: SparkSession) -> DataFrame | None:
        """(blob, rules, spans), a row for each pair of blob and rules; None before the first scan."""
        try:
            known = spark.read.parquet(self.folder)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise
        return known.groupBy("blob", "rules").agg(F.first("spans").alias("spans"))

    def add(self, docs: DataFrame, *, text_col: str = "text") -> DataFrame:
        """Scans what is unseen in docs, appends it, and gives the whole ledger."""
        scan_unseen(docs, self.read(docs.sparkSession), text_col=text_col).write.mode("append").parquet(self.folder)
        return self.read(docs.sparkSession)

    def scan(self, versions: DataFrame, *, path_cols: tuple[str, ...] = ("path", "version"), text_col: str = "text") -> DataFrame:
        """(path columns, blob, spans) for every row of versions: the findings of all historical versions."""
        return _joined_back(versions, self.add(versions, text_col=text_col), path_cols, text_col)


def _joined_back(docs: DataFrame, known: DataFrame, names: tuple[str, ...], text_col: str) -> DataFrame:
    """The findings of these rules, at every row that holds a blob; an empty list where there is none."""
    hits = known.where((F.col("rules") == RULES_VERSION) & (F.size("spans") > 0)).select(F.col("blob").alias("b"), "spans")
    paths = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("at"), address(docs, text_col).alias("b"))
    found = paths.join(hits, "b", "left")
    return found.select(*[F.col(f"at.`{c}`").alias(c) for c in names], F.col("b").alias("blob"), F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def scan_paths(docs: DataFrame, ledger: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Findings of every row of docs, and the ledger with what this run adds.

    The first table has (id, blob, spans) for each row, an empty list where nothing was found; null
    and empty texts find nothing. Rows that repeat each keep a row; null ids too. The second has
    (blob, rules, spans) and is to be passed as `ledger` next time, or see Ledger. Only the two named
    columns are read; the id may not be called blob or spans. An empty table gives empty ones.
    """
    added = cut(scan_unseen(docs, ledger, text_col=text_col))
    known = added if ledger is None else ledger.select("blob", "rules", "spans").unionByName(added)
    return _joined_back(docs, known, (id_col,), text_col), known


def redacted(docs: DataFrame, ledger: DataFrame | None = None, *, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with every finding in the text replaced by the mark; all rows and columns stay, of any names.

    Findings that overlap or touch become one mark. Null texts stay null. An empty table gives an
    empty one.
    """
    added = cut(scan_unseen(docs, ledger, text_col=text_col))
    known = added if ledger is None else ledger.select("blob", "rules", "spans").unionByName(added)
    hits = known.where((F.col("rules") == RULES_VERSION) & (F.size("spans") > 0)).select("blob", "spans")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), address(docs, text_col).alias("blob"))
    joined = rows.join(hits, "blob", "left")
    # what is left stands between the farthest end so far and the next start
    parts = F.expr(f"""aggregate(spans, named_struct('at', 0L, 'out', ''),
        (s, x) -> named_struct('at', greatest(s.at, x.stop),
            'out', CASE WHEN x.start > s.at OR s.at = 0 THEN concat(s.out, substr(whole.`{text_col}`, int(s.at + 1), int(x.start - s.at)), '{mark}') ELSE s.out END),
        s -> concat(s.out, substr(whole.`{text_col}`, int(s.at + 1))))""")
    new = F.when(F.col("spans").isNull(), F.col(f"whole.`{text_col}`")).otherwise(parts)
    return joined.select(*[(new if c == text_col else F.col(f"whole.`{c}`")).alias(c) for c in docs.columns])
