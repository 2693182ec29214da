"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rubrica.llm import exact_dedup, language, licenses, line_dedup, merkle, packing, pieces, quality, secrets, simhash
from rubrica.llm.common import held_out, read_documents

#: The vocabularies are found through their package; another path can be given to the operators.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_documents(spark, sf_dir), width=3, radius=2, seed=42)
    return found.select("doc_id", F.lpad(F.lower(F.hex(F.col("fp")[0])), 16, "0").alias("fingerprint"), "component_id")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    made = packing.pieces(docs, TOKENIZER, end_id=2)
    digests = made.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.pack(digests, packing.groups_for(docs))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.with_score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _joined_spans(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, secrets.KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x.rank), x.start.cast("string"), x.stop.cast("string"))), ",")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = secrets.scan_paths(read_documents(spark, sf_dir))
    counts = [F.size(F.filter("spans", lambda x, k=k: x.rank == k)).cast("bigint").alias(f"n_{name}") for k, name in enumerate(secrets.BASE)]
    base = F.filter("spans", lambda x: x.rank < len(secrets.BASE))
    return found.select("doc_id", *counts, F.sha2(_joined_spans(base), 256).alias("base_sha256"), _joined_spans(F.col("spans")).alias("spans"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(read_documents(spark, sf_dir), threshold=2, least_chars=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    made = pieces.encode(docs, PIECES, seed=42, dropout=0.1, decoded=True)
    return made.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read_documents(spark, sf_dir))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = merkle.compare_edits(read_documents(spark, sf_dir))
    return made.select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        merkle.as_text(F.col("tree")).alias("fingerprint"), merkle.as_text(F.col("edited_tree")).alias("edited_fingerprint"),
        merkle.likeness(F.col("tree"), F.col("edited_tree")).alias("near_edited"), merkle.likeness(F.col("tree"), F.col("next_tree")).alias("near_next"),
        F.array_join(merkle.changed_paragraphs(F.col("tree"), F.col("edited_tree")).cast("array<string>"), ",").alias("changed"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    found = licenses.scan(docs, licenses.train(docs))
    sure = F.filter("findings", lambda x: x.confirmed)
    return found.select(
        "doc_id", F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x.family))), ",").alias("licenses"), F.size(sure).cast("bigint").alias("n_confirmed"), F.size("findings").cast("bigint").alias("n_predicted"),
        F.array_join(F.transform("findings", lambda x: F.concat_ws(":", x.paragraph.cast("string"), x.part.cast("string"), x.family, F.round(x.probability, 4).cast("string"))), ",").alias("paragraphs"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    found = language.predict(docs, language.train(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_packing": op2_packing,
    "op3_quality": op3_quality,
    "op4_secrets": op4_secrets,
    "op5_line_dedup": op5_line_dedup,
    "op6_pieces": op6_pieces,
    "op7_exact": op7_exact,
    "op8_fingerprints": op8_fingerprints,
    "op9_licenses": op9_licenses,
    "op10_language": op10_language,
}

ORACLE_SQL: dict[str, str] = {
    "op7_exact": """
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS n FROM documents),
        g AS (SELECT n, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY n)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM t JOIN g USING (n)""",
    "op5_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
        keyed AS (
            SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
        owners AS (SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
        judged AS (SELECT keyed.*, owner IS NOT NULL AND owner <> doc_id AS dropped FROM keyed LEFT JOIN owners USING (k))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
        FROM judged GROUP BY doc_id""",
}
