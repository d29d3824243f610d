"""Queries over the documents, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..tables import table
from . import bpe, mixing, spans


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document; a document delivered twice comes out once."""
    documents = table(spark, folder, "documents").select("doc_id", "text").filter("doc_id IS NOT NULL")
    return bpe.encode(documents.dropDuplicates(["doc_id"]))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_shares(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return spans.shared_spans(table(spark, folder, "documents"))


def p10_report(spark: SparkSession, folder: str) -> DataFrame:
    return spans.shared_report(table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p8_ids, p9_mix, p9_shares, p10_found, p10_report)}


_SPANS = """
WITH d AS (SELECT doc_id, any_value(text) AS text FROM documents WHERE doc_id IS NOT NULL AND length(text) >= 200 GROUP BY doc_id),
w AS (SELECT doc_id, i, md5_number(substr(text, i + 1, 200)) AS h FROM d, LATERAL (SELECT unnest(range(length(text) - 199)) AS i)),
r AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)),
s AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS c FROM w SEMI JOIN r USING (h)),
k AS (SELECT doc_id, i, sum(c) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM s),
spans AS (SELECT doc_id, min(i)::INTEGER AS span_start, (max(i) + 200)::INTEGER AS span_end FROM k GROUP BY doc_id, k)
"""


def oracle_sql() -> dict[str, str]:
    """Byte-level merges and seeded draws are beyond SQL; the tests compare them
    with public libraries and invariants."""
    return {
        "p10_found": _SPANS + "SELECT * FROM spans",
        "p10_report": _SPANS + "SELECT doc_id, count(*) AS n_spans, sum(span_end - span_start)::BIGINT AS shared_chars FROM spans GROUP BY doc_id",
    }
