"""Exact deduplication that splits heavy hitters from the rest.

A Misra-Gries pass over the digests (Spark's ``freqItems``) yields at most
``ceil(1 / support)`` candidates, which hold every digest above ``support`` of all rows.
An exact count verifies them; the verified winners, bounded by the same number, are
broadcast, so rows of frequent digests never shuffle beyond map-side partial
aggregates. All other digests use an ordinary shuffled aggregate and join. The path is
DataFrame functions only.

Defined cases: null text counts as empty text; rows with equal text form one group
whatever their other columns; of rows that tie on ``id_col`` every one carries the same
decision; a null id is kept only where its group has no other; an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.plans.workspace import Workspace

#: Share of all rows above which a digest is broadcast; at most 1 / SUPPORT digests are.
SUPPORT = 0.002


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, digest)``: 32 raw bytes of SHA-256 of the whole text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"))


def heavy_hitters(rows: DataFrame, support: float = SUPPORT) -> DataFrame:
    """``(digest, keep_id, group_size)`` of the digests verified to exceed ``support``."""
    # Counted as text: the frequent-item counters tell byte arrays apart by identity.
    found = rows.select(F.hex("digest").alias("d")).stat.freqItems(["d"], support)
    candidates = F.broadcast(found.select(F.explode("d_freqItems").alias("d")).select(F.unhex("d").alias("digest")))
    least = rows.count() * support
    return (
        rows.join(candidates, "digest", "left_semi")
        .groupBy("digest")
        .agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
        .where(F.col("group_size") > least)
    )


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT, workspace: Workspace | None = None
) -> DataFrame:
    """One row per input row: ``id, digest, keep_id, group_size, kept``.

    Of rows with equal text the one with the largest id stays.
    """
    ws = workspace or Workspace(docs.sparkSession)
    rows = ws.save(digests(docs, id_col, text_col), "digests")
    winners = F.broadcast(ws.save(heavy_hitters(rows, support), "winners"))
    hot = rows.join(winners, "digest")
    rest = rows.join(winners, "digest", "left_anti")
    groups = rest.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    cold = rest.join(groups, "digest")
    kept = F.col("id").eqNullSafe(F.col("keep_id"))
    return hot.unionByName(cold).select("id", "digest", "keep_id", "group_size", kept.alias("kept"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision for every row of ``documents``."""
    out = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def kept_documents(docs: DataFrame, workspace: Workspace | None = None) -> DataFrame:
    """The rows of ``docs`` that exact deduplication keeps, with all their columns.

    Rows that repeat both id and text tie, so they all stay.
    """
    gone = exact_dedup(docs, workspace=workspace).where("not kept").select(F.col("id").alias("gone"), "digest").distinct()
    digest = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    # Whole rows travel in a struct, so no name of theirs can clash.
    rows = docs.select(F.col("doc_id").alias("own"), digest.alias("own_digest"), F.struct("*").alias("row"))
    out = rows.join(gone, F.col("own").eqNullSafe(F.col("gone")) & (F.col("own_digest") == F.col("digest")), "left_anti")
    return out.select("row.*")
