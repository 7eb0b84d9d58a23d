"""Exact deduplication by content-defined chunk recipes (DataFrame functions only).

A text, normalised by deleting white space (``[\\x20\\x09-\\x0D]``), is cut where
its own content says so: a chunk ends after the first character of
``CUT_CLASS`` past ``MIN_CHUNK`` characters, or at ``MAX_CHUNK``.  A document
then is a *recipe*: the ordered list of its chunks' identifiers.  Only
recipes move between tasks (8 bytes for some hundreds of characters); the
texts themselves are read once and never shuffled.

Chunks are deduplicated to identifiers: the 64-bit fingerprint, verified by the
chunk's SHA-256.  Should two different chunks share a fingerprint, every
document with one of them is compared by the list of SHA-256 digests instead.

Defined cases: a null text counts as empty; all empty texts are one group; rows
that repeat (doc_id and text alike) each get a row and of them all that tie with
the kept id are ``kept``; a null doc_id loses ties; a very long text is a long
recipe; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, sized_join, skew_safe_lookup

MIN_CHUNK = 192
MAX_CHUNK = 2048
#: Characters that end a chunk: marks of any script, and about one in ten of the letters of common ones.
CUT_CLASS = "[.,;:!?cfgmpuwy\\p{P}бгзыβγδבדدعفकत\u0e01\u0e19の\u306b\u30b9\u4e00-\u4fff\uac00-\uaeff]"
WHITE = " \t\n\x0b\f\r"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def chunks(norm: Column) -> Column:
    """Content-defined chunks of a text; they tile it."""
    pattern = f"(?s).{{{MIN_CHUNK},{MAX_CHUNK - 1}}}?{CUT_CLASS}|.{{1,{MAX_CHUNK}}}"
    return F.regexp_extract_all(norm, F.lit(pattern), F.lit(0))


def recipes(docs: DataFrame) -> DataFrame:
    """doc_id, n_points, text_sha256, recipe (list of fingerprint and digest)."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_points"),
        normalised(F.col("text")).alias("norm"),
    ).select(
        "doc_id",
        "n_points",
        F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
        F.transform(
            chunks(F.col("norm")),
            lambda c: F.struct(F.xxhash64(c).alias("fp"), F.unhex(F.sha2(c.cast("binary"), 256)).alias("sha")),
        ).alias("recipe"),
    )


def chunk_table(made: DataFrame) -> DataFrame:
    """Each distinct chunk once: fingerprint, digest and how many places hold it."""
    return made.select(F.explode("recipe").alias("c")).groupBy("c.fp", "c.sha").agg(F.count("*").alias("n_places"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256; one row for each row of ``docs``."""
    made = cut(recipes(docs))
    clash = chunk_table(made).groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1").select("fp")
    marked = (
        made.select("text_sha256", F.explode("recipe.fp").alias("fp"))
        .join(clash, "fp", "left_semi")
        .select("text_sha256")
        .distinct()
        .withColumn("clash", F.lit(True))
    )
    # Ordered identifier lists; the digests stand in where a fingerprint is shared by two chunks.
    lists = sized_join(made, cut(marked), "text_sha256", "left").select(
        "doc_id",
        "n_points",
        "text_sha256",
        F.col("recipe.fp").alias("ids"),
        F.when(F.col("clash"), F.col("recipe.sha")).alias("digests"),
    )
    groups = (
        lists.groupBy("ids", "digests")
        .agg(
            F.first("text_sha256").alias("text_sha256"),  # equal lists: equal normalised texts
            F.count("*").alias("group_size"),
            F.min(F.struct((-F.col("n_points")).alias("n"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"))).alias("best"),
        )
        .select("text_sha256", "group_size", F.col("best.id").alias("keep_id"), (-F.col("best.n")).alias("_keep_points"))
    )
    out = skew_safe_lookup(made.select("doc_id", "n_points", "text_sha256"), groups, "text_sha256", "group_size")
    return out.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("_keep_points"))).alias("kept"),
        "text_sha256",
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256
FROM d
WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
