"""Exact duplicates by progressive refinement: length, then prefix, then the whole text.

DataFrame functions only.

1. One aggregate counts rows per (length, hash of the prefix). A pair can only be crowded if its
   length is, so length and prefix are refined in one shuffle of counts.
2. The crowded pairs are folded into at most ``filter_size`` hash buckets. That table is bounded
   by its parameter, whatever the input, and so may be broadcast. Rows outside crowded buckets
   have no copy; their whole text is never hashed. No text is shuffled.
3. Surviving rows are grouped by the hash of the whole text, partial counts first, and joined
   back on it; a large group is split by the adaptive join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.llm.common import flat, pick
from marketlake.session import staged


def duplicate_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, prefix: int = 256,
    filter_size: int = 1 << 20, **carry: Column,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept and the ``carry`` columns.

    ``carry`` columns are expressions over ``doc_id`` and ``text`` (white space folded). Texts are
    equal when identical after folding white space; null counts as empty. The smallest id of a
    group stays; a group whose ids are all null keeps null. Rows that repeat an id within a
    group are one document and share its decision. An empty table gives no rows.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("text", flat(F.col("text")))
    rows = rows.select(
        "doc_id", "text", F.octet_length("text").alias("length"), F.xxhash64(F.substring("text", 1, prefix)).alias("prefix")
    )
    slot = F.pmod(F.xxhash64("length", "prefix"), F.lit(filter_size))
    crowded = (
        rows.groupBy("length", "prefix").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        .select(slot.alias("slot")).distinct()
    )
    marked = rows.withColumn("slot", slot).join(F.broadcast(crowded.withColumn("crowded", F.lit(True))), "slot", "left")
    # rows without a copy get a key of their own: they spread, and never meet a hash
    alone = F.concat_ws("/", F.lit("alone"), "length", "prefix", "doc_id")
    keyed = marked.select(
        "doc_id", F.when(F.col("crowded"), F.sha2("text", 256)).otherwise(alone).alias("key"), "crowded",
        *[c.alias(n) for n, c in carry.items()],
    )
    groups = (
        keyed.filter("crowded").groupBy("key").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1").withColumnRenamed("key", "group_key")
    )
    found = keyed.join(groups, F.col("key") == F.col("group_key"), "left")
    keep = F.when(F.col("group_key").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), *carry,
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Decisions are matched by id and whole text, so an id that occurs with two texts is judged text
    by text. Of rows that repeat an id with the same text one stays. Only the decisions on rows
    with a copy are written and joined.
    """
    judged = duplicate_groups(docs, id_col, text_col, __text=F.sha2("text", 256)).filter("group_size > 1")
    judged = staged(
        judged.groupBy("doc_id", "__text").agg(F.min("kept").alias("__kept"), F.count(F.lit(1)).alias("__n")), "copies"
    )
    text = F.sha2(flat(docs[f"`{text_col}`"]), 256)

    def same(d: DataFrame) -> Column:
        return docs[f"`{id_col}`"].eqNullSafe(d["doc_id"]) & (text == d["__text"])

    once = docs.join(dropped := judged.filter("not __kept or __n > 1"), same(dropped), "left_anti")
    again = docs.join(twice := judged.filter("__kept and __n > 1"), same(twice), "left_semi")
    again = again.withColumn("__same", flat(again[f"`{text_col}`"])).dropDuplicates([id_col, "__same"]).drop("__same")
    return once.unionByName(again)
