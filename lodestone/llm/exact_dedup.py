"""Exact duplicates: 128-bit content hash, bytes compared inside each hash group.

The group-by key is the MD5 of the text followed by the text itself. Rows meet by hash,
and inside a hash group the engine's hash table compares the bytes of the texts, so two
texts with one MD5 stay apart. Counts and the id that stays are partial aggregates: a
text that a third of all rows share reaches its group as one row for each map task.
Every row then gets the answer of its group by a join on (MD5, SHA-256); only groups of
two or more rows take part in it, and adaptive execution can split its hot keys.

Null text counts as empty text. Null ids never win over other ids; a group with null ids
only keeps null. Rows that repeat an id and its text are copies of one document: all of
them carry the same answer (``exact_dedup``), and ``exact_dedup_rows`` leaves one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(text: Column) -> Column:
    """128 bits of the bytes of a text."""
    return F.unhex(F.md5(text))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", hash128=content_hash) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    ``keep``: "min" or "max", which id of a group stays. An empty table gives an empty result.
    """
    best = {"min": F.min, "max": F.max}[keep]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    groups = (
        rows.groupBy(hash128(F.col("_text")).alias("_h"), "_text")
        .agg(F.count(F.lit(1)).alias("_size"), best("_id").alias("_keep"))
        .where("_size > 1")
        .select(F.col("_h").alias("_gh"), F.unhex(F.sha2("_text", 256)).alias("_gs"), "_size", "_keep")
    )
    keyed = rows.select("_id", hash128(F.col("_text")).alias("_h"), F.unhex(F.sha2("_text", 256)).alias("_s"))
    keep_id = F.when(F.col("_size").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    return keyed.join(groups, (F.col("_h") == F.col("_gh")) & (F.col("_s") == F.col("_gs")), "left").select(
        F.col("_id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("_s")).alias("text_sha256"),
    )


def exact_dedup_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", hash128=content_hash) -> DataFrame:
    """The rows of ``docs`` that stay, one for each distinct text, with all their columns.

    One aggregation, no join: the row that stays travels through it as a struct, ordered by id
    and then by its other columns.
    """
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    best = {"min": F.min, "max": F.max}[keep]
    no_id = F.col(id_col).isNull() if keep == "min" else F.col(id_col).isNotNull()
    row = F.struct(no_id.alias("n"), F.col(id_col).alias("i"), F.col(text_col).isNull().alias("t"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)))
    kept = (
        docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("_text"), row.alias("_row"))
        .groupBy(hash128(F.col("_text")).alias("_h"), "_text")
        .agg(best("_row").alias("_row"))
    )
    value = {id_col: F.col("_row.i"), text_col: F.when(~F.col("_row.t"), F.col("_text"))} | {c: F.col(f"_row.c{k}") for k, c in enumerate(others)}
    return kept.select(*(value[c].alias(c) for c in docs.columns))
