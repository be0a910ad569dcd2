"""Exact duplicates by progressive refinement: length, then prefix, then all of the text.

Each level looks only at rows that the level before could not tell apart. What
a level leaves is a bit map of fixed size, so no text is shuffled to find out
which rows are left, and the full text is hashed for those alone. Groups are
aggregated before they are shuffled: one group may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .rows import MAP_BITS, ascii_lower, mark_members

#: Characters that the second level compares.
PREFIX_CHARS = 256


def refine(docs: DataFrame, text: str = "text", bits: int = MAP_BITS) -> DataFrame:
    """Rows as (_row, _text, _open): `_open` is false where length and prefix already prove a text unique.

    `_row` holds all columns of `docs`; a null text counts as empty.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    length = F.octet_length("_text")
    lengths = rows.groupBy(length.alias("n")).count().where("count > 1")
    level1 = mark_members(rows, length, lengths, F.col("n"), "_open", bits)
    head: Column = F.xxhash64(length, ascii_lower(F.left("_text", F.lit(PREFIX_CHARS))))
    heads = level1.where("_open").groupBy(head.alias("k")).count().where("count > 1")
    level2 = mark_members(level1.withColumnRenamed("_open", "_long"), head, heads, F.col("k"), "_open", bits)
    return level2.select("_row", "_text", (F.col("_long") & F.col("_open")).alias("_open"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", hash_all: bool = False, bits: int = MAP_BITS) -> DataFrame:
    """Who stays: (doc_id, keep_id, group_size, kept, text_sha256), a row per document.

    Texts are equal when they are after lower-casing A-Z; null counts as
    empty. The largest id of a group stays, a null id being the smallest.
    Rows that repeat both id and text are one document and give one row, and
    all count in `group_size`. `text_sha256` of texts found unique by length
    or prefix is null unless `hash_all`. An empty table gives no rows.
    """
    rows = refine(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), "text", bits)
    digest = F.sha2(ascii_lower(F.col("_text")), 256)
    full = rows.where("_open").select(F.col("_row.id").alias("id"), digest.alias("h"))
    members = full.groupBy("h", "id").agg(F.count(F.lit(1)).alias("n"))
    # A key of its own lets Spark split the member side of the join where a group is large.
    groups = members.groupBy("h").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size")).withColumn("k", F.concat("h", F.lit(""))).drop("h")
    shared = members.join(groups, F.col("h") == F.col("k"))
    shared = shared.select("id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("h").alias("text_sha256"))
    alone = rows.where("NOT _open").select(
        F.col("_row.id").alias("id"),
        F.col("_row.id").alias("keep_id"),
        F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"),
        (digest if hash_all else F.lit(None).cast("string")).alias("text_sha256"),
    )
    return shared.unionByName(alone).withColumnRenamed("id", "doc_id")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", bits: int = MAP_BITS) -> DataFrame:
    """`docs` without exact copies: of each group the row with the largest id, all its columns unchanged.

    Equality as in `exact_groups`. Of rows with one id, the larger text stays,
    then the larger hash of the row.
    """
    rows = refine(docs, text, bits)
    one = rows.where("_open").withColumn("h", F.sha2(ascii_lower(F.col("_text")), 256))
    ident = F.col(f"_row.`{id_col}`")
    best = one.groupBy("h").agg(F.max_by("_row", F.struct(ident.isNotNull(), ident, F.col("_text"), F.xxhash64("_row"))).alias("_row"))
    return rows.where("NOT _open").select("_row").unionByName(best.select("_row")).select("_row.*")


SQL = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}', '{"abcdefghijklmnopqrstuvwxyz"}') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)
"""
