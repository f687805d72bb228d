"""Exact deduplication with a Bloom filter of hashes that occur more than once.

Texts are equal when they are identical after each run of white space is made one space.

Pass one reduces every row to the numbers of two filter bits.  Only those numbers move, combined
before their shuffle; bits hit by more than one row make the filter.  Pass two looks up each row's
two bits: rows with both bits set are possibly repeated, and only their ids and hashes are shuffled
and grouped.  All other rows are certainly single and pass straight through.  A false alarm of the
filter costs a shuffled row and never changes the result, since rows are grouped by the full hash.

The filter has 16 bits for each row, at most ``max_bits`` (256 MB), and is broadcast in blocks of
4 KB.  Beyond 134 million rows at that limit the share of false alarms rises slowly; the result
stays the same.

Defined results: a NULL text counts as empty; NULL ids count as rows, but are the ``keep_id`` only
of groups without any id; of rows that are the same in id and text exactly one is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmine.llm.bloom import MAX_BITS, filter_blocks, half_size, key_bits, look_up, split_by_keys
from trailmine.llm.common import SPACES, packed, settle


def text_hash(text: Column) -> Column:
    """SHA-256 of the normalised text, in hexadecimal digits."""
    one_space = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACES, " ")
    return F.sha2(one_space.cast("binary"), 256)


def maybe_repeated(rows: DataFrame, key: str, n_rows: int, max_bits: int = MAX_BITS) -> DataFrame:
    """Adds ``maybe``: false only for keys that certainly occur once."""
    half = half_size(n_rows, max_bits)
    bits = rows.select(F.explode(F.array(*key_bits(F.col(key), half))).alias("bit"))
    repeated = bits.groupBy("bit").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return look_up(rows, F.col(key), filter_blocks(repeated), half, "maybe")


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS
) -> DataFrame:
    """One row for each row of ``docs``: id, ``keep_id, group_size, kept, text_sha256``."""
    hashed = docs.select(
        F.col(id_col).alias("_id"), text_hash(F.col(text_col)).alias("text_sha256")
    )
    rows = settle(hashed, "text-hashes")
    marked = maybe_repeated(rows, "text_sha256", rows.count(), max_bits)
    single = marked.where("NOT maybe").selectExpr(
        "_id", "_id AS keep_id", "1L AS group_size", "true AS kept", "text_sha256"
    )
    # Rows that are alike in id and text are counted, and spread out again at the end.
    shuffled = (
        marked.where("maybe").groupBy("text_sha256", "_id").agg(F.count(F.lit(1)).alias("n"))
    )
    # As a stored table it is broadcast if small; else both sides are exchanges, and the rows of a
    # large group are split.
    groups = settle(
        shuffled.groupBy("text_sha256").agg(
            F.min("_id").alias("keep_id"), F.sum("n").alias("group_size")
        ),
        "text-groups",
    )
    grouped = shuffled.join(groups, "text_sha256").selectExpr(
        "_id", "keep_id", "group_size", "text_sha256", "explode(sequence(1L, n)) AS copy"
    ).selectExpr("_id", "keep_id", "group_size", "_id <=> keep_id AND copy = 1 AS kept",
                 "text_sha256")
    return single.unionByName(grouped).withColumnRenamed("_id", id_col)


def drop_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS
) -> DataFrame:
    """``docs`` without the rows that `exact_groups` does not keep.

    Rows whose id is maybe one of a repeated text are joined by id and hash; all others pass.
    """
    groups = exact_groups(docs, id_col, text_col, max_bits)
    copies = settle(
        groups.where("group_size > 1")
        .groupBy(F.col(id_col).alias("_id"), F.col("text_sha256").alias("_sha"))
        .agg(F.max("kept").alias("_kept"), F.count(F.lit(1)).alias("_n"))
        .where("NOT _kept OR _n > 1"),
        "text-copies",
    )
    wanted = copies.select(F.col("_id").alias("key"))
    rows = packed(docs, key=id_col, text=text_col)
    maybe, stay = split_by_keys(rows, "key", wanted, copies.count())
    keyed = maybe.withColumn("own_sha", text_hash(F.col("text")))
    same = keyed["key"].eqNullSafe(copies["_id"]) & (keyed["own_sha"] == copies["_sha"])
    marked = keyed.join(copies, same, "left")
    once = marked.where("_sha IS NULL").select("row.*")
    again = marked.where("_kept").dropDuplicates(["_id", "_sha"]).select("row.*")
    return stay.select("row.*").unionByName(once).unionByName(again)
