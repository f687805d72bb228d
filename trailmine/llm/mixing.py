"""Mixing sources to target weights.

The words of each source, its documents in a pseudorandom order, are one long row cut into blocks of
``block_words``.  A target in words for each source becomes a number of slots, each to hold a block
(the last of a source maybe a part of one).  The slots of the mix are dealt into output shards: every
slot draws its source with the odds of the targets, which gives multinomial counts for each shard.
What a source draws beyond its number of slots goes to sources that drew too few, so targets are met
to the word.  Slot ``j`` of a source is in pass ``j div n_blocks`` over it and takes the block that a
keyed permutation of that pass gives; slots and blocks are then joined by index.  A pass takes every
block once, so no document is taken more often than there are passes.

All randomness is a hash of a seed and an index, so reruns agree.

Defined results: NULL and empty texts have no words and take nothing; a NULL source is a source of
its own, the last; an empty table gives an empty mix.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmine.llm.common import WORD, bound, buckets_for, packed, running_start, settle

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCK_WORDS = 512
SHARD_SLOTS = 1024
CELLS = 4096
ROUNDS = 24
SEED = 20_111
# The column of `numbered`.
ROW_ID = "_mix_row_id"


@dataclass(frozen=True)
class Mix:
    """``rows``: row_id, id, source, source_no, size, start.  ``sources``: source, source_no,
    source_size, target, goal, passes, n_blocks, n_slots.  ``shards``: shard, source_no, first, n.
    ``slots``: shard, source_no, pass, block, words."""

    rows: DataFrame
    sources: DataFrame
    shards: DataFrame
    slots: DataFrame
    block_words: int


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    rows: DataFrame, weights: tuple[float, ...], share: float, most: float
) -> DataFrame:
    """Targets of sources, filled up by weight until none is above ``most`` times its size.

    Sources reach their limit in the order of limit by weight.  Those before a source hold their
    limits; what is left, by the weights left, is the level that the source would get; it is full
    if its limit is below.  The windows run over one row for each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*map(F.lit, map(float, weights))),
        (F.pmod(F.col("source_no"), F.lit(len(weights))) + 1).cast("int"),
    )
    fill = Window.orderBy(F.col("full") / F.col("weight"), "source_no")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    onwards = fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    return (
        rows.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("source_no", F.row_number().over(by_name) - 1)
        .withColumn("weight", weight)
        .withColumn("full", F.col("source_size") * float(most))
        .withColumn("level", (
            F.sum("source_size").over(everything) * float(share)
            - F.coalesce(F.sum("full").over(before), F.lit(0.0))
        ) / F.sum("weight").over(onwards))
        .withColumn("open", F.col("level") * F.col("weight") < F.col("full"))
        # The first source that does not reach its limit has the largest level of those that do not;
        # it holds for all after it.
        .withColumn("level", F.max(F.when(F.col("open"), F.col("level"))).over(everything))
        .withColumn(
            "target", F.least("full", F.coalesce(F.col("level") * F.col("weight"), F.col("full")))
        )
        .select("source", "source_no", "source_size", "target")
    )


def permuted(index: Column, size: Column, rounds: int, *key: Column) -> Column:
    """A keyed permutation of ``0 … size - 1``: swap-or-not.

    Each round pairs ``x`` with ``k - x`` and swaps the pair or not, by a hash of its larger number.
    """
    def swap(x: Column, r: Column) -> Column:
        other = F.pmod(F.xxhash64(*key, r) - x, size)
        coin = F.xxhash64(*key, r, F.greatest(x, other), F.lit(1)).bitwiseAND(F.lit(1))
        return F.when(coin == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index, swap)


def _drawn(sources: DataFrame, n_slots: int, shard_slots: int, seed: int) -> DataFrame:
    """Multinomial counts ``shard, source_no, n``: each slot draws a source."""
    spark = sources.sparkSession
    per_cell = -(-n_slots // CELLS)
    ranges = sources.where("n_slots > 0").selectExpr(
        "source_no", "slots_before AS lo", "slots_before + n_slots AS hi",
        f"explode(sequence(slots_before div {per_cell}, "
        f"(slots_before + n_slots - 1) div {per_cell})) AS cell",
    )
    drawn = spark.range(n_slots).select(
        F.expr(f"id div {shard_slots}").alias("shard"),
        F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n_slots)).alias("draw"),
    ).withColumn("cell", F.expr(f"draw div {per_cell}"))
    return (
        drawn.join(ranges, "cell")
        .where("draw >= lo AND draw < hi")
        .groupBy("shard", "source_no")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def deal_shards(sources: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """``shard, source_no, first, n``: which slots of which source each shard holds."""
    spark = sources.sparkSession
    n_slots, n_sources = sources.agg(
        F.coalesce(F.sum("n_slots"), F.lit(0)), F.count(F.lit(1))
    ).first()
    shard_slots = max(shard_slots, 4 * n_sources)
    if not n_slots:
        return spark.createDataFrame([], "shard long, source_no int, first long, n long")
    n_shards = -(-n_slots // shard_slots)
    order = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    quota = sources.withColumn(
        "slots_before", F.coalesce(F.sum("n_slots").over(order), F.lit(0))
    )
    every = spark.range(n_shards).select(
        F.col("id").alias("shard"),
        F.explode(F.sequence(F.lit(0), F.lit(n_sources - 1))).alias("source_no"),
    )
    counts = _drawn(quota, n_slots, shard_slots, seed)
    grid = (
        every.join(counts, ["shard", "source_no"], "left")
        .join(quota.select("source_no", "n_slots"), "source_no")
        .withColumn("n", F.coalesce("n", F.lit(0)))
    )
    stretch = F.expr("shard div 512")
    by_shard = [F.col("shard")]
    grid = settle(
        running_start(grid, ["source_no"], stretch, by_shard, F.col("n"), "before").withColumn(
            "kept", F.greatest(F.least("n", F.expr("n_slots - before")), F.lit(0))
        ),
        "mix-draws",
    )
    # The k-th slot drawn too often goes to the source that lacks its k-th slot.
    over = grid.groupBy("shard").agg(F.sum(F.expr("n - kept")).alias("over"))
    over = running_start(
        over.withColumn("_all", F.lit(0)), ["_all"], stretch, by_shard, F.col("over"), "over_from"
    ).drop("_all")
    lack = (
        grid.groupBy("source_no", "n_slots")
        .agg(F.sum("kept").alias("kept"))
        .selectExpr("source_no", "n_slots - kept AS lack")
        .withColumn("lack_from", F.coalesce(F.sum("lack").over(order), F.lit(0)))
    )
    topped = grid.join(over, "shard").join(lack, "source_no").selectExpr(
        "shard", "source_no",
        "kept + greatest(0L, least(over_from + over, lack_from + lack) "
        "- greatest(over_from, lack_from)) AS n",
    )
    placed = running_start(topped, ["source_no"], stretch, by_shard, F.col("n"), "first")
    return placed.where("n > 0").select("shard", "source_no", "first", "n")


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` written with a number for each row, by which a mix of it finds its rows again."""
    return settle(docs.withColumn(ROW_ID, F.monotonically_increasing_id()), "mix-documents")


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    block_words: int = BLOCK_WORDS,
    shard_slots: int = SHARD_SLOTS,
    seed: int = SEED,
) -> Mix:
    """Plans a mix of ``share`` times all words of ``docs``; see the module."""
    sizes = settle(
        docs.select(
            (F.col(ROW_ID) if ROW_ID in docs.columns else F.monotonically_increasing_id())
            .alias("row_id"),
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            n_words(F.col(text_col)).alias("size"),
        ),
        "mix-sizes",
    )
    targets = source_targets(sizes, weights, share, most)
    goal = targets.withColumn("goal", F.round("target").cast("long")).withColumn(
        "passes", F.expr("IF(source_size > 0, goal div source_size, 0L)")
    )
    sources = settle(
        goal.withColumn("n_blocks", F.expr(f"(source_size + {block_words - 1}) div {block_words}")).withColumn(
            "n_slots",
            F.expr(
                f"passes * n_blocks + (goal - passes * source_size + {block_words - 1}) div {block_words}"
            ),
        ),
        "mix-sources",
    )
    numbered = sizes.join(
        sources.select("source", "source_no"), sizes["source"].eqNullSafe(sources["source"])
    ).select("row_id", "id", sizes["source"], "source_no", "size")
    bucket = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(buckets_for(sizes.count())))
    order = [F.xxhash64(F.lit(seed), "id"), F.col("id"), F.col("row_id")]
    rows = running_start(numbered, ["source_no"], bucket, order, F.col("size"), "start")
    shards = settle(deal_shards(sources, shard_slots, seed), "mix-shards")
    whole = F.expr(f"source_size div {block_words}")
    slots = (
        shards.selectExpr("shard", "source_no", "explode(sequence(first, first + n - 1)) AS j")
        .join(sources, "source_no")
        .withColumn("pass", F.expr("j div n_blocks"))
        .withColumn("at", F.expr("j % n_blocks"))
        .withColumn("whole", whole)
        # The short block of a source, if it has one, comes last in every pass.
        .withColumn("block", F.when(
            F.col("at") < F.col("whole"),
            permuted(F.col("at"), F.col("whole"), ROUNDS,
                     F.lit(seed), F.col("source_no"), F.col("pass")),
        ).otherwise(F.col("at")))
        .withColumn("words", F.expr(
            f"least({block_words}L, source_size - block * {block_words}, "
            f"IF(pass < passes, {block_words}L, "
            f"goal - passes * source_size - at * {block_words}))"
        ))
        .select("shard", "source_no", "pass", "block", "words")
    )
    return Mix(rows, sources, shards, slots, block_words)


def pieces(mix: Mix) -> DataFrame:
    """Parts of documents in blocks: ``row_id, id, source_no, block, at, skip, words``.

    The part starts at word ``at`` of the block and at word ``skip`` of the document.
    """
    width = mix.block_words
    return (
        mix.rows.where("size > 0")
        .selectExpr(
            "row_id", "id", "source_no", "size", "start",
            f"explode(sequence(start div {width}, (start + size - 1) div {width})) AS block",
        )
        .selectExpr(
            "row_id", "id", "source_no", "block",
            f"greatest(start - block * {width}, 0L) AS at",
            f"greatest(block * {width} - start, 0L) AS skip",
            f"least(start + size, (block + 1) * {width}) - greatest(start, block * {width}) "
            "AS words",
        )
    )


def taken_words(mix: Mix) -> DataFrame:
    """``row_id, taken``: words of each document in the mix, repeats counted."""
    used = mix.slots.groupBy("source_no", "block", F.col("words").alias("slot_words")).agg(
        F.count(F.lit(1)).alias("times")
    )
    return (
        pieces(mix)
        .join(used, ["source_no", "block"])
        .groupBy("row_id")
        .agg(F.sum(F.expr(
            "times * greatest(0L, least(at + words, slot_words) - at)")).alias("taken"))
    )


def mixed_parts(mix: Mix) -> DataFrame:
    """The mix itself, as parts of documents in slots of shards.

    ``shard, source_no, pass, block, at, row_id, id, skip, words``
    """
    joined = mix.slots.withColumnRenamed("words", "slot_words").join(
        pieces(mix), ["source_no", "block"]
    )
    return joined.where("at < slot_words").selectExpr(
        "shard", "source_no", "pass", "block", "at", "row_id", "id", "skip",
        "least(at + words, slot_words) - at AS words",
    )


def cut_words(text: Column, skip: Column, words: Column) -> Column:
    """Words of a text with the white space behind each."""
    every = F.regexp_extract_all(text, F.lit(f"{WORD}[\\x20\\x09-\\x0D]*"), F.lit(0))
    return F.array_join(F.slice(every, (skip + 1).cast("int"), words.cast("int")), "")


def _row_key(docs: DataFrame, mix: Mix, id_col: str) -> tuple[str, str]:
    """Columns of ``docs`` and of ``mix.rows`` that tell rows: numbers, or ids if there are none."""
    if ROW_ID in docs.columns:
        return ROW_ID, "row_id"
    if mix.rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").take(1):
        raise ValueError("ids repeat: mix the documents as of numbered()")
    return id_col, "id"


def mixed_blocks(
    docs: DataFrame, mix: Mix, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The mix as texts, one row for each slot: ``shard, source_no, pass, block, text``.

    Documents are as of `numbered`, or have unique ids.
    """
    parts = mixed_parts(mix)
    own, key = _row_key(docs, mix, id_col)
    texts = docs.select(F.col(own).alias("_own"), F.col(text_col).alias("_text"))
    part = F.struct("at", cut_words(F.col("_text"), F.col("skip"), F.col("words")).alias("text"))
    listed = F.array_sort(F.collect_list(part))
    return (
        parts.join(texts, parts[key].eqNullSafe(texts["_own"]))
        .groupBy("shard", "source_no", "pass", "block")
        .agg(F.array_join(F.transform(listed, lambda p: F.rtrim(p["text"])), " ").alias("text"))
    )


def mixed_documents(docs: DataFrame, mix: Mix) -> DataFrame:
    """The mix as rows of the columns of ``docs``, for a next stage that works on documents.

    A document comes whole once for each full pass over its source; what the last, unfinished pass
    takes of it comes as one more row, with the words taken as its text.  Documents without words
    come once.  Needs ``doc_id, text, source``; documents are as of `numbered`, whose column goes, or
    have unique ids.
    """
    own, key = _row_key(docs, mix, "doc_id")
    last = (
        mixed_parts(mix)
        .join(mix.sources.select("source_no", "passes"), "source_no")
        .where("pass = passes")
        .groupBy("row_id")
        .agg(F.array_sort(F.collect_list(F.struct("skip", "words"))).alias("spans"))
    )
    plan = mix.rows.join(mix.sources.select("source_no", "passes"), "source_no").join(
        last, "row_id", "left"
    ).selectExpr(f"{key} AS own", "spans", "IF(size = 0, 1L, passes) AS passes")
    rows = packed(docs, key=own, text="text")
    marked = rows.join(plan, rows["key"].eqNullSafe(plan["own"]))
    every = F.regexp_extract_all("text", F.lit(f"{WORD}[\\x20\\x09-\\x0D]*"), F.lit(0))
    cut = bound(every, lambda words: F.transform("spans", lambda s: F.array_join(
        F.slice(words, (s["skip"] + 1).cast("int"), s["words"].cast("int")), "")))
    copies = F.concat(
        F.array_repeat(F.col("text"), F.col("passes").cast("int")),
        F.when(F.col("spans").isNull(), F.array().cast("array<string>")).otherwise(
            F.array(F.array_join(cut, ""))),
    )
    kinds = {c: F.col("row")[c].alias(c) for c in docs.columns if c != ROW_ID}
    kinds["text"] = F.col("copy").alias("text")
    if "n_chars" in kinds:
        kinds["n_chars"] = F.coalesce(F.length("copy"), F.lit(0)).cast(
            docs.schema["n_chars"].dataType).alias("n_chars")
    return marked.withColumn("copy", F.explode(copies)).select(*kinds.values())
