"""Registered queries of the operators over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmine.llm import (
    ann,
    chat,
    collocations,
    exact_dedup,
    jaccard_join,
    licences,
    mixing,
    packing,
    pii,
    runs,
    simhash_golay,
    token_counts,
    toxicity,
)
from trailmine.llm.common import WORD, bound

WORD_TOKENIZER = "word_bpe_49k.json"
BYTE_RANKS = "byte_bpe_50k.tiktoken"
# Only for the registered query; a deployment gives a key of its own.
PII_KEY = "trailmine"
TOOLS: chat.Schema = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "count": {"text": ("string", True), "words": ("integer", True)},
    "merge": {"inputs": ("array", True), "strict": ("boolean", True)},
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    rows = mix.rows.join(mix.sources.drop("source"), "source_no")
    return rows.join(mixing.taken_words(mix), "row_id", "left").select(
        F.col("id").alias("doc_id"), "size", "source_size", "target",
        F.coalesce("taken", F.lit(0)).alias("taken"), "source",
    )


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    replaced = pii.replace_entities(_table(spark, sf_dir, "documents"), PII_KEY)
    return replaced.select("doc_id", "text", "n_entities")


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_notices(_table(spark, sf_dir, "documents"))


def _held_out(doc_id: str = "doc_id") -> Column:
    """A quarter of the documents, by id; labels of these are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    return toxicity.train(docs, _table(spark, sf_dir, "labels"), ~_held_out())


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity_model(spark, docs, sf_dir)
    scored = docs.select("doc_id", toxicity.toxic_score(model, F.col("text")).alias("score"))
    return scored.select(
        "doc_id", _held_out().alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def tool_tables(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results in the turns of a conversation.

    The table has no tool calls, so each turn of the user or the system becomes one, of a tool that
    follows from its text and with all of the text in its arguments, and each assistant turn the
    result of the call before it.  Some calls use the call two turns before, which may not be there,
    and some have a field of a wrong type.
    """
    pick = "pmod(xxhash64(text), 3)"
    wrong = "pmod(xxhash64(text), 17) = 0"
    words = "size(split(trim(coalesce(text, '')), ' +'))"
    before = "concat('c', conv_id, '_', turn - 2)"
    calls = turns.where("NOT role <=> 'assistant'").selectExpr(
        "conv_id", "turn", "concat('c', conv_id, '_', turn) AS call_id",
        f"CASE {pick} WHEN 0 THEN 'search' WHEN 1 THEN 'count' ELSE 'merge' END AS tool",
        f"CASE {pick} WHEN 0 THEN to_json(named_struct('query', text, "
        f"'limit', {words})) "
        f"WHEN 1 THEN IF({wrong}, to_json(named_struct('words', 'many', 'text', text)), "
        f"to_json(named_struct('words', {words}, 'text', text))) "
        f"ELSE to_json(named_struct('strict', true, 'inputs', "
        f"array(named_struct('$call', {before}, 'text', text)))) END AS arguments",
    )
    results = turns.where("role = 'assistant'").selectExpr(
        "conv_id", "turn", "concat('c', conv_id, '_', turn - 1) AS call_id", "text AS content"
    )
    return calls, results


def op5_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_tables(_table(spark, sf_dir, "conversations"))
    return chat.link_tool_calls(calls, results, TOOLS)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_components(_table(spark, sf_dir, "documents"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def with_derived_edits(docs: DataFrame) -> DataFrame:
    """Three edits for each document, at places that follow from its id: a passage of its own put in,
    a passage taken out, and a passage replaced by another."""
    text = "coalesce(text, '')"
    place = [f"int(pmod(xxhash64(doc_id, {i}), length({text}) + 1))" for i in range(5)]
    passage = [f"substring({text}, {place[i]} + 1, 30)" for i in (3, 4)]
    return docs.selectExpr(
        "doc_id", "text",
        f"array(named_struct('at', {place[0]}, 'removed', 0, 'added', {passage[0]}), "
        f"named_struct('at', {place[1]}, 'removed', 25, 'added', ''), "
        f"named_struct('at', {place[2]}, 'removed', 12, 'added', {passage[1]})) AS edits",
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_derived_edits(_table(spark, sf_dir, "documents"))
    ranks = public_tokenizers.path(BYTE_RANKS)
    return token_counts.edited_counts(docs, ranks, public_tokenizers.PATTERN)


def op10_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path(WORD_TOKENIZER)
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer)


def with_periods(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: documents of which every tenth, by a checksum of the id, repeats the words
    from some place on with some period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def planted(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = F.floor((n - a) / (g % 8 + 3)) + 1
        numbers = F.sequence(F.lit(0).cast("long"), n - 1)
        source = F.transform(numbers, lambda i: F.when(i < a, i).otherwise(a + (i - a) % p))
        return F.array_join(F.transform(source, lambda i: words[i.cast("int")]), " ")

    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    periodic = (h % 10 == 0) & F.col("text").rlike(WORD)
    return docs.select(
        "doc_id", F.when(periodic, bound(words, planted)).otherwise(F.col("text")).alias("text")
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(with_periods(_table(spark, sf_dir, "documents")))
    best = "array_max(transform(runs, r -> struct(r.length, -r.start AS down, -r.period AS p)))"
    lines = "transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n'))"
    return found.selectExpr("*", f"{best} AS best").selectExpr(
        "doc_id", "CAST(size(runs) AS long) AS n_runs",
        "-best.down AS start", "best.length AS length", "-best.p AS period",
        "1000 * best.length div -best.p AS exponent_milli",
        f"sha2(array_join({lines}, ''), 256) AS runs_sha256",
        "sha2(collapsed, 256) AS collapsed_sha256",
    )


def op12_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_golay.near_duplicates(_table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix_sources": op1_mix_sources,
        "op2_pii_surrogates": op2_pii_surrogates,
        "op3_licence_scan": op3_licence_scan,
        "op4_toxicity": op4_toxicity,
        "op5_tool_call_linking": op5_tool_call_linking,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
        "op8_nearest_neighbours": op8_nearest_neighbours,
        "op9_token_counts": op9_token_counts,
        "op10_pack_documents": op10_pack_documents,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_simhash_near_duplicates": op12_simhash_near_duplicates,
        "op13_collocations": op13_collocations,
    }
