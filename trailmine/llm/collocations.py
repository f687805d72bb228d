"""Collocations: phrases of two to five words that occur together more often than by chance.

All phrases are counted by a trie over word ids, as in a HAT-trie.  Its leaves are containers, each
for a range of prefixes; a container that grows too large bursts into two of smaller ranges.  Phrases
come in by thousands, so a container merges them as sorted arrays, where a HAT-trie has a hash table.
When a task's trie holds too much, whole subtrees, the largest first, leave it as sorted runs.  A run
is one row for each prefix partition, that is for a hash of all words but the last: a list of prefixes,
and lists of the last words, their counts and the places of their prefixes.  Only phrases become rows,
after the shuffle; they are summed by prefix partition.  Prefixes
that begin with one of the most frequent words, of which there are at most ``HOT_WORDS``, are dealt to
``SALTS`` partitions by the last word.  There are more partitions where the table is read in more
tasks, four for each.

The texts are read level by level: words; pairs of words that are frequent; triples whose pairs are;
longer phrases whose triples are.  A phrase is never more frequent than a part of it, so nothing that
reaches ``min_count`` is lost.  Frequent phrases of one level reach the next as a filter of at most
``Limits.filter_bits`` bits (8 MB), whatever the input; with more phrases it lets more through, and the
counts are the same.

Cuts of a phrase are scored in exact integers.  Whether a longer phrase makes a phrase superfluous is
decided by the counts of phrases with one more word, since counts between are equal then.

Defined results: NULL and empty texts and texts of separators have no words; a NULL language is
``und``; repeated rows count as often as they occur.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmine.llm.common import settle

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2_000
# A word is hot if it makes up this part of all words; so there are no more hot words.
HOT_WORDS = 1_000
HOT = -1  # where their hashes stand beside the filters
SALTS = 64
ID_BITS = 21  # of the number of a word in a task
ROWS = 500  # of a batch handed back
RUN_SCHEMA = (
    "lang string, part bigint, heads array<string>, places array<int>, tails array<string>, "
    "times array<bigint>"
)

_FACTORS = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(1, 64)], np.uint64)
# Fixed value: what ends a piece.  Everything is mapped to line ends, tabs to spaces, in bytes.
_PIECES = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")
_UPPER = bytes(range(65, 91))
_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())
# Stands for the end of a piece; no text in UTF-8 has this byte.
END = b"\xff"
_TABLE = _LOWER.translate(_PIECES)


@dataclass(frozen=True)
class Limits:
    """What a task holds; results do not depend on it."""

    # Entries of a container before it bursts, and of a trie before subtrees leave it.
    burst: int = 1 << 17
    entries: int = 2_000_000
    # Words held before they are counted, and bytes of distinct words before numbering starts anew.
    buffer: int = 1_000_000
    word_bytes: int = 64_000_000
    # Of the filter of a level, a multiple of 32,768.
    filter_bits: int = 1 << 26
    # Prefix partitions of each language; `collocations` takes more for larger tables.
    parts: int = 1_024


class _Container:
    """Phrases as two numbers, of three words each, with counts; sorted when compact."""

    def __init__(self, rows: np.ndarray):
        self.parts = [rows]
        self.size = rows.shape[1]

    def add(self, rows: np.ndarray) -> None:
        self.parts.append(rows)
        self.size += rows.shape[1]

    def compact(self) -> np.ndarray:
        if len(self.parts) > 1:
            high, low, times = np.concatenate(self.parts, axis=1)
            order = np.lexsort((low, high))
            high, low = high[order], low[order]
            new = np.ones(len(high), bool)
            new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
            starts = np.flatnonzero(new)
            summed = np.add.reduceat(times[order], starts)
            self.parts = [np.stack([high[starts], low[starts], summed])]
            self.size = len(starts)
        return self.parts[0]


class PhraseTrie:
    """Counts of phrases; containers stand in the order of their prefixes."""

    def __init__(self, burst: int = Limits.burst):
        self.burst = burst
        self.clear()

    def clear(self) -> None:
        self.containers = [_Container(np.empty((3, 0), np.int64))]
        self.lows = [-1]  # the lowest first number of each container

    @property
    def size(self) -> int:
        return sum(c.size for c in self.containers)

    def add(self, rows: np.ndarray) -> None:
        """Adds sorted rows: two numbers and a count."""
        cuts = np.append(np.searchsorted(rows[0], self.lows), rows.shape[1])
        full = []
        for i, container in enumerate(self.containers):
            if cuts[i] < cuts[i + 1]:
                container.add(rows[:, cuts[i] : cuts[i + 1]])
                if container.size > self.burst:
                    full.append(i)
        for i in reversed(full):
            self._burst(i)

    def _burst(self, i: int) -> None:
        rows = self.containers[i].compact()
        if rows.shape[1] <= self.burst // 2:
            return
        middle = rows[0, rows.shape[1] // 2]
        cut = int(np.searchsorted(rows[0], middle))
        cut = cut or int(np.searchsorted(rows[0], middle, "right"))
        if cut < rows.shape[1]:
            self.containers[i : i + 1] = [_Container(rows[:, :cut]), _Container(rows[:, cut:])]
            self.lows.insert(i + 1, int(rows[0, cut]))

    def spill(self, left: int) -> Iterator[np.ndarray]:
        """Takes out the entries of containers, the largest first, until at most ``left`` stay; each
        is a sorted run."""
        held = self.size
        for container in sorted(self.containers, key=lambda c: -c.size):
            if held <= left or not container.size:
                return
            held -= container.size
            yield container.compact()
            container.parts, container.size = [np.empty((3, 0), np.int64)], 0


def _hashed_lang(lang: str) -> bytes:
    return lang.encode("utf-8", "replace") + b"\0"


def _word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(_hashed_lang(lang) + word)


def _strings(words: list[bytes]) -> pa.Array:
    return pa.array(words, pa.binary()).cast(pa.string())


def _bits(hashes: np.ndarray, starts: np.ndarray, length: int, n_bits: int) -> np.ndarray:
    """Numbers of the filter bits of the phrases of ``length`` words at ``starts``."""
    total = np.full(len(starts), length, np.uint64)
    for i in range(length):
        total += hashes[starts + i] * _FACTORS[i]
    total = (total ^ (total >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((total ^ (total >> np.uint64(29))) % np.uint64(n_bits)).astype(np.int64)


def _is_set(bitmap: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (bitmap[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1 == 1


class _Numbers(dict):
    """Numbers of the words of one language, given out as words come up."""

    def __init__(self, counter: _Counter, lang: str, lang_number: int):
        super().__init__({END: 0})
        self.counter, self.lang_number = counter, lang_number
        self.prefix = _hashed_lang(lang)

    def __missing__(self, word: bytes) -> int:
        counter = self.counter
        number = self[word] = len(counter.words)
        counter.words.append(word)
        counter.lang_numbers.append(self.lang_number)
        counter.hashes.append(xxhash.xxh3_64_intdigest(self.prefix + word))
        counter.held_bytes += len(word) + 150
        return number


class _Counter:
    """Counts the phrases of one task."""

    def __init__(
        self,
        lengths: tuple[int, ...],
        known: int,
        filters: dict[int, np.ndarray],
        limits: Limits,
    ):
        self.lengths, self.known, self.filters, self.limits = lengths, known, filters, limits
        self.tries = {length: PhraseTrie(limits.burst) for length in lengths}
        self._start_buffer()
        self._start_numbers()

    def _start_buffer(self) -> None:
        self.ids: list[np.ndarray] = []
        self.n_ids = 0

    def _start_numbers(self) -> None:
        # Number 0 is no word, but the end of a piece.
        self.words, self.lang_numbers, self.hashes = [b""], [-1], [0]
        self.hash_array = np.zeros(0, np.uint64)
        self.by_lang: dict[str, _Numbers] = {}
        self.held_bytes = 0

    def add(self, lang: str, text: str | None) -> None:
        if lang not in self.by_lang:
            self.by_lang[lang] = _Numbers(self, lang, len(self.by_lang))
        data = (text or "").encode("utf-8", "replace").translate(_TABLE)
        words = data.replace(b"\n", b" " + END + b" ").split()
        words.append(END)
        number = self.by_lang[lang].__getitem__
        self.ids.append(np.fromiter(map(number, words), np.int64, len(words)))
        self.n_ids += len(words)

    def known_hashes(self) -> np.ndarray:
        """The hashes of all words so far."""
        more = self.hashes[len(self.hash_array) :]
        self.hash_array = np.concatenate([self.hash_array, np.array(more, np.uint64)])
        return self.hash_array

    def count(self) -> None:
        """Puts the phrases of the words at hand into the trie."""
        ids = np.concatenate([*self.ids, np.zeros(1, np.int64)])
        self._start_buffer()
        hashes = self.known_hashes()
        if self.known:
            # A word that is not frequent ends a piece too.
            bits = _bits(hashes, np.arange(len(hashes)), 1, self.limits.filter_bits)
            ids = np.where(_is_set(self.filters[1], bits)[ids], ids, 0)
        hashes = hashes[ids]
        spaced = np.concatenate([ids, np.zeros(max(self.lengths), np.int64)])
        starts = np.flatnonzero(ids)
        whole = np.zeros(len(spaced), bool)
        if self.known > 1:
            inside = starts[self._together(spaced, starts, self.known)]
            bits = _bits(hashes, inside, self.known, self.limits.filter_bits)
            whole[inside] = _is_set(self.filters[self.known], bits)
        else:
            whole[starts] = True
        width = max(self.known, 1)
        for length in self.lengths:
            at = starts[self._together(spaced, starts, length)]
            for i in range(length - width + 1):
                at = at[whole[at + i]]
            self._count_at(spaced, at, length)

    @staticmethod
    def _together(spaced: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
        inside = np.ones(len(starts), bool)
        for i in range(1, length):
            inside &= spaced[starts + i] > 0
        return inside

    def _count_at(self, ids: np.ndarray, at: np.ndarray, length: int) -> None:
        if not len(at):
            return
        high = low = np.zeros(len(at), np.int64)
        for i in range(length):
            if i < 3:
                high = high | ids[at + i] << (ID_BITS * (2 - i))
            else:
                low = low | ids[at + i] << (ID_BITS * (5 - i))
        rows = _Container(np.stack([high, low, np.ones(len(at), np.int64)]))
        rows.parts.append(np.empty((3, 0), np.int64))
        self.tries[length].add(rows.compact())

    def _batches(self, length: int, run: np.ndarray) -> Iterator[pa.RecordBatch]:
        """A run as rows of ``RUN_SCHEMA``."""
        high, low, times = run
        mask = (1 << ID_BITS) - 1
        ids = [
            (high >> ID_BITS * (2 - i) if i < 3 else low >> ID_BITS * (5 - i)) & mask
            for i in range(length)
        ]
        last, first = ids[-1], ids[0]
        hashes = self.known_hashes()
        lang = np.array(self.lang_numbers)[last]
        salt = hashes[last] >> np.uint64(32)
        head = np.zeros(len(last), np.int64)
        if length > 1:
            hot = np.isin(hashes[first], self.filters[HOT])
            salt = np.where(hot, salt % np.uint64(SALTS), np.uint64(0))
            for i, x in enumerate(ids[:-1]):
                salt = salt + hashes[x] * _FACTORS[i]
            head[1:] = np.cumsum(np.any([x[1:] != x[:-1] for x in ids[:-1]], axis=0))
        part = ((salt ^ (salt >> np.uint64(29))) % np.uint64(self.limits.parts)).astype(np.int64)
        order = np.lexsort((head, part, lang))
        lang, part, head = lang[order], part[order], head[order]
        outer = np.ones(len(order), bool)
        outer[1:] = (lang[1:] != lang[:-1]) | (part[1:] != part[:-1])
        inner = outer.copy()
        inner[1:] |= head[1:] != head[:-1]
        starts = np.flatnonzero(inner)
        rows = np.flatnonzero(outer)
        ends = np.append(rows, len(order)).astype(np.int32)
        row_ends = np.append(np.searchsorted(starts, rows), len(starts)).astype(np.int32)
        places = np.cumsum(inner) - 1 - np.repeat(row_ends[:-1], np.diff(ends))
        words, names = self.words, list(self.by_lang)
        columns = [x[order[starts]].tolist() for x in ids[:-1]]
        heads = [b" ".join([words[i] for i in row]) for row in zip(*columns, strict=True)]
        tails = _strings(words).take(pa.array(last[order]))
        table = pa.table(
            {
                "lang": pa.array([names[i] for i in lang[rows].tolist()], pa.string()),
                "part": part[rows],
                "heads": pa.ListArray.from_arrays(
                    row_ends, _strings(heads or [b""] * len(starts))
                ),
                "places": pa.ListArray.from_arrays(ends, pa.array(places, pa.int32())),
                "tails": pa.ListArray.from_arrays(ends, tails),
                "times": pa.ListArray.from_arrays(ends, pa.array(times[order])),
            }
        )
        yield from table.to_batches(max_chunksize=ROWS)

    def _spill(self, left: int) -> Iterator[pa.RecordBatch]:
        for length, trie in self.tries.items():
            for run in trie.spill(left):
                yield from self._batches(length, run)

    def over_full(self) -> Iterator[pa.RecordBatch]:
        """Counts what is at hand if it is much, and lets subtrees go if the tries hold too much."""
        limits = self.limits
        if self.n_ids < limits.buffer and self.held_bytes < limits.word_bytes:
            return
        self.count()
        if self.held_bytes >= limits.word_bytes:
            # Phrases in the tries name words by number.
            yield from self._spill(0)
            self._start_numbers()
        elif sum(t.size for t in self.tries.values()) > limits.entries:
            yield from self._spill(limits.entries // 2 // len(self.tries))

    def rest(self) -> Iterator[pa.RecordBatch]:
        self.count()
        yield from self._spill(0)


def _filter_of(frequent: DataFrame, length: int, n_bits: int) -> np.ndarray:
    """The filter of a level: bits of its frequent phrases, put together by chunk on Spark."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes = [
                _word_hash(lang, w)
                for lang, phrase in zip(batch["lang"], batch["phrase"], strict=True)
                for w in phrase.encode().split(b" ")
            ]
            starts = np.arange(len(batch), dtype=np.int64) * length
            bits = _bits(np.array(hashes, np.uint64), starts, length, n_bits)
            yield pd.DataFrame({"bit": bits})

    bits = frequent.mapInPandas(run, "bit long")
    # bitmap_construct_agg makes bitmaps of 32,768 bits; all together are n_bits / 8 bytes.
    blocks = bits.groupBy(F.expr("bit div 32768").alias("block")).agg(
        F.expr("bitmap_construct_agg(bit % 32768)").alias("bitmap")
    )
    bitmap = np.zeros(n_bits // 8, np.uint8)
    for block, data in blocks.toLocalIterator():
        bitmap[block * 4096 : block * 4096 + len(data)] = np.frombuffer(data, np.uint8)
    return bitmap


def count_phrases(
    docs: DataFrame,
    lengths: tuple[int, ...],
    filters: dict[int, np.ndarray] | None = None,
    known: int = 0,
    limits: Limits = Limits(),
) -> DataFrame:
    """``lang, phrase, f`` of all phrases of ``lengths`` words in ``_lang`` and ``_text``.

    With ``known``, phrases whose parts of ``known`` words are all in its filter.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(filters or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(lengths, known, shared.value, limits)
        for batch in batches:
            langs, texts = batch.column("_lang").to_pylist(), batch.column("_text").to_pylist()
            for lang, text in zip(langs, texts, strict=True):
                counter.add(lang, text)
                yield from counter.over_full()
        yield from counter.rest()

    runs = docs.select("_lang", "_text").mapInArrow(run, RUN_SCHEMA)
    merged = (
        runs.repartition("lang", "part")
        .selectExpr(
            "lang", "part", "heads", "inline(arrays_zip(places, tails, times)) AS (place, tail, n)"
        )
        .selectExpr("lang", "part", "heads[place] AS head", "tail", "n")
        .groupBy("lang", "part", "head", "tail")
        .agg(F.sum("n").alias("f"))
    )
    phrase = "IF(head = '', tail, concat(head, ' ', tail)) AS phrase"
    return merged.selectExpr("lang", phrase, "f")


def _exact_scores(cuts: DataFrame) -> DataFrame:
    """Adds ``score``; the products may be larger than any number type of SQL."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch.copy()
            out["score"] = np.array(
                [
                    1000 * a * n // (left * right)
                    for a, n, left, right in zip(
                        *[batch[c].tolist() for c in ("a", "n", "l", "r")], strict=True
                    )
                ],
                np.int64,
            )
            yield out

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cuts.schema)
    return cuts.mapInPandas(run, f"{kinds}, score long")


def collocations(
    docs: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    min_count: int = MIN_COUNT,
    max_words: int = MAX_WORDS,
    top: int = TOP,
    limits: Limits = Limits(),
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the best ``top`` phrases of each language."""
    given = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("_lang"),
        F.col(text_col).cast("string").alias("_text"),
    )
    limits = replace(limits, parts=max(limits.parts, 4 * given.rdd.getNumPartitions()))
    words = settle(count_phrases(given, (1,), limits=limits), "words")
    totals = settle(words.groupBy("lang").agg(F.sum("f").alias("n")), "word-totals")
    enough = F.col("f") >= min_count
    levels = [settle(words.where(enough).withColumn("len", F.lit(1)), "phrases")]
    n_words = totals.agg(F.sum("n")).first()[0] or 0
    hot = words.where(F.col("f") * HOT_WORDS >= n_words).select("lang", "phrase").collect()
    filters = {
        HOT: np.array([_word_hash(lang, w.encode()) for lang, w in hot], np.uint64),
        1: _filter_of(levels[0], 1, limits.filter_bits),
    }
    steps = [(n,) for n in range(2, min(max_words, 3) + 1)]
    if max_words > 3:
        steps.append(tuple(range(4, max_words + 1)))
    for lengths in steps:
        known = lengths[0] - 1
        if known > 1:
            filters = {HOT: filters[HOT], 1: filters[1], known: _filter_of(levels[-1], known, limits.filter_bits)}
        found = count_phrases(given, lengths, filters, known, limits).where(enough)
        size = F.size(F.split("phrase", " "))
        levels.append(settle(found.withColumn("len", size), "phrases"))

    frequent = levels[0]
    for level in levels[1:]:
        frequent = frequent.unionByName(level)
    candidates = frequent.where("len > 1")
    inner = [
        "array_join(slice(split(phrase, ' '), 1, len - 1), ' ')",
        "array_join(slice(split(phrase, ' '), 2, len - 1), ' ')",
    ]
    longer = candidates.where("len > 2").selectExpr(
        "lang", f"explode(array({', '.join(inner)})) AS phrase", "0L AS a", "f AS longer"
    )
    kept = (
        candidates.selectExpr("lang", "phrase", "f AS a", "0L AS longer").union(longer)
        .groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("longer").alias("longer"))
        .where("a > longer")
    )
    cut = "explode(sequence(1, size(split(phrase, ' ')) - 1)) AS k"
    parts = kept.selectExpr("lang", "phrase", "a", "split(phrase, ' ') AS words", cut).selectExpr(
        "lang", "phrase", "a", "k", "array_join(slice(words, 1, k), ' ') AS head",
        "array_join(slice(words, k + 1, size(words) - k), ' ') AS tail",
    )
    counts = frequent.select("lang", "phrase", "f")
    cuts = (
        parts.join(counts.selectExpr("lang", "phrase AS head", "f AS l"), ["lang", "head"])
        .join(counts.selectExpr("lang", "phrase AS tail", "f AS r"), ["lang", "tail"])
        .join(totals, "lang")
        .select("lang", "phrase", "a", "k", "l", "r", "n")
    )
    scored = (
        _exact_scores(cuts)
        .groupBy("lang", "phrase", "a", "n")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        .selectExpr("lang", "phrase", "a", "n", "cut.l", "cut.r", "cut.score")
        .withColumn("part", F.expr(f"pmod(xxhash64(phrase), {SALTS})"))
    )
    best = [F.desc("score"), F.desc("a"), F.col("phrase")]
    place = F.row_number()
    # The best of each part first, so that no task ranks all phrases of a language.
    few = scored.withColumn(
        "rank", place.over(Window.partitionBy("lang", "part").orderBy(*best))
    ).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", place.over(Window.partitionBy("lang").orderBy(*best)))
    return ranked.where(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
