"""Packing documents into sequences of at most ``capacity`` tokens by length patterns.

Token counts are all that packing needs.  The histogram of piece lengths, at most ``capacity``
numbers however many pieces there are, comes to the driver.  There, patterns of up to three lengths
that fill a sequence are enumerated (lengths rounded up to ``width``), and their repeat counts are
fitted to the histogram by non-negative least squares and rounded down.  What is left of the
histogram is packed by best-fit decreasing on exact lengths, again as patterns with repeat counts.
So every piece of the histogram has a place in some repeat of some pattern.

The plan is a bounded table: for each length, ranges of ranks and the sequences that they go to.
Spark numbers the pieces of each length, and each finds its sequence by a join with that table.
No piece passes through the driver, and no group of pieces through one task.

Defined results: a NULL text counts as empty; an empty document has one token, the end mark.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmine.llm.common import buckets_for, gives_back, running_start, settle, use_cache

CAPACITY = 2048
END_ID = 0
WIDTH = 4
PARTS = 3
CACHED_PARTS = 800_000
GROUP_CHARS = 2_000_000

PIECES = "piece int, start long, length long, ids_crc32 long"

class WordEncoder:
    """Token ids of texts, as little-endian bytes, with a cache of parts of words and of odd words.

    The tokenizer drops white space and never joins tokens across it, so a text's ids are those of
    its words, one after another.  Plain words, of printable ASCII and Latin-1 letters, are cut as the
    tokenizer itself cuts them, all of a text at once, as no part holds white space.  Unknown parts
    are encoded together, with spaces between; each part ends with a token that ends a word.  All
    other words are odd: they go to the tokenizer as they are, and are marked by a space ahead.  The
    cache starts anew when it is full.
    """

    # Fixed value: how the tokenizer cuts words of these characters, in lower case.
    PARTS = re.compile(
        r"'s|'t|'re|'ve|'m|'ll|'d|[a-zµªºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\sa-z0-9µªºß-öø-ÿ²³¹¼½¾]+"
    )

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        # Words that may hold a special token are not plain.
        added = self.tokenizer.get_added_tokens_decoder().values()
        first = "".join(re.escape(t.content[0]) for t in added)
        self.odd = re.compile(
            "[^\\x09-\\x0d\\x20-\\x7eÀ-ÖØ-öø-ÿ]" + (f"|[{first}]" if first else "")
        ).search
        self.parts: dict[str, bytes] = {}

    def _encode(self, text: str) -> np.ndarray:
        found = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0]
        return np.array(found.ids, "<u4")

    def _cut(self, text: str) -> list[str]:
        if self.odd(text) is None:
            return self.PARTS.findall(text.lower())
        # Of bytes, split() takes the six characters of ASCII white space alone.
        words = text.encode("utf-8", "replace").split()
        out: list[str] = []
        for is_odd, some in groupby([w.decode("utf-8") for w in words], lambda w: bool(self.odd(w))):
            if is_odd:
                out.extend(" " + word for word in some)
            else:
                out.extend(self.PARTS.findall(" ".join(some).lower()))
        return out

    def _learn(self, unknown: list[str]) -> None:
        for word in unknown:
            if word[0] == " ":
                self.parts[word] = self._encode(word[1:]).tobytes()
        plain = [part for part in unknown if part[0] != " "]
        if plain:
            ids = self._encode(" ".join(plain))
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(stops) != len(plain):
                raise ValueError("the tokenizer does not cut words as expected")
            data = ids.tobytes()
            self.parts.update(
                (p, data[a:b]) for p, a, b in zip(plain, [0, *stops[:-1]], stops, strict=True)
            )

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self._cut(text) for text in texts]
        parts = set().union(*cut)
        unknown = [p for p in parts if p not in self.parts]
        if len(unknown) + len(self.parts) > CACHED_PARTS:
            self.parts.clear()
            unknown = list(parts)
        self._learn(unknown)
        known = self.parts.__getitem__
        return [b"".join(map(known, c)) for c in cut]


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    use_cache("tokens", _encoders.clear)
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _encoded(encoder: WordEncoder, texts: pd.Series) -> Iterator[bytes]:
    """Ids of each text; texts are taken together up to a number of characters."""
    group: list[str] = []
    size = 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= GROUP_CHARS:
            yield from encoder.encode(group)
            group, size = [], 0
    yield from encoder.encode(group)


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """Tokenizes documents and cuts those longer than ``capacity``.

    ``tokenizer`` is the path of a tokenizer that splits at white space and drops it.  Returns the
    id, ``piece, start, length, ids_crc32``, and ``ids`` if asked for.
    """
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * capacity

    @gives_back
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(tokenizer)
        for batch in batches:
            rows = []
            for at, data in enumerate(_encoded(encoder, batch["_text"])):
                data += end
                for piece, start in enumerate(range(0, len(data), step)):
                    part = data[start : start + step]
                    rows.append((at, piece, start // 4, len(part) // 4, zlib.crc32(part), part))
            at, piece, start, length, crc, part = zip(*rows, strict=True) if rows else [()] * 6
            out = batch[["_id"]].take(list(at)).reset_index(drop=True)
            out = out.assign(piece=piece, start=start, length=length, ids_crc32=crc)
            if with_ids:
                out["ids"] = [np.frombuffer(x, "<u4").astype("i8") for x in part]
            yield out

    given = docs.select(
        F.col(id_col).alias("_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"),
    )
    schema = f"_id {given.schema['_id'].dataType.simpleString()}, {PIECES}"
    if with_ids:
        schema += ", ids array<long>"
    return given.mapInPandas(cut, schema).withColumnRenamed("_id", id_col)


def fit_patterns(
    bins: np.ndarray, capacity: int, parts: int = PARTS
) -> list[tuple[tuple[int, ...], int]]:
    """Repeat counts of patterns that fill ``capacity`` exactly, by non-negative least squares.

    ``bins[i]`` is the number of pieces of size ``i``.  Active-set method of Lawson and Hanson; a
    pattern has at most ``parts`` entries, so gradients are sums of a few residuals.
    """
    present = np.flatnonzero(bins)
    known = np.zeros(capacity + 1, bool)
    known[present] = True
    patterns: list[tuple[int, ...]] = []

    def enumerate_patterns(head: tuple[int, ...], left: int, low: int) -> None:
        if left >= low and known[left]:
            patterns.append((*head, left))
        if len(head) + 1 < parts:
            for size in present[(present >= low) & (present <= left // 2)].tolist():
                enumerate_patterns((*head, size), left - size, size)

    enumerate_patterns((), capacity, 1)
    if not patterns:
        return []
    width = max(map(len, patterns))
    padded = np.array([p + (0,) * (width - len(p)) for p in patterns])
    target = bins.astype(float)
    target[0] = 0.0
    total = target.sum()
    row_of = np.zeros(capacity + 1, int)
    row_of[present] = np.arange(len(present))
    b = target[present]
    columns = np.zeros((len(present), 0))
    active: list[int] = []
    x = np.zeros(0)

    def column(i: int) -> np.ndarray:
        out = np.zeros(len(present))
        np.add.at(out, row_of[list(patterns[i])], 1.0)
        return out

    def residual() -> np.ndarray:
        out = np.zeros(capacity + 1)
        out[present] = b - columns @ x
        return out

    for _ in range(4 * len(present) + 10):
        gradient = residual()[padded].sum(axis=1)
        gradient[active] = -np.inf
        best = int(gradient.argmax())
        if gradient[best] <= 1e-6 * max(1.0, total):
            break
        active.append(best)
        columns = np.column_stack([columns, column(best)])
        x = np.append(x, 0.0)
        while True:
            normal = columns.T @ columns + 1e-9 * np.eye(len(active))
            solved = np.linalg.solve(normal, columns.T @ b)
            if solved.min() > 0:
                x = solved
                break
            down = solved <= 0
            share = (x[down] / np.maximum(x[down] - solved[down], 1e-30)).min()
            x = x + share * (solved - x)
            stay = x > 1e-9
            stay[down & (x <= x[down].min() + 1e-12)] = False
            if stay.all():
                stay[int(x.argmin())] = False
            active = [a for a, s in zip(active, stay, strict=True) if s]
            columns, x = columns[:, stay], x[stay]
            if not active:
                break
        if not active:
            break
    return [(patterns[i], int(n)) for i, n in zip(active, x, strict=True) if n >= 1]


def best_fit_patterns(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing over a histogram: ``({length: pieces}, repeats)`` that use it all up.

    A sequence starts with the longest piece left and takes the longest that fits, again and again.
    It is repeated as often as its pieces allow, so each step uses up a length.
    """
    left = {int(size): int(counts[size]) for size in np.flatnonzero(counts) if size}
    sizes = np.array(sorted(left))
    n_left = np.array([left[int(s)] for s in sizes])
    out = []
    while len(sizes):
        room, pattern, available = capacity, {}, n_left.copy()
        at = len(sizes) - 1
        while at >= 0:
            if sizes[at] > room or not available[at]:
                at = min(at - 1, int(np.searchsorted(sizes, room, "right")) - 1)
                continue
            take = int(min(room // sizes[at], available[at]))
            if len(pattern) == 0:
                take = max(1, take)
            pattern[at] = pattern.get(at, 0) + take
            available[at] -= take
            room -= take * int(sizes[at])
        repeats = min(int(n_left[i]) // n for i, n in pattern.items())
        for i, n in pattern.items():
            n_left[i] -= repeats * n
        out.append(({int(sizes[i]): n for i, n in pattern.items()}, repeats))
        keep = n_left > 0
        sizes, n_left = sizes[keep], n_left[keep]
    return out


def plan_packing(counts: np.ndarray, capacity: int, width: int = WIDTH) -> list[tuple[int, ...]]:
    """Places for all pieces of a histogram of lengths.

    Rows ``(length, lo, hi, shift, per, first, place)``: the piece of rank ``r`` in ``lo … hi - 1``
    of its length is number ``t = r - lo + shift`` of its kind; it goes to sequence
    ``first + t div per``, at place ``place + t % per``.
    """
    counts = np.asarray(counts, dtype=np.int64)
    sizes = np.arange(capacity + 1)
    bin_of = -(-sizes // width)
    full = capacity // width
    bins = np.bincount(bin_of, weights=counts, minlength=full + 1).astype(np.int64)[: full + 1]
    ranges: list[tuple[int, ...]] = []
    used = np.zeros(full + 1, np.int64)
    first = 0
    # Longer pieces of a bin come first, so the rank in the bin follows from that in the length.
    offset = np.zeros(capacity + 1, np.int64)
    for size in range(capacity - 1, 0, -1):
        if bin_of[size] == bin_of[size + 1]:
            offset[size] = offset[size + 1] + counts[size + 1]
    for pattern, wanted in fit_patterns(bins, full):
        kinds = {size: pattern.count(size) for size in pattern}
        repeats = min([wanted, *((bins[size] - used[size]) // n for size, n in kinds.items())])
        if repeats < 1:
            continue
        place = 0
        for size, n in kinds.items():
            lo, hi = int(used[size]), int(used[size] + repeats * n)
            for length in range(size * width, (size - 1) * width, -1):
                if not 1 <= length <= capacity:
                    continue
                start = int(offset[length])
                a, b = max(lo, start), min(hi, start + int(counts[length]))
                if a < b:
                    ranges.append((length, a - start, b - start, a - lo, n, first, place))
            used[size] = hi
            place += n
        first += int(repeats)
    gone = np.clip(used[bin_of] - offset, 0, counts)
    for pattern, repeats in best_fit_patterns(counts - gone, capacity):
        place = 0
        for length, n in pattern.items():
            lo = int(gone[length])
            ranges.append((length, lo, lo + repeats * n, 0, n, first, place))
            gone[length] += repeats * n
            place += n
        first += repeats
    return ranges


def pack(
    pieces: DataFrame, order: list[str], capacity: int = CAPACITY, width: int = WIDTH
) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces of a ``length`` of at most ``capacity``.

    ``order`` names columns that give the pieces of a length a fixed order.  ``pieces`` is read
    several times and should be a stored table.
    """
    spark = pieces.sparkSession
    histogram = pieces.groupBy("length").count().collect()  # at most `capacity` rows
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram:
        counts[length] = n
    plan = spark.createDataFrame(
        plan_packing(counts, capacity, width),
        "length long, lo long, hi long, shift long, per long, first long, place long",
    )
    bucket = F.pmod(F.xxhash64(*order), F.lit(buckets_for(int(counts.sum()))))
    ranked = running_start(pieces, ["length"], bucket, [F.col(c) for c in order], F.lit(1), "rank")
    # A few rows for each length, so its size is bounded by the capacity.
    placed = ranked.join(F.broadcast(plan), "length").where("rank >= lo AND rank < hi").selectExpr(
        *pieces.columns,
        "first + (rank - lo + shift) div per AS sequence_id",
        "place + (rank - lo + shift) % per AS place",
    )
    # At most `capacity` pieces share a sequence.
    before = "sum(length) OVER (PARTITION BY sequence_id ORDER BY place ROWS BETWEEN UNBOUNDED " \
        "PRECEDING AND 1 PRECEDING)"
    return placed.selectExpr(
        *pieces.columns, "sequence_id", f"coalesce({before}, 0L) AS offset"
    )


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    width: int = WIDTH,
) -> DataFrame:
    """Pieces of all documents with their places: id, ``piece, start, length, ids_crc32,
    sequence_id, offset``.  The ids themselves come from `token_pieces` again, by id and piece."""
    pieces = settle(token_pieces(docs, tokenizer, id_col, text_col, capacity, end_id), "pieces")
    return pack(pieces, [id_col, "piece", "ids_crc32"], capacity, width)
