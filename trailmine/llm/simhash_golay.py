"""Near-duplicates by SimHash, joined on fuzzy keys from the binary Golay code.

A fingerprint has 64 bits, of which at most two may differ.  It is cut into segments of 23, 23 and
18 bits.  Two errors cannot hit all three segments, so one of them is equal in both fingerprints,
and any other one differs in at most two bits.

The Golay code of 23 bits has a codeword within three bits of every word.  All codewords within four
bits of a segment, six at most, are its fuzzy indices: two segments that differ in two bits have a
word between them, one bit from each, and its codeword is an index of both.  So a fingerprint has the
keys (segment, an index of the next segment), 18 at most, and any two that link share a key.

1. Equal fingerprints are one class; only distinct ones go on.
2. In each bucket of a key all fingerprints are verified against each other, and edges are kept to
   the lowest of each connected part, never pairs.
3. Members of a bucket of more than ``BUCKET`` fingerprints take another exact way instead: each
   gives itself and the 64 fingerprints at one bit as keys.  Two fingerprints differ in at most two
   bits exactly if they share such a key, and a key has at most 65 members, all linked.
4. Components of the edges.

Defined results: NULL, empty and blank texts have fingerprint zero, which links like any other;
rows of one id are rows of their own; ``component_id`` is NULL where no row reached has an id.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmine.llm.common import settle
from trailmine.llm.components import components

WORDS = 3
SEED = 42
BITS = 64
DISTANCE = 2
BUCKET = 256
# Shingles worked on at once.
CHUNK = 50_000

# Fixed value: the generator polynomial of the binary Golay code of 23 bits, 12 of them data.
GENERATOR = 0xC75
SEGMENT, CHECK = 23, 11
# First bit and width of the three segments.
SEGMENTS = ((41, 23), (18, 23), (0, 18))


def _remainder(word: int) -> int:
    for bit in range(SEGMENT - 1, CHECK - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECK)
    return word


def _patterns() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the data bits, and for each remainder the up to six patterns of at most four
    bits that leave it, -1 where there are fewer."""
    high = np.array([_remainder(x << CHECK) for x in range(1 << (SEGMENT - CHECK))], np.int64)
    single = [_remainder(1 << i) for i in range(SEGMENT)]
    near: list[list[int]] = [[] for _ in range(1 << CHECK)]
    for weight in range(5):
        for bits in combinations(range(SEGMENT), weight):
            rest = pattern = 0
            for i in bits:
                rest ^= single[i]
                pattern |= 1 << i
            near[rest].append(pattern)
    out = np.full((1 << CHECK, 6), -1, np.int64)
    for rest, found in enumerate(near):
        out[rest, : len(found)] = found
    return high, out


_HIGH, _NEAR = _patterns()


def fuzzy_indices(segment: np.ndarray) -> np.ndarray:
    """Indices of the codewords within four bits of each segment: six columns, -1 where fewer."""
    rest = _HIGH[segment >> CHECK] ^ (segment & ((1 << CHECK) - 1))
    pattern = _NEAR[rest]
    return np.where(pattern < 0, -1, (segment[:, None] ^ pattern) >> CHECK)


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys, and the position of the fingerprint of each."""
    unsigned = prints.view(np.uint64)
    parts = [
        ((unsigned >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64)
        for at, width in SEGMENTS
    ]
    keys, rows = [], []
    for i, part in enumerate(parts):
        index = fuzzy_indices(parts[(i + 1) % 3])
        key = (((i << SEGMENT) | part)[:, None] << (SEGMENT - CHECK)) | index
        used = index >= 0
        keys.append(key[used])
        rows.append(np.nonzero(used)[0])
    return np.concatenate(keys), np.concatenate(rows)


def fingerprint(text: str | None) -> int:
    """The SimHash of a text's shingles, repeats included, as a signed integer."""
    # Lower-cases A to Z and splits at the six characters of ASCII white space.
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    width = min(WORDS, len(words))
    n = len(words) - width + 1
    shingles = map(b" ".join, zip(*[words[i:] for i in range(width)]))
    ones = np.zeros(BITS, np.int64)
    digests = map(xxhash.xxh64_digest, shingles, repeat(SEED))
    for _ in range(0, n, CHUNK):
        part = b"".join(islice(digests, CHUNK))
        bits = np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    # The first bit of a digest is the highest.
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id, print`` of each row of ``docs``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[["_id"]].copy()
            out["print"] = np.array([fingerprint(t) for t in batch["_text"]], np.int64)
            yield out

    given = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = given.schema["_id"].dataType.simpleString()
    return given.mapInPandas(run, f"_id {kind}, print long")


def _keyed(prints: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = batch["print"].to_numpy(np.int64)
            keys, rows = fuzzy_keys(values)
            yield pd.DataFrame({"key": keys, "print": values[rows]})

    return prints.mapInPandas(run, "key long, print long")


def _lowest_linked(prints: np.ndarray) -> np.ndarray:
    """For each of sorted fingerprints the lowest that links lead to among them."""
    unsigned = prints.view(np.uint64)
    near = np.bitwise_count(unsigned[:, None] ^ unsigned) <= DISTANCE
    low = near.argmax(axis=1)
    while True:
        lower = np.where(near, low, len(low)).min(axis=1)
        lower = lower[lower]
        if (lower == low).all():
            return prints[low]
        low = lower


def _bucket_edges(keyed: DataFrame) -> DataFrame:
    """``u, v``: edges inside buckets; ``v`` is NULL for ``u`` in a bucket of too many.

    Rows come in the order of buckets, so no more than ``BUCKET`` rows and a batch are held.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held_key, held, large = None, np.empty(0, np.int64), False
        us, vs, hot = [], [], []

        def close(prints: np.ndarray, is_large: bool) -> None:
            if is_large or len(prints) > BUCKET:
                hot.append(prints)
            elif len(prints) > 1:
                low = _lowest_linked(prints)
                us.append(prints[low != prints])
                vs.append(low[low != prints])

        def take() -> pd.DataFrame:
            none = [np.empty(0, np.int64)]
            linked = pd.DataFrame({"u": np.concatenate(none + us), "v": np.concatenate(none + vs)})
            many = pd.DataFrame({"u": np.concatenate(none + hot)})
            many["v"] = pd.array([None] * len(many), "Int64")
            for rows in (us, vs, hot):
                rows.clear()
            return pd.concat([linked.astype({"v": "Int64"}), many]).drop_duplicates()

        for batch in batches:
            keys, prints = batch["key"].to_numpy(np.int64), batch["print"].to_numpy(np.int64)
            if not len(keys):
                continue
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            bounds = [0, *cuts.tolist(), len(keys)]
            for a, b in zip(bounds, bounds[1:]):
                if b - a == 1 and a > 0 and b < len(keys):
                    continue  # alone in its bucket
                if keys[a] != held_key:
                    close(held, large)
                    held_key, held, large = int(keys[a]), np.empty(0, np.int64), False
                held = np.concatenate([held, prints[a:b]])
                if len(held) > BUCKET:
                    hot.append(held)
                    held, large = np.empty(0, np.int64), True
            yield take()
        close(held, large)
        yield take()

    ordered = keyed.repartition("key").sortWithinPartitions("key", "print")
    return ordered.mapInPandas(run, "u long, v long")


def _ball_edges(prints: DataFrame) -> DataFrame:
    """``u, v``: each fingerprint with the lowest at one bit or none from a common one."""
    around = prints.selectExpr(
        "print",
        f"explode(concat(array(print), transform(sequence(0, {BITS - 1}), "
        "i -> print ^ shiftleft(1L, i)))) AS centre",
    )
    # At most 65 members, as the fingerprints are distinct.
    balls = around.groupBy("centre").agg(F.collect_list("print").alias("members"))
    return balls.where("size(members) > 1").selectExpr(
        "explode(members) AS u", "array_min(members) AS v"
    ).where("u <> v").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each row of ``docs``: id, ``fingerprint`` in hexadecimal, ``component_id``, the
    lowest id that links lead to."""
    prints = settle(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = settle(
        prints.groupBy("print").agg(F.min("_id").alias("low")), "fingerprint-classes"
    )
    found = settle(_bucket_edges(_keyed(classes.select("print"))), "bucket-edges")
    many = settle(
        found.where("v IS NULL").select(F.col("u").alias("print")).distinct(), "large-buckets"
    )
    edges = found.where("v IS NOT NULL").select("u", "v").union(_ball_edges(many))
    label = components(edges)
    grouped = classes.join(
        label.withColumnRenamed("node", "print"), "print", "left"
    ).withColumn("component", F.coalesce("component", "print"))
    names = grouped.groupBy("component").agg(F.min("low").alias("component_id"))
    named = settle(grouped.join(names, "component").select("print", "component_id"), "names")
    return prints.join(named, "print").select(
        F.col("_id").alias(id_col),
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
