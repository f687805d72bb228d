"""Join of documents whose sets of word shingles have a Jaccard similarity of at least 0.8.

The result is exact, up to equal 64-bit hashes of different shingles or sets.

1. One pass over the texts gives each document the size of its set and a digest of it.  Documents of
   equal sets are one class from here on.  The same pass counts shingles that occur in several sets
   of a batch; the most frequent of them, at most ``MAX_FREQUENT``, are the frequent shingles.
2. All shingles have one order: others by hash, then frequent ones by rising count.  Two similar sets
   share a shingle among the first ``n - ceil(0.8 n) + 1`` of each, their prefixes.  Prefixes are
   turned into index lists, one for each shingle, of ``(class, size, position)``.
3. Of lists with at most ``SHORT`` entries all pairs count how many prefix shingles they share; with
   the shingles behind the prefixes that bounds their overlap, and few pairs are left.  In longer
   lists, read in order of size, each entry is compared with the leader of its stretch and with its
   predecessor, so a group of near copies costs comparisons in proportion to its entries, not to its
   pairs.  Before any set is stored, the number of shared lists and the shingles behind fixed marks
   of the order bound the overlap: pairs, and entries of long lists, that have a phrase in common by
   chance drop out.  Comparing means intersecting the whole sets.  A list of more than ``LIST_CHUNK`` entries
   is dealt to several tasks, each with the first leader.
4. The entry of a long list with the most links against other comparisons is its hub; all entries
   are compared with it.  Links so far give components.
5. Long lists with several components are read again for pairs across components.  Entries are in
   blocks by position; the position bounds the overlap that is possible, a block whose best entry
   cannot reach the threshold is skipped whole, and entries without any possible partner of another
   component drop out, by places and by the overlaps with the hub.  The answers of the others are derived from their hub's: with the difference
   of each set to the hub, shingles that it lacks or has beside it, the overlap of two sets follows
   from sizes and the number of differences that they share.  Similar sets, of which at most one is
   similar to the hub, must share some, so differences are indexed by a prefix of their own, rare ones
   first, and only pairs that share one there, and whose positions allow enough, are compared.  A
   task gets the entries of one hub with all their differences, each once, finds the pairs, compares
   them and returns links alone, fewer than entries.  Hubs of many entries are cut into chunks, and
   two chunks meet in a task of their own if they have entries of different components in one list.

Which shingles count as frequent changes the work alone: any one order gives the same result.

Defined results: NULL and empty texts have no shingles and link with nothing; NULL ids count as
members of classes but name no component; equal rows are in one class.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmine.llm.bloom import split_by_keys
from trailmine.llm.common import gives_back, packed, settle, use_cache
from trailmine.llm.components import components

WORDS = 5
MAX_FREQUENT = 1 << 18
CACHED_WORDS = 100_000
# Sets that a task has at once beside those of a batch that it counts, and pairs that it holds.
SETS_AT_ONCE = 1_000
HELD_PAIRS = 100_000
BLOCK = 64
LIST_CHUNK = 20_000
# Entries of a hub, each with all of its differences, that are in a chunk, and bytes of these.
DIFFERENCE_CHUNK = 2_000
DIFFERENCE_BYTES = 1 << 23
SHORT = 8
# Index entries keep 48 bits of a shingle and 16 of its position in one number.
PLACE_BITS = 16
# Shares of all hash values, up to which the shingles of a set that are not frequent are counted.
MARKS = (0.125, 0.15, 0.175, 0.2, 0.25, 0.35, 0.5, 0.75)
# Similar means NUM * union <= DEN * intersection.
NUM, DEN = 80, 100
# Up to so many narrow rows, of 16 bytes, a table is broadcast; else both sides are shuffled.
MAX_BROADCAST = 2_000_000
# Bytes of a shingle's hash that are compared in a pair of sets.
KEPT_BYTES = 6
SIMILAR = f"{NUM + DEN} * both >= {NUM} * (n_u + n_v)"

_MARKS = np.array([int(x * 1000) * (1 << 64) // 1000 - (1 << 63) for x in MARKS], np.int64)
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(1, 64)], np.uint64)


class _WordHashes(dict):
    """Hashes of words, with a cache that starts anew when it is full."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= CACHED_WORDS:
            self.clear()
        if len(word) <= 40:
            self[word] = value
        return value


_hashes = _WordHashes()


def _use_hashes() -> None:
    use_cache("shingles", _hashes.clear)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles, as signed integers."""
    # Lower-cases A to Z and splits at the six characters of ASCII white space.
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return np.empty(0, np.int64)
    get = _hashes.__getitem__
    hashed = np.fromiter(map(get, tokens), np.uint64, len(tokens))
    width = min(words, len(tokens))
    n = len(tokens) - width + 1
    total = np.full(n, width, np.uint64)
    for i in range(width):
        total += hashed[i : i + n] * _FACTORS[i]
    return np.unique(_mixed(total).view(np.int64))


def digest(values: np.ndarray) -> int:
    """A signed 64-bit digest of a set."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(values.tobytes())).view(np.int64)))


def needed(n: int | np.ndarray) -> int | np.ndarray:
    """The least overlap with any set that is similar to a set of size ``n``."""
    return -(-NUM * n // DEN)


def repeated(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The values that several of the sets have, sorted, and how many have each.

    Beside the sets one array of all values is held, and what is found.
    """
    values = np.concatenate([np.empty(0, np.int64), *sets])
    values.sort()
    same = np.zeros(len(values) + 1, bool)
    np.equal(values[1:], values[:-1], out=same[1:-1])
    # Ends of stretches of equal values: where "same as before" changes.
    first = np.flatnonzero(~same[:-1] & same[1:])
    last = np.flatnonzero(same[:-1] & ~same[1:])
    return values[first], last - first + 1


def _first_pass(docs: DataFrame, words: int) -> DataFrame:
    """Rows of documents, ``_id, n, digest``, and of shingle counts, ``shingle, seen``."""

    @gives_back
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _use_hashes()
        for batch in batches:
            # Of equal sets, one.
            sets: dict[int, np.ndarray] = {}
            sizes, digests = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for i, text in enumerate(batch["_text"]):
                values = shingle_set(text, words)
                sizes[i], digests[i] = len(values), digest(values)
                sets.setdefault(int(digests[i]), values)
            out = batch[["_id"]].copy()
            out["n"] = sizes
            out["digest"] = digests
            out["shingle"] = pd.array([None] * len(out), "Int64")
            out["seen"] = pd.array([None] * len(out), "Int64")
            yield out
            found, seen = repeated(list(sets.values()))
            del sets
            if len(found):
                more = pd.DataFrame({"shingle": found, "seen": seen})
                more["_id"] = None
                more["n"] = pd.array([None] * len(more), "Int64")
                more["digest"] = pd.array([None] * len(more), "Int64")
                yield more[out.columns]

    kind = docs.schema["_id"].dataType.simpleString()
    return docs.mapInPandas(run, f"_id {kind}, n long, digest long, shingle long, seen long")


def _prefixes(docs: DataFrame, frequent: np.ndarray, counts: np.ndarray, words: int) -> DataFrame:
    """``digest, n, n_others, prefix, rest`` of each document of at least four shingles.

    Smaller sets are similar to equal sets alone.  ``frequent`` is sorted; the first ``n_others``
    shingles of a prefix are not in it.  ``rest`` has the number of shingles behind each mark, of
    ``MARKS`` and the end of those that are not frequent, as far as the prefix has all before it.
    """

    @gives_back
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _use_hashes()
        seen: set[int] = set()
        for batch in batches:
            rows = []
            for text in batch["_text"]:
                values = shingle_set(text, words)
                n = len(values)
                if n < 4:
                    continue
                name = digest(values)
                if name in seen:
                    continue
                seen.add(name)
                wanted = n - needed(n) + 1
                at = np.minimum(np.searchsorted(frequent, values), max(len(frequent) - 1, 0))
                is_frequent = (
                    frequent[at] == values if len(frequent) else np.zeros(n, bool)
                )
                others = values[~is_frequent]
                before = np.append(np.searchsorted(others, _MARKS), len(others))
                rest_behind = (n - before[before <= wanted]).astype(np.int32)
                prefix = others[:wanted]
                n_others = len(prefix)
                if len(prefix) < wanted:
                    rest = values[is_frequent]
                    order = np.lexsort((rest, counts[at[is_frequent]]))
                    prefix = np.concatenate([prefix, rest[order][: wanted - len(prefix)]])
                # A copy, so that the array it is a part of can go.
                rows.append((name, n, n_others, prefix.copy(), rest_behind))
            if len(seen) > 200_000:
                seen.clear()
            yield pd.DataFrame(rows, columns=["digest", "n", "n_others", "prefix", "rest"])

    return docs.mapInPandas(
        run, "digest long, n long, n_others int, prefix array<long>, rest array<int>")


def _runs(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[list[np.ndarray]]:
    """Columns of each run of at least two rows alike in the first two columns, from sorted rows."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        arrays = [batch[c].to_numpy() for c in columns]
        if held is not None:
            arrays = [np.concatenate(pair) for pair in zip(held, arrays, strict=True)]
        first, second = arrays[:2]
        if not len(first):
            continue
        cuts = np.flatnonzero((first[1:] != first[:-1]) | (second[1:] != second[:-1])) + 1
        starts = np.concatenate([[0], cuts])
        ends = np.concatenate([cuts, [len(first)]])
        for i in np.flatnonzero(ends[:-1] - starts[:-1] > 1).tolist():
            yield [x[starts[i] : ends[i]] for x in arrays]
        held = [x[starts[-1] :] for x in arrays]
    if held is not None and len(held[0]) > 1:
        yield held


def _shared(lists: DataFrame) -> DataFrame:
    """Entries of lists that have at least two.  Looks at neighbours only and holds one batch."""

    @gives_back
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: pd.DataFrame | None = None
        last_shared = False
        for batch in batches:
            if last is not None:
                batch = pd.concat([last, batch], ignore_index=True)
            key = batch["entry"].to_numpy() >> PLACE_BITS
            if not len(key):
                continue
            same = key[1:] == key[:-1]
            shared = np.concatenate([[last_shared], same]) | np.concatenate([same, [False]])
            yield batch[:-1][shared[:-1]]
            last, last_shared = batch[-1:], bool(shared[-1])
        if last is not None and last_shared:
            yield last

    shingle = F.shiftright("entry", PLACE_BITS)
    ordered = lists.repartition(shingle).sortWithinPartitions("entry")
    return ordered.mapInPandas(run, "entry long, digest long")


def _possible(n1: int, rest1: int, n2: np.ndarray, rest2: np.ndarray) -> np.ndarray:
    """Whether sets can be similar that first meet with ``rest`` shingles left behind the place."""
    small, large = np.minimum(n1, n2), np.maximum(n1, n2)
    overlap = 1 + np.minimum(rest1, rest2)
    return (NUM * large <= DEN * small) & ((NUM + DEN) * overlap >= NUM * (n1 + n2))


def _near_pairs(lists: DataFrame, many: DataFrame) -> DataFrame:
    """``u, v, short``: in how many short lists a pair is, maybe 0 if it is to be compared for a long
    one.

    ``many`` has the ``length`` of each list of more than ``LIST_CHUNK`` entries, maybe of others.
    """

    @gives_back
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        chosen: set[tuple[int, int]] = set()

        def flush() -> pd.DataFrame:
            rows = [(u, v, n) for (u, v), n in counts.items()]
            rows += [(u, v, 0) for u, v in chosen]
            counts.clear()
            chosen.clear()
            return pd.DataFrame(rows, columns=["u", "v", "short"]).astype("int64")

        columns = ["shingle", "salt", "digest", "n", "at"]
        for _, _, digests, sizes, places in _runs(batches, columns):
            size, name = sizes.tolist(), digests.tolist()
            if len(name) <= SHORT:
                for i in range(1, len(name)):
                    for j in range(i):
                        # In order of size, so the first is the smaller.
                        if NUM * size[i] <= DEN * size[j]:
                            a, b = name[j], name[i]
                            counts[(a, b) if a < b else (b, a)] += 1
            else:
                rest = (sizes - places - 1).tolist()
                lead = 0
                for i in range(1, len(name)):
                    if NUM * size[i] > DEN * size[lead]:
                        lead = i
                        continue
                    for j in {lead, i - 1}:
                        overlap = 1 + min(rest[i], rest[j])
                        total = NUM * (size[i] + size[j])
                        if (NUM + DEN) * overlap >= total and name[i] != name[j]:
                            a, b = name[j], name[i]
                            chosen.add((a, b) if a < b else (b, a))
            if len(counts) + len(chosen) > HELD_PAIRS:
                yield flush()
        yield flush()

    chunks = f"int(ceil(length / {LIST_CHUNK}))"
    long_ = settle(
        lists.join(many.where(f"length > {LIST_CHUNK}"), "shingle").groupBy("shingle", "length")
        .agg(F.min(F.struct("n", "digest", "at")).alias("head")),
        "list-heads",
    )
    salted = lists.join(long_, "shingle", "left").selectExpr(
        "shingle", f"int(coalesce(pmod(xxhash64(digest), {chunks}), 0)) AS salt",
        "digest", "n", "at",
    )
    heads = long_.selectExpr(
        "shingle", f"explode(sequence(0, {chunks} - 1)) AS salt", "head.digest", "head.n", "head.at"
    )
    if heads.take(1):
        salted = salted.union(heads).distinct()
    ordered = salted.repartition("shingle", "salt").sortWithinPartitions(
        "shingle", "salt", "n", "digest"
    )
    found = ordered.mapInPandas(run, "u long, v long, short long")
    return found.groupBy("u", "v").agg(F.sum("short").alias("short"))


def _known_sets(found: DataFrame, long_lists: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``digest, n, rest, behind, n_long`` of the sets in pairs or long lists.

    ``n_long`` is the number of long lists that a set is in.
    """
    counts = long_lists.selectExpr("digest", "1L AS n_long").union(
        found.selectExpr("u", "0L")
    ).union(found.selectExpr("v", "0L")).groupBy("digest").agg(F.sum("n_long").alias("n_long"))
    return prefixes.select("digest", "n", "rest").join(counts, "digest").selectExpr(
        "digest", "n", "rest", f"({NUM} * n + {DEN - 1}) div {DEN} - 1 AS behind", "n_long"
    )


def _worth_comparing(found: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs of `_near_pairs` that can be similar.

    Up to the last shingle of the prefix that ends first, two sets share what their prefixes share;
    behind it at most the rest of that set.  The same holds for each mark that both prefixes reach,
    behind which it is at most the smaller rest.
    """
    a = known.selectExpr(
        "digest AS u", "n AS n_u", "n_long AS long_u", "behind AS behind_u", "rest AS rest_u")
    b = known.selectExpr(
        "digest AS v", "n AS n_v", "n_long AS long_v", "behind AS behind_v", "rest AS rest_v")
    # The shorter array is filled up with NULL; array_min and least pass over it.
    marks = "zip_with(rest_u, rest_v, (a, b) -> IF(a IS NULL OR b IS NULL, NULL, least(a, b)))"
    behind = f"least(greatest(behind_u, behind_v), bigint(array_min({marks})))"
    return (
        found.join(a, "u").join(b, "v")
        .where(f"{NUM + DEN} * (short + least(long_u, long_v) + {behind}) >= {NUM} * (n_u + n_v)")
        .select("u", "v")
    )


def _may_be_similar(size: np.ndarray, shared: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Which entries of a list can be similar to any of it, themselves included.

    ``shared`` bounds what each shares with another up to a mark that both reach; ``rest`` has a column
    for each mark, and -1 where it is not reached.  For each mark that an entry reaches there must be
    an entry that does not reach it, or one with which the overlap can suffice.
    """
    order = np.argsort(size, kind="stable")
    ascending = size[order]
    kept = np.ones(len(size), bool)
    least, most = needed(size), DEN * size // NUM
    for left in rest.T:
        reached = left >= 0
        if not reached.any():
            break  # nor is any mark behind it
        score = np.where(reached, (NUM + DEN) * left - NUM * size, np.iinfo(np.int64).min)
        best = np.maximum.accumulate(score[order])
        # Of entries up to the largest size with which what is left of this one can suffice.
        largest = np.minimum(most, (NUM + DEN) * (left + shared) // NUM - size)
        upto = np.searchsorted(ascending, largest, "right")
        fits = (upto > 0) & (best[upto - 1] >= NUM * size - (NUM + DEN) * shared)
        free = np.sort(size[~reached])
        fits |= np.searchsorted(free, most, "right") > np.searchsorted(free, least, "left")
        kept &= fits | ~reached
    return kept


def _likely_entries(long_lists: DataFrame, known: DataFrame) -> DataFrame:
    """``shingle, digest, n, at``: entries of long lists that can be similar to others there.

    Pairs that share a short list are decided by `_worth_comparing` and a comparison, so here two sets
    share long lists alone.  Texts that have a phrase in common by chance drop out, before their sets
    are stored or held against a hub.  Lists of more than ``LIST_CHUNK`` entries are taken whole.
    """

    @gives_back
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["shingle", "shingle", "digest", "n", "at", "shared", "rest"]
        for shingle, _, name, size, at, shared, given in _runs(batches, columns):
            rest = np.full((len(name), len(MARKS) + 1), -1, np.int64)
            reached = np.array([len(x) for x in given])
            rest[np.arange(rest.shape[1]) < reached[:, None]] = np.concatenate(list(given))
            kept = _may_be_similar(size, shared, rest)
            if kept.sum() > 1:
                yield pd.DataFrame({
                    "shingle": shingle[kept], "digest": name[kept], "n": size[kept], "at": at[kept]})

    told = known.selectExpr("digest", "n_long AS shared", "rest")
    ordered = (
        long_lists.where(f"length <= {LIST_CHUNK}").join(told, "digest")
        .repartition("shingle").sortWithinPartitions("shingle")
    )
    return ordered.mapInPandas(run, "shingle long, digest long, n long, at int").union(
        long_lists.where(f"length > {LIST_CHUNK}").select("shingle", "digest", "n", "at")
    )


def _hubs(lists: DataFrame, near: DataFrame) -> DataFrame:
    """``shingle, hub, hub_n`` of each long list."""
    both = near.selectExpr("u AS digest", f"IF({SIMILAR}, 1, -1) AS score").union(
        near.selectExpr("v AS digest", f"IF({SIMILAR}, 1, -1) AS score")
    )
    score = both.groupBy("digest").agg(F.sum("score").alias("score"))
    return (
        lists.join(score, "digest", "left")
        .groupBy("shingle")
        .agg(F.max(F.struct("score", "digest", "n")).alias("hub"))
        .selectExpr("shingle", "hub.digest AS hub", "hub.n AS hub_n")
    )


def _hub_pairs(lists: DataFrame, hubs: DataFrame, near: DataFrame) -> DataFrame:
    """Pairs of the hub of each long list with its entries, of those not compared yet."""
    small, large = "least(n, hub_n)", "greatest(n, hub_n)"
    return (
        lists.join(hubs, "shingle")
        .where(f"hub <> digest AND {NUM} * {large} <= {DEN} * {small}")
        .selectExpr("least(hub, digest) AS u", "greatest(hub, digest) AS v")
        .distinct()
        .join(near, ["u", "v"], "left_anti")
    )


def _with_partners(name: np.ndarray, size: np.ndarray, place: np.ndarray, component: np.ndarray,
                   both: np.ndarray) -> np.ndarray:
    """Entries of a list that can be similar to one of another component, by their places.

    ``both`` is the overlap with the list's hub, -1 where it is not known.  Two sets share at most the
    smaller one of these, and of what they have beside the hub again at most the smaller.
    """
    order = np.argsort(place, kind="stable")
    name, size, place, component, both = (
        x[order] for x in (name, size, place, component, both))
    rest = size - place - 1
    starts = np.arange(0, len(name), BLOCK)
    most_rest = np.maximum.reduceat(rest, starts)
    least_size = np.minimum.reduceat(size, starts)
    most_size = np.maximum.reduceat(size, starts)
    low = np.minimum.reduceat(component, starts)
    high = np.maximum.reduceat(component, starts)
    kept = np.zeros(len(name), bool)
    for i in range(len(name)):
        if kept[i]:
            continue
        n, left, hub = int(size[i]), int(rest[i]), int(both[i])
        alive = (
            ((NUM + DEN) * (1 + np.minimum(left, most_rest)) >= NUM * (n + least_size))
            & (NUM * n <= DEN * most_size)
            & (NUM * least_size <= DEN * n)
            & ((low != component[i]) | (high != component[i]))
        )
        for block in np.flatnonzero(alive).tolist():
            cut = slice(block * BLOCK, (block + 1) * BLOCK)
            fits = _possible(n, left, size[cut], rest[cut]) & (component[cut] != component[i])
            if hub >= 0:
                most = np.minimum(hub, both[cut]) + np.minimum(n - hub, size[cut] - both[cut])
                fits &= (both[cut] < 0) | ((NUM + DEN) * most >= NUM * (n + size[cut]))
            if fits.any():
                kept[i] = True
                kept[cut] |= fits
                break
    return name[kept]


def _members_of_hubs(lists: DataFrame, hubs: DataFrame, near: DataFrame) -> DataFrame:
    """``hub, digest``: entries of lists of several components that maybe have a link there.

    ``lists`` has ``component``, ``near`` the overlaps that are known.  Lists of more than
    ``LIST_CHUNK`` entries are taken whole.
    """

    @gives_back
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["shingle", "shingle", "digest", "n", "at", "component", "both"]
        for run_ in _runs(batches, columns):
            kept = _with_partners(*run_[2:])
            yield pd.DataFrame({"shingle": np.full(len(kept), run_[0][0]), "digest": kept})

    mixed = settle(
        lists.groupBy("shingle").agg(
            F.count(F.lit(1)).alias("length"),
            F.min("component").alias("low"), F.max("component").alias("high"),
        ).where("low <> high").select("shingle", "length").join(hubs, "shingle"),
        "mixed-lists",
    )
    entries = lists.join(mixed.select("shingle", "length", "hub"), "shingle")
    answers = near.selectExpr("u", "v", "both AS answer")
    ordered = (
        entries.where(f"length <= {LIST_CHUNK}").drop("length")
        .withColumns({"u": F.least("hub", "digest"), "v": F.greatest("hub", "digest")})
        .join(answers, ["u", "v"], "left")
        .withColumn("both", F.expr("IF(u = v, n, coalesce(answer, -1L))")).drop("u", "v", "answer")
        .repartition("shingle").sortWithinPartitions("shingle")
    )
    kept = ordered.mapInPandas(run, "shingle long, digest long").union(
        entries.where(f"length > {LIST_CHUNK}").select("shingle", "digest")
    )
    return (
        kept.join(mixed, "shingle").where("hub <> digest")
        .select("hub", "digest").distinct()
    )


def _counted(values: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Counts of frequent shingles, 1 for others."""
    if not len(frequent):
        return np.ones(len(values), np.int64)
    at = np.minimum(np.searchsorted(frequent, values), len(frequent) - 1)
    return np.where(frequent[at] == values, counts[at], 1)


def _differences(members: DataFrame, sets: DataFrame, label: DataFrame,
                 frequent: np.ndarray, counts: np.ndarray) -> DataFrame:
    """``hub, digest, n, weight, hub_n, component, apart, lists``: differences of sets to their hubs.

    ``members`` is stored.  Of a set that lacks ``l`` shingles of its hub and has ``h`` beside it,
    ``weight = 5 l + 4 h``.  Sets 1 and 2 are similar if and only if they share at least
    ``(weight_1 + weight_2 - hub_n) / 9`` differences.  The weight of a set similar to the hub is at
    most ``hub_n``, that of any other more, and sets similar to the hub are in one component.  Neither
    has more than a quarter of its size of differences that the other has not.

    ``apart`` has all differences, ``lists`` names the index lists of a prefix of them, in order.
    Prefixes start with what few members have: shingles beside the hub that few documents have, and
    lacking ones that most of the hub's group have.  Any one order for each hub gives the same result.
    """
    low = (1 << 8 * (8 - KEPT_BYTES)) - 1
    kept = frequent & ~low

    @gives_back
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            given = zip(*[batch[c] for c in (
                "hub", "digest", "component", "central", "set_hub", "set_own")], strict=True)
            for name, own_name, component, central, set_hub, set_own in given:
                hub, own = _unpack(set_hub), _unpack(set_own)
                apart = np.setxor1d(hub, own, assume_unique=True)
                lacks = (len(apart) + len(hub) - len(own)) // 2
                weight = 5 * lacks + 4 * (len(apart) - lacks)
                least = weight // 9 + 1 if central else max(1, (weight - len(hub) + 8) // 9)
                prefix = min(len(own) // 4 + 1, len(apart) - least + 1)
                if prefix <= 0:
                    continue
                lacking = hub[np.minimum(np.searchsorted(hub, apart), len(hub) - 1)] == apart
                seen = _counted(apart, kept, counts)
                most = _counted(hub, kept, counts).max()
                order = np.lexsort((apart, np.where(lacking, most - seen, seen)))[:prefix]
                salt = np.uint64(name & ((1 << 64) - 1))
                list_ = _mixed(_mixed(apart[order].view(np.uint64)) ^ salt).view(np.int64)
                rows.append((name, own_name, len(own), weight, len(hub), component, _pack(apart),
                             list_))
            yield pd.DataFrame(rows, columns=[
                "hub", "digest", "n", "weight", "hub_n", "component", "apart", "lists"])

    known = label.selectExpr("node", "component AS found")
    named = settle(
        members.join(known.withColumnRenamed("node", "digest"), "digest", "left")
        .withColumn("component", F.coalesce("found", "digest")).drop("found")
        .join(known.withColumnRenamed("node", "hub"), "hub", "left")
        .withColumn("central", F.col("component") == F.coalesce("found", "hub"))
        .select("hub", "digest", "component", "central"),
        "named-members",
    )
    hub = _sets_of(sets, named.selectExpr("hub AS digest")).selectExpr(
        "digest AS hub", "values AS set_hub")
    own = sets.selectExpr("digest", "values AS set_own")
    narrow = _broadcast_if_small(named, named.count())
    return own.join(narrow, "digest").join(hub, "hub").mapInPandas(
        run, "hub long, digest long, n long, weight long, hub_n long, component long, apart binary, "
        "lists array<long>"
    )


def _ranges(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all stretches, one after another."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(begins - before, lengths) + np.arange(int(lengths.sum()))


def _links_within(name: np.ndarray, size: np.ndarray, weight: np.ndarray, hub_n: np.ndarray,
                  component: np.ndarray, chunk: np.ndarray, across: bool, apart: np.ndarray,
                  lists: np.ndarray) -> list[tuple[int, int]]:
    """Links of entries of one hub, of two chunks if ``across``.  ``component`` is changed.

    Each pair that shares an index list is compared at most once.
    """
    # All differences, one entry's after another's, as numbers from 0.
    lengths = np.array([len(x) // KEPT_BYTES for x in apart])
    begins = np.cumsum(lengths) - lengths
    found, number = np.unique(_unpack(b"".join(apart)), return_inverse=True)
    is_own = np.zeros(len(found), bool)
    # Places in lists, also one entry's after another's, and where they are when sorted by list.
    n_places = np.array([len(x) for x in lists])
    first = np.cumsum(n_places) - n_places
    entry = np.repeat(np.arange(len(name)), n_places)
    left = lengths[entry] - _ranges(np.zeros_like(first), n_places)
    _, list_ = np.unique(np.concatenate(list(lists)), return_inverse=True)
    order = np.argsort(list_, kind="stable")
    at = np.empty_like(order)
    at[order] = np.arange(len(order))
    end = np.cumsum(np.bincount(list_))[list_]
    entry_at, left_at = entry[order], left[order]
    links = []
    for i in range(len(name)):
        own = slice(first[i], first[i] + n_places[i])
        behind = end[own] - at[own] - 1
        places = _ranges(at[own] + 1, behind)
        j = entry_at[places]
        spare = int(hub_n[i]) - int(weight[i])
        small, large = np.minimum(size[j], size[i]), np.maximum(size[j], size[i])
        fits = (
            (9 * np.minimum(left_at[places], np.repeat(left[own], behind)) >= weight[j] - spare)
            & (NUM * large <= DEN * small)
            & (component[j] != component[i])
        )
        if across:
            fits &= chunk[j] != chunk[i]
        j = np.unique(j[fits])
        if not len(j):
            continue
        mine = number[begins[i] : begins[i] + lengths[i]]
        is_own[mine] = True
        # Every entry has a difference, so no part of the sum is empty.
        both = np.add.reduceat(
            is_own[number[_ranges(begins[j], lengths[j])]], np.cumsum(lengths[j]) - lengths[j],
            dtype=np.int64,
        )
        is_own[mine] = False
        for other in j[9 * both >= weight[j] - spare].tolist():
            if component[other] != component[i]:
                links.append((name[i], name[other]))
                component[component == component[other]] = component[i]
    return links


def _cross_links(differences: DataFrame) -> DataFrame:
    """Links of similar sets of different components that share a difference of their prefixes.

    ``differences`` is stored.  Of each cell, links suffice that join what the cell joins, so there
    are fewer than entries.  A cell is a chunk of a hub's entries, or two of them: then pairs are of
    one entry of each.  It gets an entry once, however many index lists it has there, and only if one
    of them has an entry of another component.
    """

    @gives_back
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["hub", "cell", "of", "digest", "n", "weight", "hub_n", "component", "chunk",
                   "apart", "lists"]
        for _, cell, of, *entries, apart, lists in _runs(batches, columns):
            across = cell[0] // of[0] != cell[0] % of[0]
            links = _links_within(*entries, across, apart, lists)
            yield pd.DataFrame(links, columns=["u", "v"], dtype="int64")

    narrow = differences.selectExpr("hub", "digest", "component", "length(apart) AS n_bytes", "lists")
    most = min(LIST_CHUNK, DIFFERENCE_CHUNK)
    chunks = narrow.groupBy("hub").agg(F.expr(
        f"bigint(ceil(greatest(count(1) / {most}, sum(n_bytes) / {DIFFERENCE_BYTES})))").alias("of"))
    entries = narrow.join(chunks, "hub").selectExpr(
        "hub", "digest", "component", "of", "pmod(xxhash64(digest), of) AS chunk",
        "explode(lists) AS list",
    )
    spread = entries.groupBy("hub", "list", F.col("chunk").alias("other")).agg(
        F.min("component").alias("low"), F.max("component").alias("high"))
    # By lists and chunks, without the differences themselves.
    wanted = settle(
        entries.join(spread, ["hub", "list"]).where("low <> component OR high <> component")
        .selectExpr("hub", "digest", "chunk", "of",
                    "least(chunk, other) * of + greatest(chunk, other) AS cell")
        .distinct(),
        "cells",
    )
    whole = differences.join(wanted, ["hub", "digest"])
    ordered = whole.repartition("hub", "cell").sortWithinPartitions("hub", "cell")
    return ordered.mapInPandas(run, "u long, v long").distinct()


def _pack(values: np.ndarray) -> bytes:
    """The upper bytes of each hash, in order."""
    low = 8 - KEPT_BYTES
    return values.view(np.uint8).reshape(-1, 8)[:, low:].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    part = np.frombuffer(data, np.uint8).reshape(-1, KEPT_BYTES)
    out = np.zeros((len(part), 8), np.uint8)
    out[:, 8 - KEPT_BYTES :] = part
    return out.view(np.int64).ravel()


def _broadcast_if_small(df: DataFrame, n_rows: int) -> DataFrame:
    return F.broadcast(df) if n_rows <= MAX_BROADCAST else df


def _sets_of(sets: DataFrame, names: DataFrame) -> DataFrame:
    """Of ``sets``, those in the column ``digest`` of ``names``, and few others, without a shuffle."""
    names = settle(names.distinct(), "wanted-sets")
    return split_by_keys(sets, "digest", names, names.count())[0]


def _sets(docs: DataFrame, words: int) -> DataFrame:
    @gives_back
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _use_hashes()
        for batch in batches:
            for at in range(0, len(batch), SETS_AT_ONCE):
                some = batch.iloc[at : at + SETS_AT_ONCE]
                sets = [shingle_set(t, words) for t in some["_text"]]
                out = some[["_id"]].copy()
                out["digest"] = np.array([digest(s) for s in sets], np.int64)
                out["values"] = [_pack(s) for s in sets]
                yield out

    kind = docs.schema["_id"].dataType.simpleString()
    return docs.mapInPandas(run, f"_id {kind}, digest long, values binary")


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``u, v, n_u, n_v, both``: sizes and overlap of pairs of whole sets.  ``pairs`` is stored."""

    @gives_back
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[["u", "v"]].copy()
            sizes, common = [], []
            for a, b in zip(batch["set_u"], batch["set_v"], strict=True):
                a, b = _unpack(a), _unpack(b)
                joined = np.concatenate([a, b])
                joined.sort(kind="stable")
                common.append(int((joined[1:] == joined[:-1]).sum()))
                sizes.append((len(a), len(b)))
            out["n_u"] = np.array([x for x, _ in sizes], np.int64)
            out["n_v"] = np.array([x for _, x in sizes], np.int64)
            out["both"] = np.array(common, np.int64)
            yield out

    first = sets.selectExpr("digest AS u", "values AS set_u")
    # Only the second join moves sets, and of the second ones only those that it needs.
    second = _sets_of(sets, pairs.selectExpr("v AS digest")).selectExpr(
        "digest AS v", "values AS set_v")
    narrow = pairs.select("u", "v")
    joined = first.join(_broadcast_if_small(narrow, pairs.count()), "u").join(second, "v")
    return joined.mapInPandas(run, "u long, v long, n_u long, n_v long, both long")


def similar_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS
) -> DataFrame:
    """One row for each row of ``docs``: id, ``n_shingles, component_id``.

    ``component_id`` is the lowest id that is reached by links.
    """
    given = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    first = settle(_first_pass(given, words), "shingle-sets")
    members = first.where("digest IS NOT NULL").select("_id", "n", "digest")
    top = (
        first.where("shingle IS NOT NULL")
        .groupBy("shingle")
        .agg(F.sum("seen").alias("seen"))
        .orderBy(F.desc("seen"), "shingle")
        .limit(MAX_FREQUENT)  # the order of shingles alone depends on it
        .toArrow()  # columns, as rows of Python would take many times the driver's memory
        .sort_by("shingle")
    )
    # Copies, which need no table behind them.
    frequent, counts = (top[c].to_numpy().astype("int64") for c in ("shingle", "seen"))
    del top

    prefixes = _prefixes(given, frequent, counts, words).dropDuplicates(["digest"])
    prefixes = settle(prefixes, "prefixes")
    low = (1 << PLACE_BITS) - 1
    entries = prefixes.selectExpr("digest", "n_others", "posexplode(prefix) AS (at, shingle)")
    entries = entries.selectExpr(
        "at < n_others AS other", f"(shingle & ~{low}L) | least(at, {low}) AS entry", "digest"
    )
    # A list of a frequent shingle may be long, and is known to be shared.
    shared = _shared(entries.where("other").select("entry", "digest")).union(
        entries.where("NOT other").select("entry", "digest")
    )
    sizes = settle(
        members.where("n > 3").groupBy("digest").agg(
            F.min("_id").alias("_id"), F.max("n").alias("n")), "set-classes"
    )
    lists = settle(
        shared.join(sizes.select("digest", "n"), "digest").selectExpr(
            f"shiftright(entry, {PLACE_BITS}) AS shingle", "digest", "n",
            f"int(entry & {low}) AS at"),
        "index-lists",
    )
    length = lists.groupBy("shingle").agg(F.count(F.lit(1)).alias("length"))
    # Stored, so that lists need no shuffle where few are long.
    many = settle(length.where(f"length > {min(SHORT, LIST_CHUNK)}"), "many-entries")
    found = settle(_near_pairs(lists, many), "near-pairs")
    long_lists = settle(lists.join(many.where(f"length > {SHORT}"), "shingle"), "long-lists")
    known = settle(_known_sets(found, long_lists, prefixes), "known-sets")
    pairs = settle(_worth_comparing(found, known), "pairs")
    long_lists = settle(_likely_entries(long_lists, known), "likely-entries")
    wanted = (
        pairs.select(F.col("u").alias("digest")).union(pairs.select("v"))
        .union(long_lists.select("digest")).distinct()
    )
    partners = settle(sizes.join(wanted, "digest").select("digest", "_id"), "partners")
    n_partners = partners.count()
    texts, _ = split_by_keys(given, "_id", partners, n_partners)
    lowest = partners.select(F.col("digest").alias("_digest"), F.col("_id").alias("_lowest"))
    # The lowest id is NULL where no row of a class has one.
    own = (F.col("digest") == F.col("_digest")) & F.col("_id").eqNullSafe(F.col("_lowest"))
    sets = settle(
        _sets(texts, words).join(_broadcast_if_small(lowest, n_partners), own)
        .select("digest", "values"),
        "sets",
    )
    if sets.count() > n_partners:  # rows alike in id and text
        sets = settle(sets.dropDuplicates(["digest"]), "sets")
    near = settle(_overlaps(pairs, sets), "overlaps")
    hubs = settle(_hubs(long_lists, near), "hubs")
    hub_pairs = settle(_hub_pairs(long_lists, hubs, near), "hub-pairs")
    to_hubs = settle(_overlaps(hub_pairs, sets), "hub-overlaps")
    near = near.union(to_hubs)
    links = near.where(SIMILAR).select("u", "v")
    label = components(links)

    in_lists = long_lists.join(label.withColumnRenamed("node", "digest"), "digest", "left").selectExpr(
        "shingle", "digest", "n", "at", "coalesce(component, digest) AS component"
    )
    apart = settle(_members_of_hubs(in_lists, hubs, near), "hub-members")
    differences = settle(_differences(apart, sets, label, frequent, counts), "differences")
    more = settle(_cross_links(differences), "cross-pairs")
    if more.take(1):
        label = components(more.union(
            label.selectExpr("node AS u", "component AS v").where("u <> v")
        ))

    grouped = members.where("n > 0").join(
        label.withColumnRenamed("node", "digest"), "digest", "left"
    ).withColumn("component", F.coalesce("component", "digest"))
    names = grouped.groupBy("component").agg(F.min("_id").alias("component_id"))
    linked = grouped.join(names, "component").select("_id", "n", "component_id")
    alone = members.where("n = 0").select("_id", "n", F.col("_id").alias("component_id"))
    return linked.union(alone).select(
        F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id"
    )


def one_of_each_component(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS
) -> DataFrame:
    """``docs`` without the rows whose component has a lower id.

    Rows are told by id, which should be unique; rows with a NULL id stay.  Only rows that are maybe
    among those to go are joined.
    """
    groups = similar_components(docs, id_col, text_col, words)
    gone = settle(
        groups.where(F.col(id_col) > F.col("component_id")).select(id_col).distinct(),
        "near-copies",
    )
    gone = gone.withColumnRenamed(id_col, "key")
    maybe, stay = split_by_keys(packed(docs, key=id_col), "key", gone, gone.count())
    left = maybe.join(gone, "key", "left_anti")
    return stay.select("row.*").unionByName(left.select("row.*"))
