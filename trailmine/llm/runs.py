"""Runs of repeated words in documents, found on a grammar of the word ids.

A run is a stretch of consecutive words with smallest period ``q`` and at least ``max(12, 2 q)``
words that no neighbouring word extends.  For each document, in a task of its partition:

1. Re-Pair: the most frequent pair of neighbouring symbols becomes a nonterminal, until no pair
   repeats.  Pairs are counted for many documents at once and those that no more frequent neighbour
   overlaps are replaced in one round; pairs of different documents are different.  What is left of
   a document is the start rule, read as a balanced tree.
2. For each nonterminal, once, the runs that cross the boundary of its two halves.  A run of period
   ``q`` that crosses a boundary repeats the word before it ``q`` words later, or the word behind it
   ``q`` words earlier, so the places of these two words are the only periods to try.
3. These runs are translated to all places where the nonterminal stands.
4. Intervals of one period that overlap by the period are merged, extended as far as their document
   allows, and of equal intervals the one of smallest period stays.

The lowest node of the tree whose words hold a whole run is crossed by it, so no run is missed.

Defined results: NULL, empty and blank texts have no words and no runs; repeated rows and NULL ids
are rows like any other; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHORTEST = 12
# Words worked on at once; a longer document is worked on alone.
CHUNK_WORDS = 200_000
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"

Run = tuple[int, int, int]


def _chosen(keys: np.ndarray, rank: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Which of the pairs at ``at`` are replaced: those that beat both neighbours, and of a stretch
    of equal pairs (as in ``aaaa``) every second one."""
    strength = np.zeros(n + 2, np.int64)
    strength[at + 1] = rank + 1
    own = strength[at + 1]
    best = (own >= strength[at]) & (own >= strength[at + 2])
    place, key = at[best], keys[best]
    starts = np.ones(len(place), bool)
    starts[1:] = (place[1:] != place[:-1] + 1) | (key[1:] != key[:-1])
    first = np.maximum.accumulate(np.where(starts, np.arange(len(place)), 0))
    best[best] = (np.arange(len(place)) - first) % 2 == 0
    return best


class Grammar:
    """Re-Pair over a sequence of symbols: the nonterminals with their places, and the start rule."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        symbol = words.astype(np.int64)
        place = np.arange(n, dtype=np.int64)
        next_symbol = int(words.max()) + 1 if n else 0
        length = np.ones(next_symbol, np.int64)
        # For each nonterminal its first place, boundary and end; and all places, round by round.
        nodes, places = [], []
        open_ = np.ones(max(n - 1, 0), bool)
        while True:
            at = np.flatnonzero(open_)
            keys = (symbol[at] << 32) | symbol[at + 1]
            found, inverse, times = np.unique(keys, return_inverse=True, return_counts=True)
            often = times[inverse] > 1
            if not often.any():
                break
            at, inverse = at[often], inverse[often]
            rank = np.empty(len(found), np.int64)
            rank[np.argsort(times, kind="stable")] = np.arange(len(found))
            chosen = _chosen(inverse, rank[inverse], at, len(symbol))
            here = at[chosen]
            _, first, rule = np.unique(inverse[chosen], return_index=True, return_inverse=True)
            left, right = symbol[here[first]], symbol[here[first] + 1]
            begin = place[here[first]]
            middle = begin + length[left]
            nodes.append(np.stack([begin, middle, middle + length[right]]))
            places.append((rule + next_symbol, place[here]))
            length = np.concatenate([length, length[left] + length[right]])
            symbol[here] = rule + next_symbol
            next_symbol += len(first)
            # Only pairs that repeat, or that hold a new symbol, can repeat later.
            keep = np.ones(len(symbol), bool)
            keep[here + 1] = False
            moved = np.cumsum(keep) - 1
            symbol, place = symbol[keep], place[keep]
            open_ = np.zeros(len(symbol) + 1, bool)
            open_[moved[at]] = True
            open_[moved[here]] = True
            open_[np.maximum(moved[here] - 1, 0)] = True
            open_ = open_[: max(len(symbol) - 1, 0)]
        self.place = place
        self.first = next_symbol - sum(x.shape[1] for x in nodes)
        self.nodes = np.concatenate(nodes, axis=1) if nodes else np.empty((3, 0), np.int64)
        rules = np.concatenate([r for r, _ in places]) if places else np.empty(0, np.int64)
        where = np.concatenate([p for _, p in places]) if places else np.empty(0, np.int64)
        order = np.argsort(rules, kind="stable")
        self._rules, self._where = rules[order], where[order]

    def places(self, rule: int) -> np.ndarray:
        """Where nonterminal number ``rule`` stands."""
        a, b = np.searchsorted(self._rules, [rule + self.first, rule + self.first + 1])
        return self._where[a:b]

    def top_nodes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The start rule of each document as a balanced tree: first place, boundary and end of its
        nodes.  Boundary ``i`` of ``k`` symbols reaches as far as its lowest set bit to both sides."""
        first = np.searchsorted(self.place, starts)
        sizes = np.searchsorted(self.place, ends) - first
        inner = np.maximum(sizes - 1, 0)
        doc = np.repeat(np.arange(len(starts)), inner)
        i = np.arange(len(doc)) - np.repeat(np.cumsum(inner) - inner, inner) + 1
        reach = i & -i
        limits = np.append(self.place, ends[-1] if len(ends) else 0)
        right = i + reach
        end = np.where(
            right < sizes[doc], limits[np.minimum(first[doc] + right, len(limits) - 1)], ends[doc]
        )
        return np.stack([limits[first[doc] + i - reach], limits[first[doc] + i], end])


def _equal_from(words: np.ndarray, i: int, q: int, end: int) -> int:
    """How many words from ``i`` on equal the word ``q`` later, which is before ``end``."""
    n, step = 0, 16
    while i + n + q < end:
        stop = min(i + n + step, end - q)
        differ = words[i + n : stop] != words[i + n + q : stop + q]
        if differ.any():
            return n + int(differ.argmax())
        n, step = stop - i, step * 4
    return n


def _equal_before(words: np.ndarray, i: int, q: int, start: int) -> int:
    """How many words before ``i``, down to ``start``, equal the word ``q`` later."""
    n, step = 0, 16
    while i - n > start:
        stop = max(i - n - step, start)
        differ = words[stop : i - n] != words[stop + q : i - n + q]
        if differ.any():
            return n + int(differ[::-1].argmax())
        n, step = i - stop, step * 4
    return n


def _crossing(words: np.ndarray, nodes: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """``node, start, end, period`` of runs across the boundary of each node, cut at its ends."""
    n = len(words)
    wide = np.flatnonzero(nodes[2] - nodes[0] >= SHORTEST)
    if not len(wide):
        return
    begin, middle, end = nodes[:, wide]
    longest = (end - begin) // 2
    order = np.argsort(words, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    sorted_ = words[order] * n + order

    def up_to(word: np.ndarray, place: np.ndarray, side: str) -> np.ndarray:
        return np.searchsorted(sorted_, word * n + place, side)

    before, behind = words[middle - 1], words[middle]
    later = rank[middle - 1] + 1, up_to(before, np.minimum(end - 1, middle - 1 + longest), "right")
    earlier = up_to(behind, np.maximum(begin, middle - longest), "left"), rank[middle]
    tries = []
    for first, last in (later, earlier):
        times = np.maximum(last - first, 0)
        node = np.repeat(np.arange(len(wide)), times)
        nth = np.arange(len(node)) - np.repeat(np.cumsum(times) - times, times)
        tries.append((node, order[np.repeat(first, times) + nth]))
    (node1, place1), (node2, place2) = tries
    node = np.concatenate([node1, node2])
    anchor = np.concatenate([middle[node1] - 1, place2])
    period = np.concatenate([place1 - anchor[: len(place1)], middle[node2] - place2])
    # A run of twelve words has six words in a row that equal the word one period later.
    need = SHORTEST // 2
    equal = np.ones(len(node), np.int64)
    ahead = back = np.ones(len(node), bool)
    for step in range(1, need):
        i = anchor + step
        ahead = ahead & (i + period < end[node])
        ahead = ahead & (words[np.minimum(i, n - 1)] == words[np.minimum(i + period, n - 1)])
        j = anchor - step
        back = back & (j >= begin[node])
        back = back & (words[np.maximum(j, 0)] == words[np.maximum(j, 0) + period])
        equal = equal + ahead + back
        alive = ahead | back | (equal >= need)
        if not alive.all():
            node, anchor, period = node[alive], anchor[alive], period[alive]
            equal, ahead, back = equal[alive], ahead[alive], back[alive]
    alive = equal >= need
    node, anchor, period = node[alive], anchor[alive], period[alive]
    by_node = np.lexsort((period, node))
    current, found = -1, []
    for k, a, q in zip(
        node[by_node].tolist(), anchor[by_node].tolist(), period[by_node].tolist(), strict=True
    ):
        if k != current:
            current, found = k, []
        # Inside a run, multiples of its period give the same run.
        if any(q % p == 0 and s <= a < e - q for s, e, p in found):
            continue
        s = a - _equal_before(words, a, q, int(begin[k]))
        e = a + _equal_from(words, a, q, int(end[k])) + q
        if e - s >= max(SHORTEST, 2 * q):
            found.append((s, e, q))
            yield int(wide[k]), s, e, q


def _merged(found: list[Run]) -> list[Run]:
    """``start, end, period`` with those of one period put together that overlap by it."""
    out: list[Run] = []
    for q, s, e in sorted({(q, s, e) for s, e, q in found}):
        if out and out[-1][2] == q and s <= out[-1][1] - q:
            out[-1] = (out[-1][0], max(out[-1][1], e), q)
        else:
            out.append((s, e, q))
    return out


def runs_of(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[list[Run]]:
    """The runs of each document as ``start, length, period``, by start, then period.

    ``words`` holds the documents one behind the other, with different ids in each.
    """
    out: list[list[Run]] = [[] for _ in starts]
    if not len(words):
        return out
    grammar = Grammar(words)
    found: list[Run] = []
    for rule, s, e, q in _crossing(words, grammar.nodes):
        shift = grammar.places(rule) - grammar.nodes[0, rule]
        found += [(s + d, e + d, q) for d in shift.tolist()]
    top = grammar.top_nodes(starts, ends)
    found += [(s, e, q) for _, s, e, q in _crossing(words, top)]
    least: dict[tuple[int, int, int], int] = {}
    for s, e, q in _merged(found):
        doc = int(np.searchsorted(starts, s, "right")) - 1
        # Empty documents share their start with the next one.
        begin, end = int(starts[doc]), int(ends[doc])
        e += _equal_from(words, e - q, q, end)
        s -= _equal_before(words, s, q, begin)
        name = (doc, s - begin, e - s)
        least[name] = min(least.get(name, q), q)
    for (doc, s, n), q in sorted(least.items(), key=lambda x: (*x[0][:2], x[1])):
        out[doc].append((s, n, q))
    return out


def _chunk_results(texts: list[list[bytes]]) -> Iterator[tuple[list[Run], bytes]]:
    ids: list[int] = []
    starts, ends = [], []
    for words in texts:
        starts.append(len(ids))
        # Ids start anew where those of the document before ended, so documents share none.
        number: defaultdict[bytes, int] = defaultdict(count(len(ids)).__next__)
        ids += map(number.__getitem__, words)
        ends.append(len(ids))
    array = np.array(ids, np.int64)
    for words, runs in zip(
        texts, runs_of(array, np.array(starts), np.array(ends)), strict=True
    ):
        if runs:
            keep = np.ones(len(words), bool)
            for s, n, q in runs:
                keep[s + q : s + n] = False
            words = [words[i] for i in np.flatnonzero(keep).tolist()]
        yield runs, b" ".join(words)


def _results(texts: Iterator[str | None]) -> Iterator[tuple[list[Run], bytes]]:
    held: list[list[bytes]] = []
    size = 0
    for text in texts:
        words = (text or "").encode("utf-8", "replace").split()
        if held and size + len(words) > CHUNK_WORDS:
            yield from _chunk_results(held)
            held, size = [], 0
        held.append(words)
        size += len(words)
    yield from _chunk_results(held)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``runs`` and ``collapsed`` of each row of ``docs``.

    ``runs`` are by start, then period, with ``start`` a word number from 0 and ``length`` in words.
    ``collapsed`` is the text without words that a run holds behind its first period, the others
    joined by one space.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found, left = [], []
            for runs, collapsed in _results(batch["_text"]):
                found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                left.append(collapsed.decode())
            yield pd.DataFrame({"_id": batch["_id"], "runs": found, "collapsed": left})

    given = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = given.schema["_id"].dataType.simpleString()
    found = given.mapInPandas(run, f"_id {kind}, runs {RUNS}, collapsed string")
    return found.select(F.col("_id").alias(id_col), "runs", "collapsed")
