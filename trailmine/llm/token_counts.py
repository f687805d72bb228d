"""Token counts that follow edits without encoding a document again.

A document is cut into pre-tokens, which a byte-pair tokenizer encodes one by one.  Runs of
``LEAF`` pre-tokens are the leaves of a segment tree that sums characters and tokens.  An edit finds
its leaf by going down the tree.  Scanning starts anew at the leaf that holds the text shortly before
the edit, and stops at the first old leaf behind the edit that starts where a new pre-token starts:
from there on the same text is cut in the same way.  Only the leaves between are encoded again, and
sums are updated on the way up.

Strings of special tokens in a text are ordinary text.

Defined results: a NULL text is empty and has 0 tokens; a NULL list of edits is empty, a NULL edit is
left out; places and lengths beyond the text are cut to it; edits apply one after another, each to
the text that the one before left.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF = 64
CACHED = 400_000
# A pre-token's end depends on at most two characters behind it; one more to be safe.
LOOK_AHEAD = 3

EDIT = "struct<at:int,removed:int,added:string>"


class PreTokens(dict):
    """Token counts of pre-tokens, with a cache that starts anew when it is full."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        super().__init__()
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding(
            "own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
        )
        self.pattern = regex.compile(pattern)

    def __missing__(self, piece: str) -> int:
        n = len(self.encoding.encode_ordinary(piece))
        if len(piece) <= 40:
            if len(self) >= CACHED:
                self.clear()
            self[piece] = n
        return n


_pretokens: dict[tuple[str, str], PreTokens] = {}


def _known(ranks_path: str, pattern: str) -> PreTokens:
    key = (ranks_path, pattern)
    if key not in _pretokens:
        _pretokens[key] = PreTokens(ranks_path, pattern)
    return _pretokens[key]


class CountedText:
    """A text with the segment tree of its token counts."""

    def __init__(self, text: str, known: PreTokens) -> None:
        self.text, self.known = text, known
        self.encoded = 0
        leaves = []
        pieces = known.pattern.findall(text)
        for i in range(0, len(pieces), LEAF):
            leaves.append(self._leaf(pieces[i : i + LEAF]))
        self._build(leaves)

    def _leaf(self, pieces: list[str]) -> tuple[int, int]:
        chars = sum(map(len, pieces))
        self.encoded += chars
        return chars, sum(map(self.known.__getitem__, pieces))

    def _build(self, leaves: list[tuple[int, int]]) -> None:
        self.n_leaves = len(leaves)
        self.width = 1
        while self.width < max(1, len(leaves)):
            self.width *= 2
        empty = [(0, 0)]
        self.tree = empty * self.width + leaves + empty * (self.width - len(leaves))
        for node in range(self.width - 1, 0, -1):
            self._sum(node)

    def _sum(self, node: int) -> None:
        a, b = self.tree[2 * node], self.tree[2 * node + 1]
        self.tree[node] = (a[0] + b[0], a[1] + b[1])

    @property
    def tokens(self) -> int:
        return self.tree[1][1]

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds a character, and where that leaf starts."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if at >= start + self.tree[node][0] and self.tree[node + 1][0]:
                start += self.tree[node][0]
                node += 1
        return node - self.width, start

    def edit(self, at: int, removed: int, added: str) -> None:
        at = max(0, min(at, len(self.text)))
        removed = max(0, min(removed, len(self.text) - at))
        text = self.text[:at] + added + self.text[at + removed :]
        shift = len(added) - removed
        first, start = self._find(max(0, at - LOOK_AHEAD))
        last, behind = first, start
        pieces: list[str] = []
        end = at + removed
        for found in self.known.pattern.finditer(text, start):
            where = found.start() - shift
            while last < self.n_leaves and behind < max(end, where):
                behind += self.tree[self.width + last][0]
                last += 1
            if found.start() >= at + len(added) and where == behind and last < self.n_leaves:
                break
            pieces.append(found.group())
        else:
            last = self.n_leaves
        new = self._spread(pieces, last - first)
        self.text = text
        if len(new) == last - first:
            for i, leaf in enumerate(new, first):
                self._set(i, leaf)
        else:
            old = self.tree[self.width : self.width + self.n_leaves]
            self._build([*old[:first], *new, *old[last:]])

    def _spread(self, pieces: list[str], n_leaves: int) -> list[tuple[int, int]]:
        """New leaves: as many as before if their size allows it."""
        n = len(pieces)
        if not n_leaves or not n_leaves * LEAF // 4 <= n <= n_leaves * LEAF * 2:
            n_leaves = -(-n // LEAF)
        cuts = [n * i // n_leaves for i in range(n_leaves + 1)] if n_leaves else [0]
        return [self._leaf(pieces[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]

    def _set(self, i: int, leaf: tuple[int, int]) -> None:
        node = self.width + i
        self.tree[node] = leaf
        while node > 1:
            node //= 2
            self._sum(node)


def with_edits(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds ``edits`` to documents: those of a table ``id, edit_no, at, removed, added``, in order."""
    listed = edits.groupBy(id_col).agg(
        F.expr(
            "transform(array_sort(collect_list(struct(edit_no, at, removed, added))), "
            "e -> struct(int(e.at) AS at, int(e.removed) AS removed, e.added AS added))"
        ).alias("edits")
    )
    return docs.join(listed, id_col, "left")


def edited_counts(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    edits_col: str = "edits",
) -> DataFrame:
    """One row for each row of ``docs``, with the counts before, after each edit and at the end.

    Id, ``tokens_before, tokens_after, counts, n_chars, encoded_chars, n_leaves``.  ``encoded_chars``
    are the characters encoded for the edits alone.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _known(ranks_path, pattern)
        for batch in batches:
            rows = []
            for text, edits in zip(batch["_text"], batch["_edits"], strict=True):
                counted = CountedText(text, known)
                before, encoded, counts = counted.tokens, counted.encoded, []
                for edit in edits if edits is not None else []:
                    if edit is None:
                        continue
                    counted.edit(int(edit["at"] or 0), int(edit["removed"] or 0),
                                 edit["added"] or "")
                    counts.append(counted.tokens)
                rows.append((before, counted.tokens, counts, len(counted.text),
                             counted.encoded - encoded, counted.n_leaves))
            names = ["tokens_before", "tokens_after", "counts", "n_chars", "encoded_chars",
                     "n_leaves"]
            out = pd.DataFrame(rows, columns=names, index=batch.index)
            yield pd.concat([batch[["_id"]], out], axis=1)

    given = docs.select(
        F.col(id_col).alias("_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"),
        F.col(edits_col).cast(f"array<{EDIT}>").alias("_edits"),
    )
    schema = (
        f"_id {given.schema['_id'].dataType.simpleString()}, tokens_before long, "
        "tokens_after long, counts array<long>, n_chars long, encoded_chars long, n_leaves long"
    )
    return given.mapInPandas(run, schema).withColumnRenamed("_id", id_col)
