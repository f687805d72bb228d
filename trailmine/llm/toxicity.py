"""Toxicity scores from a lexicon that also finds misspelled terms.

The lexicon is learned from labelled documents: words, and stems of words, that are significantly
more frequent in toxic ones.  It is a trie.  A Levenshtein automaton for a word of a text, walked
together with the trie, finds the terms within one edit, or two for long terms; a stem matches if it
is as near to a beginning of the word.  Words near a term that are not clearly
more frequent in toxic documents are not taken for terms.

Each hit counts with the weight of its term, less for each edit.  The words around it tell abuse
from quotation: hits in quotes or near a word of mention count little, hits near a form of address
count more.  The score of a document is a logistic function of the sum of its hits, of that sum by
its number of words, and of its strongest hit, fitted on the labelled documents.  Whole texts are
read, and nothing but the text enters a score.

The model is fitted on at most ``MAX_TRAINING`` labelled documents, which bound the number of its
terms too, so it goes to the executors whole.

Defined results: NULL and empty texts have the score of a text without hits; documents without label,
with a NULL label or NULL id are not learned from; without labels of both kinds the lexicon is empty
and every score is the share of toxic labels, 0.1 if there are none.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmine.llm.common import gives_back, settle, use_cache

MAX_TRAINING = 20_000
THRESHOLD = 0.3
STEM_LENGTHS = range(4, 9)
# Logarithm of how much more frequent in toxic documents a term, or a word like one, has to be.
LEAST_ODDS = 1.5
EDIT_FACTOR = 0.3
WINDOW = 6
CACHED_WORDS = 400_000
# Counts that a task holds before it hands them on.
HELD_COUNTS = 200_000

# Words of mention, words of address, and quotation marks.
MENTION = (
    "said says quote quoted quotes word term called phrase dit mot citation appelé "
    "sagte wort begriff zitat dijo palabra término cita"
).split()
ADDRESS = "you your you're u ur tu te toi vous du dich ihr sie usted tú vosotros".split()
QUOTES = "\"“”„«»"

_WORD = re.compile(r"\w+")
# In bytes: letters in lower case, other ASCII outside of words as spaces, all else as it is.
_TOKENS = bytes(
    ord(chr(i).lower()) if i < 128 and _WORD.match(chr(i)) else i if i > 127 else 32
    for i in range(256)
)
# Looks as if it were far: no term allows so many edits.
FAR = 9


@dataclass
class Model:
    """``words`` and ``stems``: weights of terms; ``clean``: words that look like terms and are
    not; ``factors``: of the logistic function, for a constant and the `features` of a document."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    clean: frozenset[str] = frozenset()
    factors: tuple[float, ...] = (math.log(0.1 / 0.9), 0.0, 0.0, 0.0)


def edits_allowed(length: int) -> int:
    return 0 if length < 4 else 1 if length < 8 else 2


class Terms:
    """A trie of terms; with ``begins``, terms are stems, held against beginnings of a word."""

    def __init__(self, terms: dict[str, float], begins: bool) -> None:
        self.begins = begins
        self.trie: dict = {}
        # The nodes on the way to each term.
        self.paths: dict[str, list[int]] = {}
        for term in terms:
            node, path = self.trie, []
            for letter in term:
                node = node.setdefault(letter, {})
                path.append(id(node))
            node[""] = term
            self.paths[term] = path
        self.longest = max(map(len, terms), default=0) + 2
        # Within k edits, one of k + 1 parts of a term is unchanged, moved by at most k places.
        parts: dict[tuple[int, int], dict[str, set[str]]] = {}
        for term in terms:
            k = edits_allowed(len(term))
            for i in range(k + 1):
                a, b = len(term) * i // (k + 1), len(term) * (i + 1) // (k + 1)
                for move in range(-k, k + 1):
                    if a + move >= 0:
                        known = parts.setdefault((a + move, b + move), {})
                        known.setdefault(term[a:b], set()).add(term)
        self.parts = [(a, b, known) for (a, b), known in sorted(parts.items())]

    def within(self, word: str) -> tuple[int, str] | None:
        """The nearest term within the edits it allows: distance and term.

        The state of the automaton after some letters of a term is the row of distances between
        those letters and each beginning of the word; a row without a value in reach is dead.  The
        last distance is that of the whole word, the least that of the nearest beginning.  Only ways
        to terms of which the word has a part are walked, and of a row only what is in reach.
        """
        if self.begins:
            word = word[: self.longest]
        if not 3 <= len(word) <= self.longest:
            return None
        wanted: set[int] = set()
        for a, b, known in self.parts:
            terms = known.get(word[a:b])
            if terms is not None:
                for term in terms:
                    wanted.update(self.paths[term])
        if not wanted:
            return None
        best: tuple[int, str] | None = None
        most = 2
        size = len(word)

        def walk(node: dict, row: list[int], depth: int) -> None:
            nonlocal best
            for letter, child in node.items():
                if letter == "":
                    found = (min(row) if self.begins else row[-1], child)
                    if found[0] <= edits_allowed(len(child)) and (best is None or found < best):
                        best = found
                    continue
                if id(child) not in wanted:
                    continue
                new = [FAR] * (size + 1)
                new[0] = least = depth
                left = depth if depth <= most + 1 else FAR
                for i in range(max(1, depth - most), min(size, depth + most) + 1):
                    here = row[i - 1] if word[i - 1] == letter else row[i - 1] + 1
                    if row[i] + 1 < here:
                        here = row[i] + 1
                    if left + 1 < here:
                        here = left + 1
                    new[i] = left = here
                    if here < least:
                        least = here
                if least <= most:
                    walk(child, new, depth + 1)

        walk(self.trie, list(range(size + 1)), 1)
        return best


class Lexicon:
    """The tries of a model's words and stems, and a cache of what tokens of texts match.

    A token is a stretch of word letters and of anything outside ASCII; it has no word, one or more.
    """

    def __init__(self, model: Model) -> None:
        self.model = model
        self.words = Terms(model.words, begins=False)
        self.stems = Terms(model.stems, begins=True)
        self.stem_lengths = sorted({len(s) for s in model.stems})
        self._forget()

    def _forget(self) -> None:
        # Tokens without a hit, tokens that are not one word with their number, and words that match.
        self.clear: set[bytes] = set()
        self.counts: dict[bytes, int] = {}
        self.found: dict[str, tuple[str, int, float]] = {}

    def match(self, word: str) -> tuple[str, int, float] | None:
        """Term, edits and weight, or None.  ``word`` is in lower case."""
        found = self.found.get(word)
        if found is None:
            found = self._match(word)
            if found is not None:
                if len(self.found) >= CACHED_WORDS:
                    self.found.clear()
                self.found[word] = found
        return found

    def _matches(self, token: bytes) -> dict[str, tuple[str, int, float]]:
        """The words of a token that match."""
        word = token.decode("utf-8", "surrogatepass")
        words = [word] if token.isascii() else _WORD.findall(word.lower())
        if len(words) != 1:
            self.counts[token] = len(words)
        found = {w: hit for w in words if (hit := self.match(w)) is not None}
        if not found:
            self.clear.add(token)
        return found

    def _match(self, word: str) -> tuple[str, int, float] | None:
        model = self.model
        if word in model.words:
            return word, 0, model.words[word]
        for length in self.stem_lengths:
            stem = word[:length]
            if stem in model.stems:
                return stem, 0, model.stems[stem]
        if word in model.clean:
            return None
        near, stem = self.words.within(word), self.stems.within(word)
        if near is None and stem is None:
            return None
        # Of a word and a stem that are equally near, the word.
        if stem is None or (near is not None and near[0] <= stem[0]):
            return near[1], near[0], model.words[near[1]] * EDIT_FACTOR ** near[0]
        return stem[1], stem[0], model.stems[stem[1]] * EDIT_FACTOR ** stem[0]

    def hits(self, text: str | None) -> tuple[list[tuple[int, int, str, int, float]], int]:
        """``start, end, term, edits, weight`` of each hit, weighed by its context; all words."""
        if not text:
            return [], 0
        if len(self.clear) + len(self.counts) >= CACHED_WORDS:
            self._forget()
        # The small form of a sigma depends on the letters around it.
        data = (text.lower() if "\u03a3" in text else text).encode("utf-8", "surrogatepass")
        tokens = data.translate(_TOKENS).split()
        distinct = set(tokens)
        known: dict[str, tuple[str, int, float]] = {}
        for token in distinct - self.clear:
            known.update(self._matches(token))
        n_words = len(tokens)
        if len(data) > len(text) and not distinct.isdisjoint(self.counts):
            n_words += sum(self.counts[t] - 1 for t in tokens if t in self.counts)
        if not known:
            return [], n_words
        low = text.lower()
        spans = list(_WORD.finditer(low))
        out = []
        for i, span in enumerate(spans):
            found = known.get(span.group())
            if found is None:
                continue
            first, last = max(0, i - WINDOW), min(len(spans), i + WINDOW + 1)
            before = low[spans[first].start() : span.start()]
            after = low[span.end() : spans[last - 1].end()]
            around = {s.group() for s in spans[first:last]}
            weight = found[2]
            quoted = any(q in before for q in QUOTES) and any(q in after for q in QUOTES)
            if quoted or not around.isdisjoint(MENTION):
                weight *= 0.3
            elif not around.isdisjoint(ADDRESS):
                weight *= 1.25
            out.append((span.start(), span.end(), found[0], found[1], weight))
        return out, n_words


def features(hits: list[tuple[int, int, str, int, float]], n_words: int) -> tuple[float, ...]:
    """Weight of all hits, weight for 100 words, and the largest weight."""
    total = sum(hit[4] for hit in hits)
    most = max((hit[4] for hit in hits), default=0.0)
    return math.log1p(total), math.log1p(100 * total / (n_words + 50)), most / 5


_lexicons: dict[bytes, Lexicon] = {}


def _use_lexicons() -> None:
    use_cache("toxicity", _lexicons.clear)


def _lexicon(key: bytes, model: Model) -> Lexicon:
    """One for each model and Python worker, so the cache of words outlives a batch."""
    _use_lexicons()
    if key not in _lexicons:
        _lexicons.clear()
        _lexicons[key] = Lexicon(model)
    return _lexicons[key]


def _key(model: Model) -> bytes:
    return xxhash.xxh3_128_digest(repr((model.words, model.stems, sorted(model.clean))))


def training_rows(docs: DataFrame, labels: DataFrame, usable: Column) -> DataFrame:
    """``text, toxic`` of at most ``MAX_TRAINING`` labelled documents for which ``usable`` holds.

    Which ones is decided by a hash of the id.
    """
    chosen = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & usable)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(MAX_TRAINING)
    )
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").select("text", F.col("toxic").cast("int"))


def _term_counts(rows: DataFrame) -> DataFrame:
    """``kind, term, bad, good, bad2, good2``: toxic and other documents that have a word, or a
    beginning of words, once and twice.  Kind "doc" counts documents."""

    @gives_back
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _use_lexicons()
        counts: dict[tuple[str, int, int], Counter] = {}

        def handed_on() -> Iterator[pd.DataFrame]:
            for (kind, times, toxic), held in counts.items():
                while held:
                    some = [held.popitem() for _ in range(min(len(held), 50_000))]
                    yield pd.DataFrame(some, columns=["term", "n"]).assign(
                        kind=kind, times=times, toxic=toxic)
            counts.clear()

        def count(kind: str, times: int, toxic: int, terms: Iterable[str]) -> None:
            counts.setdefault((kind, times, toxic), Counter()).update(terms)

        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"].tolist(), strict=True):
                words = Counter(_WORD.findall((text or "").lower()))
                begins: Counter = Counter()
                for w, n in words.items():
                    for size in STEM_LENGTHS:
                        if len(w) < size:
                            break
                        begins[w[:size]] += n
                count("doc", 1, toxic, [""])
                for kind, found in (("word", words), ("stem", begins)):
                    count(kind, 1, toxic, found.keys())
                    count(kind, 2, toxic, [term for term, n in found.items() if n > 1])
                if sum(map(len, counts.values())) >= HELD_COUNTS:
                    yield from handed_on()
        yield from handed_on()

    found = rows.mapInPandas(run, "kind string, term string, times int, toxic int, n long")
    return found.groupBy("kind", "term").agg(*[
        F.sum(F.expr(f"IF(toxic = {toxic} AND times = {times}, n, 0)")).alias(name)
        for toxic, times, name in ((1, 1, "bad"), (0, 1, "good"), (1, 2, "bad2"), (0, 2, "good2"))
    ])


def _without_near_copies(rows: DataFrame) -> DataFrame:
    """One of the documents that share the least hash of their runs of three words."""

    @F.pandas_udf(T.LongType())
    def sketch(texts: pd.Series) -> pd.Series:
        _use_lexicons()
        out = []
        for text in texts:
            words = (text or "").encode("utf-8", "replace").lower().split()
            runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
            out.append(min(map(xxhash.xxh3_64_intdigest, runs)) >> 1)
        return pd.Series(out, dtype="int64")

    return rows.withColumn("sketch", sketch("text")).groupBy("sketch").agg(
        F.max(F.struct("text", "toxic")).alias("row")
    ).select("row.text", "row.toxic")


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None) -> Model:
    """Fits a `Model`.  ``usable`` is a condition on rows of ``labels``."""
    usable = F.lit(True) if usable is None else usable
    rows = settle(training_rows(docs, labels, usable), "toxic-training")
    counts = settle(_term_counts(_without_near_copies(rows)), "toxic-terms")
    total = counts.where("kind = 'doc'").first()
    if total is None or not total["bad"] or not total["good"]:
        share = rows.agg(F.avg("toxic")).first()[0]
        share = min(max(0.1 if share is None else float(share), 0.001), 0.999)
        return Model(factors=(math.log(share / (1 - share)), 0.0, 0.0, 0.0))
    n_bad, n_good = total["bad"], total["good"]
    terms = counts.where("kind <> 'doc'")
    # How far the counts are from those of a word without meaning: the likelihood ratio, which has
    # to stand out among all words that are frequent enough to be judged.
    rate = n_bad / (n_bad + n_good)

    def ratio(bad: str, good: str) -> str:
        return (
            f"2 * ({bad} * ln(greatest({bad}, 1) / greatest(({bad} + {good}) * {rate}, 1e-9)) + "
            f"{good} * ln(greatest({good}, 1) / greatest(({bad} + {good}) * {1 - rate}, 1e-9)))"
        )

    tried = max(2, terms.where("kind = 'word' AND bad + good >= 3").count())
    odds = f"ln((bad + 0.5) / {n_bad + 1}) - ln((good + 0.5) / {n_good + 1})"
    twice = ratio("bad2", "good2")
    strong = (
        terms.selectExpr(
            "*", f"{odds} AS odds",
            f"greatest({ratio('bad', 'good')}, IF(bad2 > good2, {twice}, 0)) AS ratio",
        )
        .where(F.col("ratio") > 2 * math.log(tried) + 2)
        .where(f"odds > {LEAST_ODDS}")
    )
    # A stem stands for many words: it is in clearly more documents than any one of them.
    widest = (
        terms.where("kind = 'word'")
        .selectExpr("bad", "term AS word", "explode(sequence(4, 8)) AS size")
        .where("length(word) >= size")
        .groupBy(F.expr("substring(word, 1, size)").alias("term"))
        .agg(F.max("bad").alias("widest"))
    )
    words = strong.where("kind = 'word'")
    stems = (
        strong.where("kind = 'stem'")
        .join(widest, "term")
        .where("bad >= 1.5 * widest")
    )
    # Of stems that begin with one another, the one that tells most.
    chosen: dict[str, float] = {}
    for row in sorted(stems.collect(), key=lambda r: (-r["ratio"], r["term"])):
        term = row["term"]
        if not any(term.startswith(s) or s.startswith(term) for s in chosen):
            chosen[term] = row["odds"]
    model = Model(
        words={r["term"]: r["odds"] for r in words.collect()},
        stems=chosen,
    )
    model.clean = _clean_words(terms.withColumn("odds", F.expr(odds)), model)
    model.factors = _fit(rows, model)
    return model


def _clean_words(counts: DataFrame, model: Model) -> frozenset[str]:
    """Words near a term that clean documents use, unless their own counts say that they are toxic.

    ``counts``: as of `_term_counts`, with ``odds``.
    """
    key = _key(model)

    @gives_back
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = _lexicon(key, model)
        for batch in batches:
            found = [(lexicon.match(w) or ("", 0, 0.0))[1] > 0 for w in batch["term"]]
            yield batch[found]

    fair = counts.where(
        f"kind = 'word' AND good > 0 AND NOT (bad > 0 AND odds > {LEAST_ODDS})"
    )
    near = fair.select("term").mapInPandas(run, "term string")
    return frozenset(r[0] for r in near.collect())


def _fit(rows: DataFrame, model: Model) -> tuple[float, ...]:
    """Factors of the logistic function, by Newton's method with a small penalty.

    The training rows come as counts by rounded features.
    """
    key = _key(model)

    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        lexicon = _lexicon(key, model)
        return pd.Series([[round(f, 2) for f in features(*lexicon.hits(t))] for t in texts])

    table = (
        rows.select("toxic", measured("text").alias("x")).groupBy("x", "toxic").count().collect()
    )
    x = np.array([[1.0, *r["x"]] for r in table])
    y = np.array([float(r["toxic"]) for r in table])
    n = np.array([float(r["count"]) for r in table])
    w = np.zeros(x.shape[1])
    penalty = np.array([1e-3] + [1e-1] * (len(w) - 1))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (y - p)) - penalty * w
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, gradient)
        w = w + step * min(1.0, 4 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return tuple(map(float, w))


HIT = "struct<start:int,end:int,term:string,edits:int,weight:double>"


def _scorer(model: Model, with_hits: bool):
    key = _key(model)

    def score(lexicon: Lexicon, text: str | None) -> tuple[float, list]:
        found, n_words = lexicon.hits(text)
        x = (1.0, *features(found, n_words))
        z = sum(a * b for a, b in zip(model.factors, x, strict=True))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z)))), found

    if with_hits:

        @F.pandas_udf(f"struct<score:double,hits:array<{HIT}>>")
        def run(texts: pd.Series) -> pd.DataFrame:
            lexicon = _lexicon(key, model)
            rows = [score(lexicon, t) for t in texts]
            names = ("start", "end", "term", "edits", "weight")
            return pd.DataFrame({
                "score": [s for s, _ in rows],
                "hits": [[dict(zip(names, h, strict=True)) for h in found] for _, found in rows],
            })
    else:

        @F.pandas_udf("double")
        def run(texts: pd.Series) -> pd.Series:
            lexicon = _lexicon(key, model)
            return pd.Series([score(lexicon, t)[0] for t in texts], dtype=float)

    return run


def toxic_score(model: Model, text: Column) -> Column:
    """The score of a text, from 0 to 1."""
    return _scorer(model, False)(text.cast("string"))


def toxic_hits(model: Model, text: Column) -> Column:
    """``score`` and ``hits``: where each term is in the text, its edits and its weight there."""
    return _scorer(model, True)(text.cast("string"))
