"""Periodic runs, SimHash components and collocations against plain Python, and odd input."""

import collections
import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from trailmine.llm import collocations, runs, simhash_golay
from trailmine.llm.queries import with_periods

DOCS = "doc_id long, text string, lang string, runs string, collapsed string, print long, " \
    "fingerprint string, component_id string, phrase string, n string"
EXTRA = ("x", "x", 1, "x", "x", "x", "x")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def with_tail(draw, words):
    if len(words) < 5:
        return words
    a = draw.randrange(len(words))
    p = 1 + (len(words) - a) // draw.randint(2, 9)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def test_runs_equal_brute_force():
    draw = random.Random(1)
    for _ in range(300):
        docs = []
        for _ in range(draw.randint(1, 6)):
            words = draw.choices("abcdefghij"[: draw.choice([1, 2, 3, 10])],
                                 k=draw.choice([0, 0, 1, 12, 30, 150]))
            docs.append([w.encode() for w in with_tail(draw, words)])
        got = list(runs._chunk_results(docs))
        for words, (found, left) in zip(docs, got, strict=True):
            assert found == brute_runs(words)
            gone = {i for s, n, q in found for i in range(s + q, s + n)}
            assert left == b" ".join(w for i, w in enumerate(words) if i not in gone)
    for words in (fibonacci(1500), list("ab") * 400 + list("ba") * 300, ["a"] * 1000,
                  list("abab" "abac" "abac" "abacabac")):
        words = [w.encode() for w in words]
        assert next(runs._chunk_results([words]))[0] == brute_runs(words)


def test_grammar_gives_back_the_words():
    draw = random.Random(2)
    words = np.array(draw.choices(range(4), k=3000))
    grammar = runs.Grammar(words)
    assert grammar.nodes.shape[1] > 50 and len(grammar.place) < 1500
    for rule, (begin, middle, end) in enumerate(grammar.nodes.T.tolist()):
        assert begin < middle < end
        for at in grammar.places(rule).tolist():
            assert (words[at : at + end - begin] == words[begin:end]).all()


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(4)
    texts = [None, "", " \t ", ".,;", "one", "one two", "Ünï x y z a b c", "a " * 5000]
    vocabulary = [f"W{i}" for i in range(40)]
    for _ in range(60):
        words = with_tail(draw, draw.choices(vocabulary, k=draw.randint(1, 120)))
        texts.append("".join(w + draw.choice([" ", " ", "\t", ". ", "\n", "\r\n", ", "]) for w in words))
    texts += [t.replace("W3", "w4") for t in texts[20:30]] + texts[40:50]
    out = [(i, t, draw.choice(["en", "de", None]), *EXTRA) for i, t in enumerate(texts)]
    return [*out, (3, texts[9], "en", *EXTRA), (None, texts[10], None, *EXTRA), out[12]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def test_periodic_runs(docs, rows, monkeypatch):
    want = []
    for r in rows:
        words = WORD.findall(r[1] or "")
        found = brute_runs(words)
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        want.append((r[0], found, " ".join(w for i, w in enumerate(words) if i not in gone)))
    got = [(r[0], [tuple(x) for x in r[1]], r[2]) for r in runs.periodic_runs(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    monkeypatch.setattr(runs, "CHUNK_WORDS", 50)
    got = [(found, left.decode()) for found, left in runs._results(r[1] for r in rows)]
    assert got == [x[1:] for x in want]
    assert runs.periodic_runs(docs.limit(0)).count() == 0


def test_planted_periods(docs, rows):
    import binascii

    want = []
    for r in rows:
        words = WORD.findall(r[1] or "")
        h = binascii.crc32(str(r[0]).encode()) if r[0] is not None else 1
        if h % 10 or not words:
            want.append((r[0], r[1]))
            continue
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        want.append((r[0], " ".join(w if i < a else words[a + (i - a) % p]
                                    for i, w in enumerate(words))))
    assert sorted(map(tuple, with_periods(docs).collect()), key=repr) == sorted(want, key=repr)


def simhash(text):
    words = [w.encode().lower() for w in WORD.findall(text or "")]
    if not words:
        return 0
    k = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42)
              for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(ids, prints):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(ids)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 2:
            root[find(i)] = find(j)
    low = {}
    for i, name in enumerate(ids):
        if name is not None:
            low[find(i)] = min(low.get(find(i), name), name)
    return [low.get(find(i)) for i in range(len(ids))]


def test_near_duplicates(docs, rows, monkeypatch):
    prints = [simhash(r[1]) for r in rows]
    groups = components_of([r[0] for r in rows], prints)
    want = collections.Counter(
        (r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, groups, strict=True))
    got = simhash_golay.near_duplicates(docs)
    assert collections.Counter(map(tuple, got.collect())) == want
    assert simhash_golay.near_duplicates(docs.limit(0)).count() == 0
    monkeypatch.setattr(simhash_golay, "CHUNK", 7)
    assert [simhash_golay.fingerprint(r[1]) % (1 << 64) for r in rows] == prints


def test_golay_indices():
    draw = random.Random(6)
    for _ in range(2000):
        x = draw.getrandbits(23)
        y = x
        for bit in draw.sample(range(23), draw.randint(0, 2)):
            y ^= 1 << bit
        a, b = (set(simhash_golay.fuzzy_indices(np.array([v]))[0].tolist()) - {-1} for v in (x, y))
        assert a & b and len(a) in (1, 6)


@pytest.mark.parametrize("bucket", [256, 4])
def test_links_of_fingerprints(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash_golay, "BUCKET", bucket)
    draw = random.Random(7)
    prints = [0, (1 << 64) - 1]
    for _ in range(12):
        now = draw.getrandbits(64)
        for _ in range(40):  # chains and clouds
            prints.append(now)
            step = now
            for bit in draw.sample(range(64), draw.randint(1, 4)):
                step ^= 1 << bit
            now = step if draw.random() < 0.6 else now ^ 1 << draw.randrange(64)
    ids = list(range(len(prints)))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    made = spark.createDataFrame(list(zip(ids, signed, strict=True)), "_id long, print long")
    monkeypatch.setattr(simhash_golay, "fingerprints", lambda *_: made)
    got = {r[0]: r[2] for r in simhash_golay.near_duplicates(made).collect()}
    assert [got[i] for i in ids] == components_of(ids, prints)


def brute_collocations(rows, min_count, top):
    counts, n = collections.Counter(), collections.Counter()
    for r in rows:
        lang = "und" if r[2] is None else r[2]
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    candidates = {p: a for p, a in counts.items() if len(p[1]) > 1 and a >= min_count}
    out = collections.defaultdict(list)
    for (lang, words), a in candidates.items():
        if any(m == lang and 100 * b >= 100 * a and len(longer) > len(words) and any(
                longer[i : i + len(words)] == words for i in range(len(longer)))
               for (m, longer), b in candidates.items()):
            continue
        score, k = min((1000 * a * n[lang] // (counts[lang, words[:k]] * counts[lang, words[k:]]), k)
                       for k in range(1, len(words)))
        out[lang].append((score, a, " ".join(words), counts[lang, words[:k]],
                          counts[lang, words[k:]]))
    for lang, found in out.items():
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        for rank, (score, a, phrase, left, right) in enumerate(found[:top], 1):
            yield lang, rank, phrase, a, left, right, n[lang], score


@pytest.mark.parametrize("limits, top", [
    (collocations.Limits(), 2_000),
    (collocations.Limits(20, 50, 100, 64_000_000, 1 << 15), 7),
    (collocations.Limits(2, 9, 20, 900, 1 << 20), 50),
])
def test_collocations(docs, rows, limits, top):
    got = collocations.collocations(docs, min_count=4, top=top, limits=limits)
    assert sorted(map(tuple, got.collect())) == sorted(brute_collocations(rows, 4, top))
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_trie_counts_and_spills():
    draw = random.Random(8)
    trie, want, got = collocations.PhraseTrie(burst=30), collections.Counter(), collections.Counter()

    def take(left):
        for run in trie.spill(left):
            rows = run.T.tolist()
            assert rows == sorted(rows)
            for high, low, n in rows:
                got[high, low] += n

    for _ in range(200):
        rows = sorted({(draw.randint(0, 40), draw.randint(0, 9)) for _ in range(40)})
        trie.add(np.array([(*r, 2) for r in rows]).T)
        want.update(dict.fromkeys(rows, 2))
        assert len(trie.containers) == len(trie.lows) and trie.lows == sorted(set(trie.lows))
        if trie.size > 300:
            take(100)
            assert trie.size <= 100
    assert len(trie.containers) > 5
    take(0)
    assert got == want


def test_exact_scores_beyond_64_bits(spark):
    cuts = spark.createDataFrame([(10**15, 10**15, 10**15, 3)], "a long, n long, l long, r long")
    assert collocations._exact_scores(cuts).first()["score"] == 1000 * 10**15 // 3
