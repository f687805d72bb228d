"""Operators on small tables: plain Python versions of the same rules, and odd input."""

import collections
import itertools
import json
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from trailmine.llm import (
    ann,
    chat,
    exact_dedup,
    jaccard_join,
    licences,
    mixing,
    packing,
    pii,
    token_counts,
    toxicity,
)
from trailmine.llm.queries import TOOLS, tool_tables

DOCS = "doc_id long, text string, lang string, source string, n_chars long, text_sha256 string, " \
    "_id string, size string"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(draw.choices(words, k=draw.randint(1, 60))) for _ in range(60)]
    for i in range(20):  # near copies
        near = texts[i].split(" ")
        near[draw.randrange(len(near))] = "changed"
        texts.append(" ".join(near))
    texts += [texts[0], texts[0].replace(" ", "\t \n"), "", None, "one", "one two", " ", "a b c d"]
    texts.append(" ".join(draw.choices(words, k=6000)))
    out = [(i, t, None, f"s{i % 4}" if i % 7 else None, len(t or ""), "x", None, "y")
           for i, t in enumerate(texts)]
    return [*out, (5, texts[5], "en", "s9", 1, None, "z", None), (None, texts[7]) + (None,) * 6]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def normal(text):
    return SPACE.sub(" ", text or "")


def test_exact_groups(docs, rows):
    import hashlib

    groups = collections.defaultdict(list)
    for r in rows:
        groups[normal(r[1])].append(r[0])
    want = collections.Counter()
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        first = True
        for i in ids:
            kept = first and i == keep
            first = first and not kept
            want[i, keep, len(ids), kept, sha] += 1
    for max_bits in (exact_dedup.MAX_BITS, 1 << 16):
        got = exact_dedup.exact_groups(docs, max_bits=max_bits)
        assert collections.Counter(map(tuple, got.collect())) == want
    left = exact_dedup.drop_copies(docs).collect()
    assert sorted(normal(r["text"]) for r in left) == sorted(groups)
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0


def shingles(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    n = min(5, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def components_of(rows):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return collections.Counter(
        (r[0], len(sets[i]), low.get(find(i)) if sets[i] else r[0]) for i, r in enumerate(rows)
    )


@pytest.mark.parametrize("short, chunk, frequent", [(8, 20_000, 1 << 18), (2, 3, 1 << 18), (2, 20_000, 0)])
def test_similar_components(spark, docs, rows, monkeypatch, short, chunk, frequent):
    monkeypatch.setattr(jaccard_join, "SHORT", short)
    monkeypatch.setattr(jaccard_join, "LIST_CHUNK", chunk)
    monkeypatch.setattr(jaccard_join, "MAX_FREQUENT", max(1, frequent))
    draw = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    more = []
    for i in range(40):  # one large group, some of whose members are not similar to each other
        near = list(base)
        for _ in range(draw.randint(0, 3)):
            near[draw.randrange(60)] = f"n{i}"
        more.append((1000 + i, " ".join(near), *(None,) * 6))
    table = docs.union(spark.createDataFrame(more, DOCS))
    got = jaccard_join.similar_components(table).select("doc_id", "n_shingles", "component_id")
    assert collections.Counter(map(tuple, got.collect())) == components_of([*rows, *more])


def test_dense_group_is_not_compared_in_pairs(spark, monkeypatch):
    """Members of a group are far from each other, but for some that have a near copy."""
    seen = {}
    settle = jaccard_join.settle

    def counted(df, name):
        out = settle(df, name)
        seen[name] = out.count()
        return out

    monkeypatch.setattr(jaccard_join, "settle", counted)
    found = []
    for size in (60, 240):
        draw = random.Random(size)
        rows = []
        for i in range(size):
            near = [f"b{j}" for j in range(100)]
            for at in draw.sample(range(100), 2):
                near[at] = f"n{i}-{at}"
            rows.append((i, " ".join(near), *(None,) * 6))
            if i % 10 == 0:
                rows.append((10_000 + i, " ".join([*near[:97], f"m{i}"]), *(None,) * 6))
        got = jaccard_join.similar_components(spark.createDataFrame(rows, DOCS))
        got = got.select("doc_id", "n_shingles", "component_id")
        assert collections.Counter(map(tuple, got.collect())) == components_of(rows)
        found.append(seen["cross-pairs"])
    assert found[0] < 60 * 20 and found[1] < 240 * 20


def differences_of(spark, name, hub, sets):
    """Stored differences of sets to a hub, each of which is in the index list of every difference."""
    schema = ("hub long, digest long, n long, weight long, hub_n long, component long, apart binary, "
              "lists array<long>")
    rows = []
    for i, own in enumerate(sets):
        apart = sorted(hub ^ own)
        weight = 5 * len(hub - own) + 4 * len(own - hub)
        packed = jaccard_join._pack(np.array(apart, np.int64) << 16)
        rows.append((7, i, len(own), weight, len(hub), i, packed, apart))
    return jaccard_join.settle(spark.createDataFrame(rows, schema), name)


@pytest.mark.parametrize("chunk", [2_000, 16])
def test_links_of_a_list_are_fewer_than_its_entries(spark, monkeypatch, chunk):
    """All pairs share differences enough to be looked at; few or all of them are similar."""
    monkeypatch.setattr(jaccard_join, "DIFFERENCE_CHUNK", chunk)
    hub = frozenset(range(1000, 1200))
    far = [hub - set(range(1000, 1005)) | {i * 100 + j for j in range(3000, 3040)} for i in range(60)]
    near = [s - {min(s - hub)} | {900_000 + i} for i, s in enumerate(far[:20])]
    alike = [hub - set(range(1000, 1040)) | set(range(2000, 2010)) | {i} for i in range(60)]
    for name, sets in (("far", far + near), ("alike", alike)):
        found = jaccard_join._cross_links(differences_of(spark, name, hub, sets)).collect()
        similar = {
            (i, j) for j, b in enumerate(sets) for i, a in enumerate(sets[:j])
            if 100 * len(a & b) >= 80 * len(a | b)
        }
        links = {(min(r), max(r)) for r in found}
        assert links <= similar
        ids = list(range(len(sets)))
        for found_pairs in (links, similar):
            low = list(ids)
            for _ in ids:
                for i, j in found_pairs:
                    low[i] = low[j] = min(low[i], low[j])
            if found_pairs is links:
                got = low
        assert got == low
        if chunk > len(sets):
            # Each list that all are in gives one link less than it has entries, at most.
            assert len(links) < len(sets)
        assert len(found) < 0.7 * len(sets) * (len(sets) - 1) / 2


@pytest.mark.parametrize("chunk, most", [(2_000, 1 << 23), (8, 1 << 23), (2_000, 4_000)])
def test_differences_go_to_a_task_once(spark, monkeypatch, chunk, most):
    """Entries share many index lists; a task has each of them with its differences one time."""
    monkeypatch.setattr(jaccard_join, "DIFFERENCE_CHUNK", chunk)
    monkeypatch.setattr(jaccard_join, "DIFFERENCE_BYTES", most, raising=False)
    hub = frozenset(range(1000, 1200))
    sets = [hub - set(range(1000, 1040)) | set(range(2000, 2010)) | {i} for i in range(30)]
    differences = differences_of(spark, "once", hub, sets)
    n_chunks = max(-(-30 // chunk), -(-30 * 51 * jaccard_join.KEPT_BYTES // most))
    read = spark.sparkContext.accumulator(0)
    runs = jaccard_join._runs

    def counted(batches, columns):
        for run in runs(batches, columns):
            read.add(len(run[0]))
            yield run

    monkeypatch.setattr(jaccard_join, "_runs", counted)
    links = jaccard_join._cross_links(differences).collect()
    assert 29 <= len(links)
    assert 0 < read.value <= 30 * n_chunks


def hashed_early(phrase_of, n):
    """The first phrases of five words whose shingle is among the first twentieth of all."""
    found = []
    for i in itertools.count():
        phrase = phrase_of(i)
        if jaccard_join.shingle_set(phrase)[0] < -(1 << 63) + (1 << 64) // 20:
            found.append(phrase)
            if len(found) == n:
                return found


def test_phrases_by_chance_cost_no_sets(spark, monkeypatch):
    """Long texts that share a phrase and nothing else are neither stored nor held against a hub."""
    monkeypatch.setattr(jaccard_join, "MAX_FREQUENT", 1)
    seen = {}
    settle = jaccard_join.settle

    def counted(df, name):
        out = settle(df, name)
        seen[name] = out.count()
        return out

    monkeypatch.setattr(jaccard_join, "settle", counted)
    draw = random.Random(3)
    phrases = hashed_early(lambda i: " ".join(f"p{i}x{j}" for j in range(5)), 6)
    rows = []
    for i in range(60):
        words = [f"w{i}x{j}" for j in range(draw.randint(200, 260))]
        for phrase in draw.sample(phrases, 2):
            words += phrase.split() + [f"v{i}x{phrase[:4]}"]
        rows.append((i, " ".join(words), *(None,) * 6))
    near = rows[7][1].split()
    rows.append((1000, " ".join([*near[:100], "other", *near[101:]]), *(None,) * 6))
    got = jaccard_join.similar_components(spark.createDataFrame(rows, DOCS))
    got = got.select("doc_id", "n_shingles", "component_id")
    assert collections.Counter(map(tuple, got.collect())) == components_of(rows)
    assert seen["long-lists"] >= 60  # phrases make lists of more than SHORT entries
    assert seen["differences"] <= 6
    assert seen["sets"] <= 12


@pytest.mark.parametrize("short, frequent", [(2, 1), (2, 40), (8, 1)])
def test_similar_sets_at_the_threshold(spark, monkeypatch, short, frequent):
    """Parts of a text at a similarity of just 0.8, with groups and chance phrases in long lists."""
    monkeypatch.setattr(jaccard_join, "SHORT", short)
    monkeypatch.setattr(jaccard_join, "MAX_FREQUENT", frequent)
    draw = random.Random(11)
    phrases = hashed_early(lambda i: " ".join(f"q{i}x{j}" for j in range(5)), 4)
    texts = []
    for i in range(24):
        words = [f"t{i}x{j}" for j in range(draw.randint(44, 84))]
        for phrase in draw.sample(phrases, 2):
            at = draw.randrange(len(words))
            words[at:at] = phrase.split()
        n = len(words) - 4
        texts.append(words)
        for cut in (n - n * 80 // 100, n - n * 80 // 100 + 1, 3):  # at, below and above the threshold
            texts.append(words[cut:])
            texts.append(words[:-cut])
            if draw.random() < 0.3:
                texts.append([*words[:9], f"n{i}x{cut}", *words[10:]])
    rows = [(i, " ".join(x), *(None,) * 6) for i, x in enumerate(texts)]
    got = jaccard_join.similar_components(spark.createDataFrame(rows, DOCS))
    got = got.select("doc_id", "n_shingles", "component_id")
    assert collections.Counter(map(tuple, got.collect())) == components_of(rows)


def test_bounds_of_lists_drop_no_similar_pair():
    """Entries, and pairs by their overlaps with a hub, against overlaps counted one by one."""
    draw = random.Random(17)
    for _ in range(60):
        pool = [draw.randrange(-(1 << 63), 1 << 63) for _ in range(400)]
        base = [frozenset(draw.sample(pool, 60)) for _ in range(3)]
        sets = list(base)
        for _ in range(20):
            own = set(draw.choice(base))
            own -= set(draw.sample(sorted(own), draw.randint(0, 12)))
            sets.append(frozenset(own | set(draw.sample(pool, draw.randint(0, 6)))))
        prefix = [sorted(s)[: len(s) - jaccard_join.needed(len(s)) + 1] for s in sets]
        rest = np.full((len(sets), len(jaccard_join.MARKS)), -1, np.int64)
        for i, s in enumerate(sets):
            for k, mark in enumerate(jaccard_join._MARKS.tolist()):
                before = sum(x < mark for x in s)
                if before <= len(prefix[i]):
                    rest[i, k] = len(s) - before
        size = np.array([len(s) for s in sets])
        shared = np.array([
            max(len(set(p) & set(q)) for j, q in enumerate(prefix) if j != i)
            for i, p in enumerate(prefix)])
        similar = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets)
                   if i != j and 100 * len(a & b) >= 80 * len(a | b)}
        kept = jaccard_join._may_be_similar(size, shared, rest)
        assert kept[sorted({i for i, _ in similar})].all()

        # One list of all that have a shingle in their prefix; its hub is the first of them.
        value = prefix[0][draw.randrange(len(prefix[0]))]
        ids = [i for i, p in enumerate(prefix) if value in p]
        both = np.array([len(sets[0] & sets[i]) if draw.random() < 0.8 else -1 for i in ids])
        component = np.array([draw.randrange(3) for _ in ids])
        place = np.array([prefix[i].index(value) for i in ids])
        name = np.array(ids)
        got = set(jaccard_join._with_partners(name, size[name], place, component, both).tolist())
        of = dict(zip(ids, component.tolist(), strict=True))
        first = {(i, j) for i, j in similar if i in of and j in of
                 and min(set(prefix[i]) & set(prefix[j])) == value}
        assert {i for i, j in first if of[i] != of[j]} <= got


def test_similar_components_of_nothing(docs):
    assert jaccard_join.similar_components(docs.limit(0)).count() == 0
    empty = docs.where("text IS NULL")
    assert jaccard_join.similar_components(empty).count() == empty.count()


def test_mix(docs, rows):
    mix = mixing.mix_sources(docs, block_words=16, shard_slots=8)
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    names = sorted(s for s in sizes if s is not None) + [None]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    rest = 1.5 * sum(sizes.values())
    while open_:
        level = rest / sum(weights[s] for s in open_)
        full = {s for s in open_ if level * weights[s] >= 2 * sizes[s]}
        for s in full or open_:
            target[s] = 2 * sizes[s] if full else level * weights[s]
            rest -= target[s] if full else 0
        open_ = open_ - full if full else set()
    got = {r["source"]: r for r in mix.sources.collect()}
    assert got.keys() == target.keys()
    taken = collections.Counter()
    of_row = {r["row_id"]: r["taken"] for r in mixing.taken_words(mix).collect()}
    for r in mix.rows.collect():
        taken[r["source"]] += of_row.get(r["row_id"], 0)
        assert of_row.get(r["row_id"], 0) <= 2 * r["size"]
    for s in names:
        assert got[s]["target"] == pytest.approx(target[s])
        assert abs(taken[s] - target[s]) <= 0.5
    again = mixing.mix_sources(docs, block_words=16, shard_slots=8)
    assert sorted(map(tuple, mix.slots.collect())) == sorted(map(tuple, again.slots.collect()))
    unique = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    mix = mixing.mix_sources(unique, block_words=16, shard_slots=8)
    words = collections.Counter()
    for r in mixing.mixed_documents(unique, mix).collect():
        words[r["doc_id"]] += len((r["text"] or "").split())
    ids = {r["row_id"]: r["id"] for r in mix.rows.collect()}
    want = {ids[r["row_id"]]: r["taken"] for r in mixing.taken_words(mix).collect()}
    assert {i: n for i, n in words.items() if n} == {i: n for i, n in want.items() if n}
    slots = mixing.mixed_blocks(unique, mix).collect()
    assert sum(len(r["text"].split()) for r in slots) == sum(want.values())
    assert mixing.taken_words(mixing.mix_sources(docs.limit(0))).count() == 0


def test_packing(spark, docs, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    extra = ["don't STOP'LL é́  x ١² <|endoftext|> \x85\x1c", "İΣς ß漢字"]
    table = docs.union(spark.createDataFrame(
        [(9000 + i, t, *(None,) * 6) for i, t in enumerate(extra)], DOCS))
    got = packing.pack_documents(table, path, capacity=256).toPandas()
    ids = {}
    for r in packing.token_pieces(table, path, capacity=256, with_ids=True).collect():
        ids.setdefault((r["doc_id"], r["piece"]), list(r["ids"]))
    for i, t in [(r[0], r[1]) for r in rows if r[0] is not None] + [
        (9000 + i, t) for i, t in enumerate(extra)
    ]:
        want = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        pieces = [ids[i, p] for p in range(-(-len(want) // 256))]
        assert sum(pieces, []) == want and all(len(p) == 256 for p in pieces[:-1])
    room = got.groupby("sequence_id").length.sum()
    assert room.max() <= 256
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all()
    assert packing.pack_documents(docs.limit(0), path).count() == 0


def test_encoder_keeps_parts_of_words_alone():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, encoder = Tokenizer.from_file(path), packing.WordEncoder(path)
    draw = random.Random(3)
    stems = [f"{a}{b}en" for a in ("tion", "über", "He", "élan") for b in "abcdefghij"]
    marks = [".", ",", "!!", "...", "'s", "7", "42", '("']
    texts = [
        " ".join(draw.choice(stems) + draw.choice(marks) + draw.choice(stems) for _ in range(50))
        for _ in range(60)
    ]
    odd = ["", " \t", "a\u00a0b c", "don't<|endoftext|>x y", "ﬁn İΣς Ab", "x\x1cy z", "µm ª1", "a\r\nb\x0bc", "é e\u0301"]
    odd += [" ".join(pair) for pair in zip(odd, reversed(odd), strict=True)]
    for given in (texts, odd, odd + texts):
        for text, data in zip(given, encoder.encode(given), strict=True):
            assert np.frombuffer(data, "<u4").tolist() == plain.encode(
                text, add_special_tokens=False).ids
    held = sum(len(c) for c in vars(encoder).values() if isinstance(c, dict))
    assert held < 150  # of 2,700 words


def test_plan_uses_up_every_histogram():
    draw = np.random.default_rng(1)
    for size in (0, 1, 30, 5_000):
        counts = np.zeros(257, np.int64)
        np.add.at(counts, draw.integers(1, 257, size), 1)
        room, ranks = collections.Counter(), collections.Counter()
        for length, lo, hi, shift, per, first, place in packing.plan_packing(counts, 256):
            for r in range(lo, hi):
                t = r - lo + shift
                room[first + t // per] += length
                ranks[length, r] += 1
        assert max(room.values(), default=0) <= 256
        assert set(ranks.values()) <= {1}
        assert collections.Counter(length for length, _ in ranks) == {
            i: n for i, n in enumerate(counts.tolist()) if n}
        least = -(-int((counts * np.arange(257)).sum()) // 256)
        assert len(room) <= 1.06 * least + 3


def test_nearest(spark):
    draw = np.random.default_rng(2)
    vectors = draw.standard_normal((600, 16))
    vectors[300:340] = vectors[3]
    table = [(i, v.tolist()) for i, v in enumerate(vectors)]
    table += [(700, None), (701, [0.0] * 16), (702, [float("nan")] * 16), (703, [None] * 16),
              (704, [1.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), 5, cell_rows=64).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    found = 0
    for q in range(0, 600, 20):
        scores = np.round(unit @ unit[q], 12)
        scores[q] = -2
        want = np.lexsort((np.arange(600), -scores))[:5].tolist()
        mine = sorted(got[q])
        assert [x[0] for x in mine] == [1, 2, 3, 4, 5]
        assert all(abs(unit[q] @ unit[i] - s) < 1e-9 for _, i, s in mine)
        found += len(set(want) & {i for _, i, _ in mine})
        if q == 300:
            assert [i for _, i, _ in mine] == want
    assert found >= 0.9 * 150 and got.keys() == set(range(0, 600, 20))
    assert ann.nearest(df.limit(0), df.limit(0), 5).count() == 0
    three = df.where("vec_id < 3")
    assert ann.nearest(three, three, 5).count() == 6


def test_toxicity(spark):
    draw = random.Random(4)
    words = [f"word{chr(97 + i % 26)}{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(400):
        text = draw.choices(words, k=40)
        bad = i % 8 == 0
        if bad:
            for _ in range(3):
                text[draw.randrange(40)] = draw.choice(["stupid", "disgusting"])
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    rows += [(900, None), (901, ""), (902, "stupld disgustjng " + " ".join(words[:20])),
             (903, " ".join(words[:60])), (None, "x")]
    labels += [(900, None), (None, 1), (5000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    from pyspark.sql import functions as F

    model = toxicity.train(docs, table)
    assert set(model.words) == {"stupid", "disgusting"}
    score = {r[0]: r[1] for r in docs.select(
        "doc_id", toxicity.toxic_score(model, F.col("text"))).collect()}
    assert all((score[i] >= 0.3) == (i % 8 == 0) for i in range(400))
    assert score[902] >= 0.3 > max(score[900], score[901], score[903])
    lexicon = toxicity.Lexicon(model)
    assert lexicon.match("stuped")[:2] == ("stupid", 1) and lexicon.match("stopped") is None
    plain = lexicon.hits("a b stupid c")[0][0][4]
    assert lexicon.hits('he wrote "stupid" there')[0][0][4] < plain < lexicon.hits("you stupid")[0][0][4]
    none = toxicity.train(docs, table.limit(0))
    assert not none.words and docs.select(toxicity.toxic_score(none, F.col("text"))).count() == len(rows)


def test_automaton_finds_what_distances_say():
    lexicon = toxicity.Lexicon(toxicity.Model(words={"moron": 5.0, "worthless": 5.0, "scum": 5.0}))
    draw = random.Random(6)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(3000):
        word = list(draw.choice(["moron", "worthless", "scum"]))
        for _ in range(draw.randint(0, 3)):
            at = draw.randrange(len(word) + 1)
            word[at : at + draw.randint(0, 1)] = draw.choice(["", "x", "o", "s"])
        word = "".join(word)
        near = [t for t in lexicon.model.words if distance(word, t) <= toxicity.edits_allowed(len(t))]
        if len(word) >= 3:
            assert (lexicon.match(word) is not None) == bool(near), word


def test_edited_counts(spark):
    draw = random.Random(8)
    alphabet = list("ab  \n\n'slld1é漢.,") + ["'ll", " the", "<|endoftext|>"]
    rows = [(None, None, None), (1, "", [])]
    for i in range(60):
        text = "".join(draw.choices(alphabet, k=draw.choice([3, 200, 3000])))
        edits = [(draw.randint(-5, len(text) + 9), draw.choice([0, 1, 7, 400]),
                  "".join(draw.choices(alphabet, k=draw.choice([0, 1, 9])))) for _ in range(6)]
        rows.append((i, text, [*edits, None]))
    df = spark.createDataFrame(
        rows, f"doc_id long, text string, edits array<{token_counts.EDIT}>")
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    plain = token_counts.PreTokens(ranks, pattern).encoding
    got = token_counts.edited_counts(df, ranks, pattern).collect()
    for (_, text, edits), r in zip(rows, got, strict=True):
        text = text or ""
        assert r["tokens_before"] == len(plain.encode_ordinary(text))
        counts = []
        for edit in edits or []:
            if edit is None:
                continue
            at = max(0, min(edit[0], len(text)))
            text = text[:at] + edit[2] + text[at + edit[1] :]
            counts.append(len(plain.encode_ordinary(text)))
        assert r["counts"] == counts and r["n_chars"] == len(text)


def test_tool_calls(spark):
    calls = [
        (1, 5, "b", "search", '{"query": "x", "limit": 3}'),
        (1, 2, "a", "merge", '{"strict":true,"inputs":[{"$call": "b"},{"$call":"zz"}]}'),
        (1, 3, "c", "merge", '{"inputs":[{"$call":"a"}],"strict":true}'),
        (1, 4, "d", "merge", '{"inputs":[{"$call":"d"}],"strict":1}'),
        (2, 0, "a", "count", '{"words":"many","text":"q\\"\\u00e9","more":1}'),
        (2, 1, "e", None, "no json"),
        (None, 1, "f", "count", "{}"),
        (2, 9, "a", "count", "{}"),
    ]
    results = [(1, 6, "b", 'say "hi"'), (1, 7, "b", "late"), (3, 1, "b", "alone"), (2, 2, "e", None)]
    got = chat.link_tool_calls(
        spark.createDataFrame(calls, "conv_id long, turn long, call_id string, tool string, "
                              "arguments string"),
        spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string"),
        TOOLS,
    ).orderBy("conv_id", "place").collect()
    order = [(r["conv_id"], r["call_id"], r["role"], r["level"]) for r in got]
    assert order == [(1, "b", "assistant", 0), (1, "b", "tool", 0), (1, "a", "assistant", 1),
                     (1, "c", "assistant", 2), (1, "d", "assistant", None),
                     (2, "a", "assistant", 0), (2, "e", "assistant", 0), (2, "e", "tool", 0)]
    by = {(r["conv_id"], r["call_id"], r["role"]): r for r in got}
    assert by[1, "b", "assistant"]["valid"] and by[1, "b", "assistant"]["linked"]
    assert by[1, "a", "assistant"]["errors"] == ["zz: no such call"]
    assert by[1, "d", "assistant"]["errors"] == ["strict: no boolean"]
    assert by[2, "a", "assistant"]["errors"] == ["words: no integer", "more: unknown"]
    assert not by[2, "e", "assistant"]["valid"]
    for r in got:
        message = json.loads(r["message"])
        assert json.dumps(message, sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r["message"]
    assert json.loads(by[1, "b", "tool"]["message"])["content"] == 'say "hi"'
    assert json.loads(by[2, "a", "assistant"]["message"])["tool_calls"][0]["arguments"]["text"] == 'q"é'


def test_surrogates(spark):
    texts = [
        "call +1 (784) 555-8120 or 784-555-8120 now", "call +1 (784) 555-8120.", None, "", "clean text",
        "a.b@mail.example.com A.B@mail.example.com c.d@mail.example.com",
        "card 4539578763621486 ip 10.20.30.40 ssn 123-45-6789", 'token = "3f76bb46f51625a0" end',
        "Mr. John Smith met Frau Müller and г-жа Иванова. Mr. John Smith left.",
    ]
    df = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)], "doc_id long, text string, _row string")
    got = {r["doc_id"]: r for r in pii.replace_entities(df, "key").collect()}
    assert len(got) == len(texts) and [got[i]["text"] for i in (2, 3, 4)] == texts[2:5]
    phone = re.fullmatch(r"call (\+1 \(\d{3}\) \d{3}-\d{4}) or (\d{3}-\d{3}-\d{4}) now", got[0]["text"])
    assert got[1]["text"] == f"call {phone[1]}." and "8120" not in got[0]["text"]
    mails = got[5]["text"].split()
    assert mails[0] == mails[1] != mails[2] and mails[0].endswith(".com")
    number = re.search(r"card (\d{16}) ip \d+\.\d+\.\d+\.\d+ ssn \d{3}-\d\d-\d{4}", got[6]["text"])[1]
    digits = [int(c) for c in number[::-1]]
    assert sum(digits[::2] + [sum(divmod(2 * d, 10)) for d in digits[1::2]]) % 10 == 0
    assert re.fullmatch(r'token = "[0-9a-z]{16}" end', got[7]["text"]) and "3f76" not in got[7]["text"]
    names = re.fullmatch(r"Mr\. (\w+ \w+) met Frau (\w+) and г-жа (\w+)\. Mr\. (\w+ \w+) left\.", got[8]["text"])
    assert names and names[1] == names[4] and re.fullmatch("[А-я]+", names[3])
    again = {r["doc_id"]: r["text"] for r in pii.replace_entities(df, "key").collect()}
    other = {r["doc_id"]: r["text"] for r in pii.replace_entities(df, "other").collect()}
    assert again == {i: r["text"] for i, r in got.items()} and other[0] != again[0]


def test_many_surrogates_stay_distinct(spark):
    rows = [("male", f"N{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(600)]
    rows += [("ip", f"1.2.3.{i}") for i in range(250)]
    got = pii.surrogate_table(spark.createDataFrame(rows, "kind string, canonical string"), "k").collect()
    assert len(got) == 850 == len({(r["kind"], r["surrogate"]) for r in got})
    assert not {(r["kind"], r["surrogate"]) for r in got} & set(rows)


def test_licences(spark):
    draw = random.Random(9)
    words = [f"w{i}" for i in range(200)] + ["the", "of", "work", "under"]
    rows = [(i, "\n".join(" ".join(draw.choices(words, k=20)) for _ in range(3))) for i in range(200)]
    notices = {500: "Licensed under the Apache License, Version 2.0", 501: "Released under the MIT License",
               502: "This work is licensed under the GNU General Public License, version 3",
               503: "Licensed under CC BY-NC 4.0"}
    rows += [(i, f"{rows[i - 500][1]} {t} tail") for i, t in notices.items()]
    rows += [(600, None), (601, ""), (602, "the license of a driver"), (None, notices[500])]
    got = licences.licence_notices(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["family"]) for r in got} == {
        (500, "Apache-2.0"), (501, "MIT"), (502, "GPL-3.0"), (503, "CC-BY-NC"), (None, "Apache-2.0")}


WRAPPED = {
    "MIT": "/*\n * Permission is hereby granted, free of charge, to any person obtaining a copy\n"
    " * of this software and associated documentation files (the \"Software\"), to deal\n"
    " * in the Software without restriction, including without limitation the rights\n */\nint x;",
    "BSD": "# Redistribution and use in source and binary forms, with or without\n"
    "# modification, are permitted provided that the following conditions are\n# met:\n#\n# 1. more",
    "GPL-3.0": "dnl This program is free software: you can redistribute it\r\ndnl and/or modify it under "
    "the terms of the GNU General\r\ndnl Public License as published by the Free Software\r\n"
    "dnl Foundation, either version 3 of the License",
}


def test_wrapped_licences(spark):
    draw = random.Random(9)
    words = [f"w{i}" for i in range(200)] + ["the", "of", "work", "under"]
    rows = [(i, "\n".join(" ".join(draw.choices(words, k=20)) for _ in range(3))) for i in range(200)]
    rows += [(500 + i, f"{rows[i][1]}\n{t}") for i, t in enumerate(WRAPPED.values())]
    rows += [(600, "Released under the MIT License\nReleased under the MIT License\n"
              "Licensed under the Apache License, Version 2.0\nLicensed under CC BY-NC 4.0")]
    got = licences.licence_notices(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["family"]) for r in got) == [
        *((500 + i, family) for i, family in enumerate(WRAPPED)),
        (600, "Apache-2.0"), (600, "CC-BY-NC"), (600, "MIT"), (600, "MIT")]


def test_licences_where_their_words_are_common(spark):
    draw = random.Random(10)
    words = [f"w{i}" for i in range(200)] + "released under the mit license licensed".split()
    rows = [(i, " ".join(draw.choices(words, k=20)) + f" {draw.choice(words[200:])}") for i in range(300)]
    rows += [(i, "license mit x released y the under z licensed apache version work") for i in range(300, 400)]
    rows += [(500, "a b Released under the MIT License c d"), (501, "Licensed under CC BY-NC 4.0")]
    got = licences.licence_notices(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["family"]) for r in got} >= {(500, "MIT"), (501, "CC-BY-NC")}
    assert {r["doc_id"] for r in got} == {500, 501}


def test_needed_words_lose_no_place():
    templates = [licences._template_grams(t) for ts in licences.TEMPLATES.values() for t in ts]
    for share in (0.1, 0.5, 1.0):
        needed = set(licences._needed_words(templates, share))
        for grams in templates:
            assert sum(needed.isdisjoint(g.split(" ")) for g in grams) < share * len(grams)


def test_tool_tables_hold_whole_turns(spark):
    texts = [f"turn {i} " + "long \"text\" \\ " * 20 + "end" for i in range(36)]
    rows = [(1, i, "assistant" if i % 3 == 2 else "user" if i % 3 else "system", t)
            for i, t in enumerate(texts)]
    calls, results = tool_tables(spark.createDataFrame(
        rows, "conv_id long, turn int, role string, text string"))
    found = {r["turn"]: r for r in calls.collect()} | {r["turn"]: r for r in results.collect()}
    assert sorted(found) == list(range(36))
    for i, text in enumerate(texts):
        if i % 3 == 2:
            assert found[i]["content"] == text
        else:
            given = json.loads(found[i]["arguments"])
            assert text in [given.get("query"), given.get("text"), *(
                x.get("text") for x in given.get("inputs", []))], found[i]["tool"]
    assert {r["tool"] for r in calls.collect()} == set(TOOLS)
    got = chat.link_tool_calls(calls, results, TOOLS)
    assert got.count() == 36


def labelled(spark, toxic_words, more=()):
    """400 documents, every eighth of them toxic, and others with their labels."""
    draw = random.Random(4)
    words = [f"word{chr(97 + i % 26)}{i}" for i in range(200)]
    rows = []
    for i in range(400):
        text = draw.choices(words, k=40)
        for _ in range(0 if i % 8 else 3):
            text[draw.randrange(40)] = draw.choice(toxic_words)
        rows.append((i, " ".join(text), int(i % 8 == 0)))
    rows += [(1000 + i, f"{t} " + " ".join(draw.choices(words, k=40)), bad) for i, (t, bad) in enumerate(more)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return docs.drop("toxic"), docs.drop("text")


def test_misspelled_forms_of_a_stem(spark):
    forms = ["idiot", "idiots", "idiotic", "idiotie", "idioten"]
    model = toxicity.train(*labelled(spark, forms))
    assert model.stems and all(any(f.startswith(s) for s in model.stems) for f in forms)
    lexicon = toxicity.Lexicon(model)
    for word in ("idoit", "ldiot", "ldiotic", "idjotish"):
        assert lexicon.match(word)[1] == 1, word
    assert lexicon.match("idiotish")[1] == 0 and lexicon.match("worda0") is None


def test_one_clean_use_does_not_clear_a_misspelling(spark):
    more = [("stupld", 1)] * 4 + [("stupld", 0)] + [("stapid", 0)] * 3 + [("stapid", 1)]
    model = toxicity.train(*labelled(spark, ["stupid", "disgusting"], more))
    assert "stupid" in model.words and "stupld" not in model.words
    assert "stupld" not in model.clean and "stapid" in model.clean
    lexicon = toxicity.Lexicon(model)
    assert lexicon.match("stupld")[:2] == ("stupid", 1) and lexicon.match("stapid") is None


def test_mixed_documents_of_null_and_repeated_ids(spark):
    import corpus_pipeline

    rows = [(None if i % 3 == 0 else i // 4, f"t{i} " * (i + 1), f"s{i % 3}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    table = mixing.numbered(docs)
    mix = mixing.mix_sources(table, block_words=16, shard_slots=8)
    of_row = {r["row_id"]: r["taken"] for r in mixing.taken_words(mix).collect()}
    want = {r["text"].split()[0]: of_row.get(r[mixing.ROW_ID], 0) for r in table.collect()}

    def words(mixed):
        got = collections.Counter()
        for r in mixed.collect():
            own = (r["text"] or "").split()
            assert len(set(own)) <= 1
            got.update(own)
        return got

    mixed = mixing.mixed_documents(table, mix)
    assert mixed.columns == docs.columns
    assert words(mixed) == collections.Counter({w: n for w, n in want.items() if n})
    slots = " ".join(r["text"] for r in mixing.mixed_blocks(table, mix).collect())
    assert collections.Counter(slots.split()) == words(mixed)
    stage = corpus_pipeline.mix_to_weights(spark, docs, "")
    assert stage.columns == docs.columns
    taken = words(stage)
    assert all(n <= 2 * (int(w[1:]) + 1) for w, n in taken.items())
    assert abs(sum(taken.values()) - 1.5 * sum(range(1, 61))) <= 2
    with pytest.raises(ValueError):
        mixing.mixed_documents(docs, mixing.mix_sources(docs))


def test_near_copies_of_null_ids(spark):
    base = [f"b{i}" for i in range(60)]
    rows = [(None if i % 2 else i, " ".join([*base[:-1], f"n{i}"]), *(None,) * 6) for i in range(3)]
    far = base[:30] + ["x"] + base[31:]  # only the row of NULL id is near to both others
    rows += [(10, " ".join(f"c{i}" for i in range(80)), *(None,) * 6),
             (None, " ".join([*(f"c{i}" for i in range(77)), "y1", "y2", "y3"]), *(None,) * 6),
             (11, " ".join([*(f"c{i}" for i in range(70)), *["y0"] * 7, "y1", "y2", "y3"]), *(None,) * 6),
             (12, " ".join(far), *(None,) * 6), (None, " ".join(far) + " z", *(None,) * 6),
             (None, " ".join(far) + " z", *(None,) * 6)]
    chain = [f"d{i}" for i in range(100)]
    rows += [(20, " ".join(chain), *(None,) * 6), (None, " ".join(chain[8:] + [f"e{i}" for i in range(8)]), *(None,) * 6),
             (21, " ".join(chain[16:] + [f"e{i}" for i in range(16)]), *(None,) * 6)]
    want = components_of(rows)
    assert want[None, 96, 20] and want[21, 96, 20]
    got = jaccard_join.similar_components(spark.createDataFrame(rows, DOCS))
    assert collections.Counter(
        map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == want


def test_surrogates_of_further_mentions(spark):
    texts = ["Mr. John Smith met Ann. Smith said no, John Smith left, Mr. Smith and Mrs. Smith; Smithson stays.",
             "password: q7+x.Y9z then q7+x.Y9z again, and q7+xxY9z", "John and Smith here stay", "Mr. Smith"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.replace_entities(df, "key").collect()}
    names = re.fullmatch(
        r"Mr\. (\w+) (\w+) met Ann\. (\w+) said no, (\w+) (\w+) left, Mr\. (\w+) and Mrs\. (\w+); "
        r"Smithson stays\.", got[0])
    first, last = names[1], names[2]
    assert first != "John" and last != "Smith" and names[4] == first
    assert {names[i] for i in (3, 5, 6, 7)} == {last} and got[3] == f"Mr. {last}"
    secret = re.fullmatch(r"password: (\S+) then (\S+) again, and q7\+xxY9z", got[1])
    assert secret[1] == secret[2] != "q7+x.Y9z" and got[2] == texts[2]


def test_nearest_at_any_scale(spark):
    """Cosines do not depend on the lengths of vectors, however large or small."""
    draw = np.random.default_rng(12)
    vectors = draw.normal(size=(300, 8))
    norms = np.sqrt((vectors**2).sum(axis=1))
    cosines = vectors @ vectors.T / np.outer(norms, norms)
    for factors in ([1.0], [1e200], [1e-200], [1.0, 1e200], [1e-300, 1e150, 3.0]):
        rows = [(i, [float(x) for x in v * factors[i % len(factors)]]) for i, v in enumerate(vectors)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        found = ann.nearest(df, df.where("vec_id % 50 = 0"), 5, cell_rows=64).collect()
        for q in range(0, 300, 50):
            want = [i for i in np.argsort(-cosines[q]).tolist() if i != q][:5]
            got = sorted((r["rank"], r["vec_id"]) for r in found if r["query_id"] == q)
            assert [v for _, v in got] == want


def test_caches_of_other_operators_are_emptied():
    from trailmine.llm import common

    first, second = {"a": 1}, {"b": 2}
    common.use_cache("first", first.clear)
    assert first
    common.use_cache("second", second.clear)
    assert not first and second
    first["c"] = 3
    common.use_cache("first", first.clear)
    assert first and not second


def test_columns_of_the_mix_query(spark):
    import os

    from trailmine.llm.queries import op1_mix_sources

    if os.path.exists("/root/testdata/sf0.001"):
        mix = op1_mix_sources(spark, "/root/testdata/sf0.001")
        assert mix.columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]


def test_toxic_stage_keeps_all_columns(spark, docs, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(corpus_pipeline, "toxicity_model", lambda *_: None)
    monkeypatch.setattr(toxicity, "toxic_score", lambda _, c: F.when(c.isNull(), 0.9).otherwise(0.1))
    given = docs.withColumn("_score", F.lit("kept"))
    left = corpus_pipeline.drop_toxic(spark, given, "")
    assert left.columns == given.columns
    assert left.count() == given.where("text IS NOT NULL").count()
    assert {r["_score"] for r in left.collect()} == {"kept"}


def test_licences_of_other_names_and_negations(spark):
    right = {
        "Released under the MIT License": "MIT",
        "SPDX-License-Identifier: MIT": "MIT",
        "// SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
        "Licensed under the Apache License, Version 2.0": "Apache-2.0",
        "This work is licensed under the GNU General Public License, version 3": "GPL-3.0",
        "Licensed under CC BY-NC 4.0": "CC-BY-NC",
        "Licensed under CC BY 4.0": "CC-BY",
        "This project is licensed under the Apache License": None,
        "This project is licensed under the ISC License": None,
        "This project is licensed under the Unlicense License": None,
        "The software is NOT released under the MIT License": None,
        "This project is not licensed under the MIT License": None,
        "This work is licensed under the GNU Affero General Public License, version 3": None,
        "This work is licensed under the GNU General Public License, version 2": None,
        "Licensed under CC BY-SA 4.0": None,
        "SPDX-License-Identifier: ISC": None,
    }
    docs = spark.createDataFrame(
        [(i, f"some words before it\n\n{t}\n\nand after", *(None,) * 6) for i, t in enumerate(right)],
        DOCS)
    got = {r["doc_id"]: r["family"] for r in licences.licence_notices(docs).collect()}
    assert [got.get(i) for i in range(len(right))] == list(right.values())


def test_surrogates_beside_a_column_of_the_same_name(spark):
    docs = spark.createDataFrame(
        [(1, "write to a.long.name@example.org", 7), (2, "nothing", 8)],
        "doc_id long, text string, n_entities long")
    got = pii.replace_entities(docs, "key").orderBy("doc_id").collect()
    assert [(r["n_entities"], r["_n_entities"]) for r in got] == [(7, 1), (8, 0)]
    assert "a.long.name" not in got[0]["text"]


def test_names_of_many_forms(spark):
    texts = ["Mr. John Q. Smith came. Smith left.", "Mr. O'Neil and Mr. McDonald.", "Mr. Smith left.",
             "Mrs. Jane Doe-Miller sang.", "Mme Élise de la Tour et Mme de la Tour.", "Mr. van stays."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.replace_entities(df, "key").collect()}
    forms = [r"Mr\. (\w+) Q\. (\w+) came\. (\w+) left\.", r"Mr\. (\w+) and Mr\. (\w+)\.",
             r"Mr\. (\w+) left\.", r"Mrs\. (\w+) (\w+) sang\.",
             r"Mme (\w+) de la (\w+) et Mme de la (\w+)\.", r"Mr\. van stays\."]
    names = [re.fullmatch(form, got[i]).groups() for i, form in enumerate(forms)]
    assert names[0][1] == names[0][2] == names[2][0] and names[4][1] == names[4][2]
    real = {"John", "Smith", "O", "Neil", "McDonald", "Jane", "Doe", "Miller", "Élise", "Tour"}
    assert not real & {name for found in names for name in found}
