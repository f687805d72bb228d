"""What tasks hold, and what is left in a worker behind them."""

import collections
import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle

from trailmine.llm import common, jaccard_join, toxicity


class Given:
    """Stands for a table: keeps the function that would run in the tasks, as they get it."""

    def __init__(self, schema):
        self.schema = schema

    def mapInPandas(self, run, schema):
        self.run = cloudpickle.loads(cloudpickle.dumps(run))
        return self


@pytest.fixture
def texts(spark):
    draw = random.Random(5)
    rows = [(i, " ".join(draw.choices("abcdefgh", k=draw.randint(0, 40)))) for i in range(60)]
    return spark.createDataFrame(rows, "_id long, _text string")


def test_other_operators_find_no_word_hashes_in_a_worker(texts):
    for step in (jaccard_join._first_pass, jaccard_join._sets):
        given = Given(texts.schema)
        step(given, 5)
        common.use_cache("none", lambda: None)
        list(given.run(iter([texts.toPandas()])))
        assert jaccard_join._hashes
        common.use_cache("other", lambda: None)
        assert not jaccard_join._hashes


def test_counting_terms_empties_caches_of_other_operators(texts):
    emptied = []
    common.use_cache("other", lambda: emptied.append(1))
    given = Given(texts.schema)
    with pytest.raises(AttributeError):  # goes on with a table of Spark's
        toxicity._term_counts(given)
    list(given.run(iter([pd.DataFrame({"text": ["a b"], "toxic": [1]})])))
    assert emptied == [1]


def test_repeated_shingles_need_little_memory():
    draw = np.random.default_rng(4)
    sets = [np.unique(draw.integers(0, 1 << 40, 500)) for _ in range(400)]
    sets += [np.concatenate([s[:250], s[250:] + 1]) for s in sets[:100]]
    counts = collections.Counter(x for s in sets for x in s.tolist())
    tracemalloc.start()
    found, seen = jaccard_join.repeated(sets)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert dict(zip(found.tolist(), seen.tolist(), strict=True)) == {
        x: n for x, n in counts.items() if n > 1}
    assert (found[1:] > found[:-1]).all()
    assert peak < 2 * sum(s.nbytes for s in sets)
    assert [len(x) for x in jaccard_join.repeated([])] == [0, 0]
