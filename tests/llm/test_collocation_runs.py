"""Runs of counted phrases between tasks."""

import numpy as np

from trailmine.llm import collocations


def test_runs_become_rows_by_phrase_alone(spark):
    docs = spark.createDataFrame([("en", "a b a b. a c"), ("en", "a b")], "_lang string, _text string")
    counted = collocations.count_phrases(docs, (2,), {collocations.HOT: np.zeros(0, np.uint64)})
    assert sorted(map(tuple, counted.collect())) == [
        ("en", "a b", 3), ("en", "a c", 1), ("en", "b a", 1)]
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1
