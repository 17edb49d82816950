"""What the search for components and op7 leave in the driver and in the shared folder."""

import os
import random

from volmesh.llm import ngram_join
from volmesh.llm.components import components
from volmesh.llm.shared import checkpoint_dir


def test_estimates_stay_small(spark):
    """A path takes several rounds; the planner's size of the labels stays a sum of the rounds' digits."""
    r = random.Random(5)
    ids = r.sample(range(10**9), 600)
    got = components(spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long"))
    size = got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert size.bit_length() < 500
    rows = got.collect()
    assert sorted(x.node for x in rows) == sorted(ids) and len({x.label for x in rows}) == 1


def test_steps_are_deleted(spark):
    def tables():
        at = checkpoint_dir(spark).removeprefix("file:")
        return {x for x in os.listdir(at) if x.startswith("step-")}

    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join([*words, f"x{i}"])) for i in range(80)] + [(900, None), (901, "alone")], "doc_id long, text string").repartition(3)
    before = tables()
    got = ngram_join.near_duplicates(docs)
    assert len(tables() - before) == 3  # the sets, the classes and their components, which the result reads
    rows = sorted((x.key, x.component_id) for x in got.collect())
    assert rows == [(i, 0) for i in range(80)] + [(900, 900), (901, 901)]
