import random

from tidecast.llm.components import components, forest


def test_both_paths_give_the_smallest_node(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5), (None, 4)]
    want = forest((a, b) for a, b in pairs if a is not None and a != b)
    edges = spark.createDataFrame(pairs, "a long, b long")
    for per_task in (10_000, 40):
        assert {r.node: r.root for r in components(edges, per_task).collect()} == want


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
