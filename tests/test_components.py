"""Connected components by contraction, against a union-find."""

import random

from entityfusion.plans.tables import Tables, components


def least_reachable(nodes, edges):
    at = {n: n for n in nodes}

    def find(x):
        while at[x] != x:
            at[x] = at[at[x]]
            x = at[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def labels(spark, nodes, edges):
    df = spark.createDataFrame([(n,) for n in nodes], "node bigint")
    return {r["node"]: r["label"] for r in components(df, spark.createDataFrame(edges, "a bigint, b bigint"), Tables(spark, "t")).collect()}


def test_star_and_chains(spark):
    """A star of 100,000 leaves whose hub is no least node, a chain of 1,000 in order and one in disorder."""
    order = list(range(10_000, 11_000))
    random.Random(1).shuffle(order)
    edges = [(500_000, 100_000 + i) for i in range(100_000)] + [(i, i + 1) for i in range(1000)] + list(zip(order, order[1:]))
    nodes = sorted({n for e in edges for n in e})
    assert labels(spark, nodes, edges) == least_reachable(nodes, edges)


def test_random_graphs(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(7, 7)]
    assert labels(spark, range(401), edges) == least_reachable(range(401), edges)
    assert labels(spark, [1, 2], []) == {1: 1, 2: 2} and labels(spark, [], []) == {}
