import random

from spark_climbs.operators.graph import components


def test_components(spark):
    rnd = random.Random(7)
    edges = [(rnd.randrange(120), rnd.randrange(120)) for _ in range(90)] + [(200 + k, 201 + k) for k in range(40)] + [(300, 300)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    got = {r.vertex: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent}
