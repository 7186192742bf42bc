"""Path doubling against a walk level by level."""

import random
from collections import deque

from tidemark.sources import folders

EDGES = "parent string, child string"


def walked(edges, root):
    below, seen, queue = {}, {root: 0}, deque([root])
    for p, c in edges:
        below.setdefault(p, []).append(c)
    while queue:
        f = queue.popleft()
        for c in below.get(f, ()):
            if c is not None and c not in seen:
                seen[c] = seen[f] + 1
                queue.append(c)
    return seen


def got(spark, edges, root):
    found, rounds = folders.walk_doubling(spark.createDataFrame(edges, EDGES), root)
    rows = found.collect()
    assert len(rows) == len({r.folder for r in rows})
    return {r.folder: r.depth for r in rows}, rounds


def test_a_chain_of_ten_thousand(spark):
    edges = [(str(i), str(i + 1)) for i in range(10_000)]
    random.Random(1).shuffle(edges)
    found, rounds = got(spark, edges, "0")
    assert found == {str(i): i for i in range(10_001)} and rounds < 20


def test_any_graph(spark):
    for seed in range(6):
        rng = random.Random(seed)
        n = rng.choice([3, 12, 40])
        tree = [(str(rng.randrange(i)), str(i)) for i in range(1, n)]
        odd = [(str(rng.randrange(n + 5)), str(rng.randrange(n + 5))) for _ in range(rng.choice([0, 2, n]))]  # other ways, loops, circles, strangers
        edges = [*tree, *odd, *tree[:3], (None, "1"), ("2", None), ("far", "farther"), ("c1", "c2"), ("c2", "c3"), ("c3", "c1")]
        rng.shuffle(edges)
        for root in ("0", "1", "c2", "nobody"):
            assert got(spark, edges, root)[0] == walked(edges, root), (seed, root)


def test_no_edges(spark):
    assert got(spark, [], "r") == ({"r": 0}, 1)
