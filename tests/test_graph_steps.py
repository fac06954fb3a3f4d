"""Distances, triangles and communities against brute force, and how often their steps read the edges."""

import random
from collections import defaultdict, deque

from strandloom.operators import graphs as gr


def random_edges(seed, nodes=90, n=110):
    r = random.Random(seed)
    return [(f"n{r.randrange(nodes)}", f"n{r.randrange(nodes)}") for _ in range(n)]


def counted(spark, rows):
    """The edges, and how many of their rows were made."""
    made = spark.sparkContext.accumulator(0)

    def seen(row):
        made.add(1)
        return row

    return spark.sparkContext.parallelize(rows, 4).map(seen).toDF("src string, dst string"), made


def test_distances_of_many_sources_read_the_edges_once(spark):
    pairs = random_edges(1)
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    sources = sorted(near)[:70] + ["alone"]
    want = set()
    for s in sources:
        dist, queue = {s: 0}, deque([s])
        while queue:
            a = queue.popleft()
            for b in near[a]:
                if b not in dist:
                    dist[b] = dist[a] + 1
                    queue.append(b)
        want |= {(s, b, d) for b, d in dist.items()}
    edges, made = counted(spark, pairs)
    got = [tuple(r) for r in gr.distances(edges, spark.createDataFrame([(s,) for s in sources], "node string").coalesce(1)).collect()]
    assert len(got) == len(want) and set(got) == want
    assert made.value == len(pairs)


def test_triangles_shuffle_no_paths(spark):
    pairs = random_edges(2, 40, 330) + [("n0", f"n{k}") for k in range(40)] + [("n1", None), ("n2", "n2")]
    links = {tuple(sorted(p)) for p in pairs if p[1] is not None and p[0] != p[1]}
    names = sorted({a for p in links for a in p})
    want = {(a, b, c) for i, a in enumerate(names) for j, b in enumerate(names[i + 1 :], i + 1) if (a, b) in links for c in names[j + 1 :] if (a, c) in links and (b, c) in links}
    edges = spark.createDataFrame(pairs, "src string, dst string")
    for colours in (1, 3, 5):
        found = gr.triangles(edges, colours)
        got = [tuple(r) for r in found.collect()]
        assert len(got) == len(want) and set(got) == want and len(want) > 100
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan[: plan.index("FlatMapGroupsInArrow")] and "LeftSemi" not in plan


def test_colours_grow_with_the_root_of_the_edges():
    assert [gr.colours_of(n) for n in (0, 1_000_000, 69_000_000, 416_000_000)] == [4, 4, 6, 15]
