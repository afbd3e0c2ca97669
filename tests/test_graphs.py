"""Closures, cycles and paths on graphs of any depth."""

import random
import time

from veritrail.operators import dedupe, integrity, ledger


def reached(pairs):
    out = {}
    for start in {a for a, _ in pairs}:
        depth, level, n = {}, {start}, 0
        while level:
            n += 1
            level = {b for a, b in pairs if a in level} - set(depth)
            depth |= dict.fromkeys(level, n)
        out |= {(start, k): d for k, d in depth.items()}
    return out


def test_closure_of_any_graph(spark):
    rng = random.Random(3)
    for n, m in ((12, 14), (25, 60), (9, 40)):
        pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
        rows = dedupe.closure(spark.createDataFrame([*pairs, *list(pairs)[:3], (None, 1), (1, None)], "node int, next int")).collect()
        assert {(r["node"], r["reached"]): r["depth"] for r in rows} == reached(pairs) and len(rows) == len(reached(pairs))


def test_long_chains(spark):
    began = time.time()
    chain = spark.createDataFrame([(i, i + 1) for i in range(400)], "node int, next int")
    assert dedupe.closure(chain).count() == 400 * 401 // 2
    states = spark.createDataFrame([(f"s{i:02}", f"s{i + 1:02}") for i in range(20)], "previous string, state string")
    rows = ledger.paths(spark, states).collect()
    assert len(rows) == 210 and max(r["length"] for r in rows) == 20
    assert time.time() - began < 120


def test_cycles(spark):
    find = lambda pairs: {r["node"] for r in integrity.on_cycles(spark, spark.createDataFrame(pairs, "node int, parent int")).collect()}
    ring = [(i, (i + 1) % 50) for i in range(50)]
    assert find([*ring, *[(k + 1, k) for k in range(100, 160)], (100, 7), (500, 501), (501, None)]) == set(range(50))
    assert find([(1, 1), (2, 1), (3, 2)]) == {1} and find([(1, 2), (2, 3)]) == set() and find([]) == set()
    rng = random.Random(4)
    pairs = {(rng.randrange(15), rng.randrange(15)) for _ in range(22)}
    assert find(list(pairs)) == {a for a, b in reached(pairs) if a == b}
