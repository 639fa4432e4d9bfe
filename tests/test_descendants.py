import random

import pytest

from engramlake.operators import hierarchy as H


def brute(rows):
    """All pairs by walking up from each node until a node comes again."""
    ids, up = {i.lower(): i for i, _ in rows}, {i.lower(): (p or "").lower() for i, p in rows}
    out = set()
    for k in up:
        seen, x = {k}, k
        while (x := up[x]) in up and x not in seen:
            seen.add(x)
            out.add((ids[x], ids[k], len(seen) - 1))
    return out


def pairs(spark, rows, bound):
    df = spark.createDataFrame(rows, "id string, supersedes string")
    got = [tuple(r) for r in H.descendants(H.hierarchy(df, residual_rows=bound)).collect()]
    assert len(got) == len(set(got))
    sent = [tuple(r) for r in H.successors(df, residual_rows=bound).collect()]
    assert sorted(sent) == sorted(got)
    return set(got)


@pytest.mark.parametrize("bound", [10_000, 3, 0])
def test_successors_on_and_below_circles(spark, bound):
    # c -> b -> A -> c is a circle; t1 to t3 hang below b, s on itself, u below s; p and q are an ordinary tree
    rows = [("A", "C"), ("b", "a"), ("c", "b"), ("t1", "b"), ("t2", "t1"), ("t3", "T1"), ("s", "s"), ("u", "s"), ("p", None), ("q", "p")]
    got = pairs(spark, rows, bound)
    assert got == brute(rows)
    assert {x for x in got if x[0] == "t1"} == {("t1", "t2", 1), ("t1", "t3", 1)} and ("c", "t2", 4) in got and ("b", "A", 2) in got


@pytest.mark.parametrize("bound", [10_000, 4, 0])
def test_random_successors(spark, bound):
    r = random.Random(bound + 1)
    names = [f"n{k:02d}" for k in range(40)]
    rows = [(n, r.choice([*names, None, "gone"])) for n in names]
    ring = [f"r{k}" for k in r.sample(range(10), 9)]
    rows += [(x, ring[k - 1]) for k, x in enumerate(ring)] + [(f"w{k}", r.choice([*ring, *(f"w{j}" for j in range(k))])) for k in range(12)]
    assert pairs(spark, rows, bound) == brute(rows)


def test_a_chain_of_forty_thousand(spark):
    rows = spark.range(40_000).selectExpr("concat('c', id) as id", "if(id = 0, null, concat('C', id - 1)) as supersedes")
    got = H.found(rows)
    assert got.count() == 39_999
    assert [tuple(r) for r in got.where("depth >= 39998").orderBy("depth").collect()] == [("c39998", "c0", 39_998), ("c39999", "c0", 39_999)]
    short = rows.where("id < 'c2' and length(id) <= 4")  # c0, c1, c10 to c199 of three digits or less
    assert H.successors(short).where("id = 'c100'").count() == 99
