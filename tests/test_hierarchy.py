import random

import pytest

from engramlake.operators import hierarchy as H


def brute(rows):
    ids = {}
    for i, p in sorted(((i, p or "") for i, p in rows if i), key=lambda r: (r[0], r[1])):
        ids.setdefault(i.lower(), (i, p.lower() or None))
    out = {}
    for k, (i, _) in ids.items():
        path, x = [k], k
        while (p := ids[x][1]) in ids and p not in path:
            path.append(p)
            x = p
        if p in ids and p in path:
            out[i] = (min(ids[y][0] for y in path[path.index(p) :]), -1)
        else:
            out[i] = (ids[x][0], len(path) - 1)
    return out


def check(spark, rows, bound):
    df = spark.createDataFrame(rows, "id string, supersedes string")
    got = H.hierarchy(df, residual_rows=bound).collect()
    want = brute(rows)
    assert {r["id"]: (r["root"], r["depth"]) for r in got} == want
    for r in got:
        if r["depth"] >= 0:
            assert r["path"][0] == r["root"] and r["path"][-1] == r["id"] and len(r["path"]) == r["depth"] + 1
        else:
            assert r["path"] is None and r["into_circle"]
    sizes = {r["id"]: r["subtree_size"] for r in got}
    for r in got:
        if r["depth"] >= 0:
            assert sizes[r["id"]] == sum(1 for o in got if o["path"] and r["id"] in o["path"])


@pytest.mark.parametrize("bound", [10_000, 3, 0])
def test_random_forests_and_circles(spark, bound):
    r = random.Random(bound)
    names = [f"n{k:02d}" for k in range(40)]
    check(spark, [(n, r.choice([*names, None, "", "gone"])) for n in names], bound)


@pytest.mark.parametrize("bound", [10_000, 2])
def test_cases(spark, bound):
    check(spark, [("a", None), ("B", "A"), ("c", "b"), ("d", "d"), ("e", "d"), ("f", "zz"), (None, "a"), ("", "a"), ("c", "b"), ("a", None)], bound)


def test_hub_and_chain(spark):
    rows = [("hub", None)] + [(f"h{k}", "hub") for k in range(300)] + [("c0", "hub")] + [(f"c{k}", f"c{k - 1}") for k in range(1, 12)]
    df = spark.createDataFrame(rows, "id string, supersedes string")
    placed = H.hierarchy(df, residual_rows=20)
    assert placed.where("id = 'hub'").first()["subtree_size"] == len(rows)
    assert H.descendants(placed).where("id = 'hub'").count() == len(rows) - 1
    assert H.descendants(placed).where("id = 'c3'").count() == 8


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], "id string, supersedes string, key string, parent string, size int, root string, depth int")
    assert H.hierarchy(df).count() == 0 and H.found(df).count() == 0
    df = spark.createDataFrame([("b", "a", "x", 1), ("a", None, None, None)], "id string, supersedes string, key string, root int")
    assert [tuple(r) for r in H.found(df).collect()] == [("b", "a", 1)]
