import random
import re

from engramlake.llm import copies, survivors

SCHEMA = "id string, content string, tags array<string>"


def key(content, tags):
    plain = lambda s: re.sub(r"[\W_]+", "", s.casefold())
    return plain(content), tuple(sorted({plain(t) for t in tags or []} - {""}))


def brute(rows):
    groups = {}
    for i, c, t in rows:
        if c is not None:
            groups.setdefault(key(c, t), []).append(i)
    return {(min(g), i) for g in groups.values() for i in g if i != min(g)}


def test_random_with_a_hot_group(spark):
    r = random.Random(3)
    words = ["Tea", "tea ", "TEA!", "t-e-a", "coffee", "Co ffee", "straße", "STRASSE", "", "...", None]
    tags = [None, [], ["a"], ["A "], ["b", "a"], ["a", "B", "b"], [" "]]
    rows = [(f"i{k:03d}", r.choice(words), r.choice(tags)) for k in range(200)] + [(f"h{k:03d}", " ".join("hot"[: 1 + k % 3]) + "hot"[1 + k % 3 :], None) for k in range(150)]
    df = spark.createDataFrame(rows, SCHEMA)
    for parts in (1, 7):
        assert {(x["kept_id"], x["id"]) for x in copies.copy_members(df, partitions=parts).collect()} == brute(rows)
        kept = {x["kept_id"]: x["copies"] for x in copies.copy_groups(df, partitions=parts).collect()}
        assert sum(kept.values()) == len(rows) and kept["h000"] == 150


def test_empty_repeated_ids_and_clashing_columns(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert copies.copy_members(df).count() == 0 and copies.copy_groups(df).count() == 0
    df = spark.createDataFrame([("a", "x", None), ("a", "x", []), ("b", "X", None), (None, "q", None)], SCHEMA).selectExpr("*", "'k' as key", "1 as run", "2 as part", "3 as rep")
    assert {tuple(r) for r in copies.copy_members(df).collect()} == {("a", "b")}
    long = spark.createDataFrame([("a", "x" * 300_000, None), ("b", "X " * 300_000, None)], SCHEMA)
    assert copies.copy_members(long).count() == 1


def test_survivors(spark):
    schema = SCHEMA + ", created_at bigint, updated_at bigint, relevance double, source string, access_count bigint"
    rows = [
        ("a", "x", None, 10, 20, 0.5, "curator", 5), ("b", "X", None, 10, 30, 1.5, "manual", 5), ("c", "x.", None, 10, 5, None, "Seed", -1),
        ("d", "y", None, None, 7, float("nan"), None, None), ("e", "Y", None, 1, None, -0.1, "", 2**40), ("f", "z", None, 1, 1, 1.0, "seed", 1),
    ]
    df = spark.createDataFrame(rows, schema)
    assert {tuple(r) for r in survivors.found(df).collect()} == {("a", "updated_at", "b"), ("a", "relevance", "a"), ("a", "source", "b"), ("a", "access_count", "a")}
    row = survivors.survivors(df).where("group_id = 'a'").first()
    assert (row["relevance"], row["access_count"]) == (0.5, 5)
    assert survivors.found(df.where("false")).count() == 0
