import random

from pyspark.sql import functions as F

from engramlake.operators.running import numbered
from engramlake.plans import memory


def test_all_identity_rows_have_a_place(spark, small, tmp_path):
    r = random.Random(5)
    schema = spark.read.parquet(f"{small}/asper_record.parquet").schema
    rows, want = [], []
    for k in range(200):
        key = (r.random() < 0.2, r.choice([0.2, 0.5, 1.0]), r.randint(1, 20), f"{r.getrandbits(128):032x}")
        row = dict.fromkeys(schema.names) | {"section": "identity", "content": "be brief", "locked": key[0], "relevance": key[1], "created_at": key[2], "deprecated": k % 10 == 0}
        row["id"] = "-".join(key[3][a:b] for a, b in ((0, 8), (8, 12), (12, 16), (16, 20), (20, 32)))
        rows.append(tuple(row[c] for c in schema.names))
        if k % 10:
            want.append((not key[0], -key[1], key[2], row["id"]))
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/asper_record.parquet")
    got = {x["id"]: x["place"] for x in memory.identity_order(spark, str(tmp_path)).collect()}
    assert got == {x[3]: n for n, x in enumerate(sorted(want), 1)} and len(got) == 180


def test_numbered_of_nothing_and_of_equals(spark):
    df = spark.range(50).select((F.col("id") % 2).alias("a"), "id")
    assert numbered(df.where("false"), [F.col("a")]).count() == 0
    assert sorted(x["place"] for x in numbered(df, [F.desc("a")]).collect()) == list(range(1, 51))
