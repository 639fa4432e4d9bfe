from engramlake.operators import curation


def test_each_proposal_once_a_cycle(spark):
    rows = [("c1", "a", "update", "h1", 4), ("c1", "a", "update", "h1", 2), ("c1", "a", "update", "h2", 3), ("c1", "a", "deprecate", "h1", 5), ("c1", "b", "update", "h1", 6), ("c2", "a", "update", "h1", 9)]
    got = curation.first_in_cycle(spark.createDataFrame(rows, "reply string, id string, kind string, hash string, line_no int"), "reply", "line_no")
    assert {tuple(r) for r in got.select("reply", "id", "kind", "hash", "line_no").collect()} == {*rows} - {rows[0]}
