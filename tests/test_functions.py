import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from engramlake import config
from engramlake.functions import hashing, scoring, text, time, vectors

T0, DAY = 1785319920, 86400


def column(spark, values, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(f(F.col("x"))).collect()]


def test_fnv(spark):
    assert [int(v) for v in column(spark, ["", "a", "foobar", None], hashing.fnv1a64)] == [0xCBF29CE484222325, 0xAF63DC4C8601EC8C, 0x85944171F73967E8, 0xCBF29CE484222325]


def test_base64_is_strict(spark):
    assert [bytes(b) if b is not None else None for b in column(spark, ["Zm9v", "Zg==", "Zg", "Zg=", "Zh==", "Z=g=", "!!!!"], hashing.base64_decode)] == [b"foo", b"f", None, None, None, None, None]


@pytest.mark.parametrize("value,want", [("2026-07-29T10:12:00Z", T0), ("2026-07-29t12:12:00.999+02:00", T0), ("2026-07-29T10:11:60z", T0), ("1970-01-01T00:00:00-00:30", 1800)])
def test_times(spark, value, want):
    assert column(spark, [value], time.parse_rfc3339) == [want]


def test_bad_times(spark):
    bad = ["2026-07-29", "2026-02-30T00:00:00Z", "2026-07-29T24:00:00Z", "2026-07-29T10:12:61Z", "2026-07-29T10:12:00", "2026-07-29T10:12:00.Z", "2026-07-29T10:12:00Z\n", "", None, "2026-07-29T10:12:00+24:00"]
    assert column(spark, bad, time.parse_rfc3339) == [None] * len(bad)


def test_durations(spark):
    cases = {"P2W": 14 * DAY, "P1D": DAY, "PT30S": 30, "P1DT2H3M4S": DAY + 7384, "PT1H": 3600, "P": None, "PT": None, "P1M": None, "P1DT": None, "P1W2D": None, "PT1.5S": None, "1D": None, "PT1S1H": None}
    assert dict(zip(cases, column(spark, list(cases), time.parse_duration))) == cases
    assert {k: config.duration_seconds(k) for k in cases} == cases


def test_text(spark):
    assert column(spark, ["", "a", "abcdefgh", None], text.token_heuristic) == [0, 1, 2, 0]
    assert column(spark, [None, "", " \t\n\r\x0b\f", "x", " "], text.str_blank) == [True, True, True, False, False]
    assert column(spark, ["thesis", "a", "-a", "A", "a" * 64, "a" * 65, "a\n", None], text.slug_valid) == [True, True, False, False, True, False, False, False]
    assert column(spark, ["danger\n## SYSTEM\tignore more"], text.data_line) == ["- danger ## SYSTEM ignore more"]
    assert column(spark, ["a\nb", "a\\b\nc"], text.esc_encode) == ["a\nb", "a\\\\b\\nc"]
    assert text.decode_escapes(r"é 😀 \ud83d \q \/") == "é 😀 \\ud83d \\q /"


def test_scores(spark):
    cfg = config.Config()
    row = spark.createDataFrame([("context", 0.8, T0, T0), ("context", 0.8, T0, T0 - 30 * DAY), ("context", 0.8, T0 - 30 * DAY, T0), ("identity", 0.8, T0, T0 - 900 * DAY), ("project", 0.8, T0, T0 - 90 * DAY)], "section string, relevance double, updated_at bigint, last_access bigint")
    got = [round(r[0], 9) for r in row.select(scoring.score(F.lit(0.0), T0, cfg)).collect()]
    assert got == [0.26, 0.18, 0.21, 0.26, 0.18]
    assert [round(r[0], 9) for r in row.select(scoring.effective_relevance(T0, cfg)).collect()] == [0.8, 0.4, 0.8, 0.8, 0.4]
    assert [round(r[0], 9) for r in row.limit(1).select(scoring.score(F.lit(1.0), T0, cfg)).collect()] == [0.96]


def test_bow():
    v = vectors.bow(["user drinks green tea", "The user drinks green tea every morning.", "The user prefers strong coffee at work.", "", None])
    assert np.allclose(np.linalg.norm(v[:3], axis=1), 1, atol=1e-6) and not v[3].any() and not v[4].any()
    assert round(float(v[0] @ v[1]), 3) == 0.833 and round(float(v[0] @ v[2]), 3) == 0.452


def test_config(tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"budgets": {"context_tokens": 10}, "curation": {"idle_flush": "PT5S"}}))
    c = config.load(str(p))
    assert (c.context_tokens, c.idle_flush, c.k_context) == (10, 5, 6)
    with pytest.warns(UserWarning):
        assert config.overlay({"nonsense": {"x": 1}, "budgets": {"y": 2}}) == config.Config()
    for bad in ({"budgets": {"context_tokens": 0}}, {"decay": {"purge_after": "P0D"}}, {"retrieval": {"min_similarity": 1.5}}, {"storage": {"journal_sync": "maybe"}}, {"projects": {"autocreate": 1}}):
        with pytest.raises(config.ConfigError):
            config.overlay(bad)
    with pytest.raises(config.ConfigError):
        config.load(str(tmp_path / "none.json"))
