import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from engramlake.llm import neardup as N
from engramlake.llm.text import WORD, words


def brute(rows):
    kept = [(i, t) for i, t in rows if t is not None and len(words(t)) >= N.MIN_WORDS]
    same = lambda a, b: "".join(words(a)) == "".join(words(b))
    return {(min(i, j), max(i, j)) for x, (i, a) in enumerate(kept) for j, b in kept[x + 1 :] if not same(a, b) and N.similar(a, b) >= N.THRESHOLD}


def test_planted_edits(spark):
    r = random.Random(1)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 9))) for _ in range(400)]
    rows = [("n", None), ("e", ""), ("s", "too short")]
    for g in range(30):
        base = [r.choice(vocab) for _ in range(r.randint(15, 60))]
        for c in range(4):
            ws = list(base)
            for _ in range(r.randint(0, len(ws) // 8)):
                k = r.randrange(len(ws))
                ws[k : k + 1] = r.choice([[], [r.choice(vocab)], [ws[k], r.choice(vocab)]])
            if c == 3:
                r.shuffle(ws)
            rows.append((f"g{g:02d}-{c}", " ".join(ws)))
    rows += [("copy1", rows[5][1].upper() + "!"), ("copy2", rows[5][1])]
    df = spark.createDataFrame(rows, "id string, content string").selectExpr("*", "1 as class", "2 as key", "3 as a", "4 as b")
    got = {tuple(x) for x in N.similar_pairs(df).select("id_a", "id_b").collect()}
    want = brute(rows)
    assert got <= want and len(got) >= 0.99 * len(want) and want
    assert N.similar_pairs(df.where("false")).count() == 0
    # bands over 1 or 3 texts are cut into blocks; nothing changes
    for heavy in (1, 3):
        assert {tuple(x) for x in N.similar_pairs(df, heavy=heavy).select("id_a", "id_b").collect()} == got
    each = {r["id"]: (r["class_id"], r["links"]) for r in N.membership(df).collect()}
    assert set(each) == {i for i, t in rows if t is not None and len(words(t)) >= N.MIN_WORDS}
    assert each["copy1"] == each["copy2"] == each[rows[5][0]] and len({c for c, _ in each.values()}) == len({("".join(words(t)), *sorted(words(t))) for i, t in rows if i in each})
    linked = {(min(each[a][0], each[b][0]), max(each[a][0], each[b][0])) for a, b in got}
    assert sum(dict(each.values()).values()) == 2 * len(linked)


def test_folding_is_one_everywhere(spark):
    base = "die straße am fluss hat im winter oft viel schnee und eis auf dem ganzen weg"
    df = spark.createDataFrame([("a", base), ("b", base.upper()), ("c", base.replace("winter", "sommer"))], "id string, content string")
    assert {tuple(x) for x in N.similar_pairs(df).collect()} == {("a", "c"), ("b", "c")}


def test_meeting_does_not_depend_on_batches():
    r = np.random.default_rng(0)
    keys = np.sort(r.integers(0, 40, 600))
    rows = N.pd.DataFrame({"key": keys, "c1": np.arange(600), "c2": np.arange(600) * 7})
    for size in (1, 7, 600):
        out = N.pd.concat(N._meet(iter([rows.iloc[k : k + size] for k in range(0, 600, size)]), 15))
        light, heavy = out[out["key"].isna()], out[out["key"].notna()]
        count = rows.groupby("key")["c1"].transform("size")
        assert sorted(heavy["a1"]) == sorted(rows["c1"][count > 15])
        want = {(a, b) for _, g in rows[count <= 15].groupby("key") for k, a in enumerate(g["c1"]) for b in g["c1"].iloc[k + 1 :]}
        assert {(min(a, b), max(a, b)) for a, b in zip(light["a1"], light["b1"])} == want
        assert (heavy.groupby(["key", "block"]).size() <= 15).all()


def test_sketch_estimates_probability_jaccard():
    a = [f"word{k}" for k in range(40)]
    b = a[:30] + [f"other{k}" for k in range(10)]
    s = N.sketch([" ".join(a), " ".join(b), "", " ".join(a)], 2000)
    assert not s[2].any() and (s[0] == s[3]).all()
    assert abs((s[0] == s[1]).mean() - 30 / 50) < 0.05


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(min_size=0, max_size=60), max_size=5))
def test_sketch_of_any_text(texts):
    s = N.sketch(texts, 12)
    assert s.shape == (len(texts), 12)
    for k, t in enumerate(texts):
        assert (N.sketch([t], 12)[0] == s[k]).all()
        assert bool(words(t)) == bool(np.any(s[k]))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80) | st.text(st.characters(max_codepoint=127), max_size=80))
def test_words_are_those_of_the_pattern(text):
    assert words(text) == WORD.findall(text.lower().replace("ß", "ss"))


def test_words_of_many_texts_are_worked_out_once(monkeypatch):
    r, mixed, mix = random.Random(4), [], N._mix
    vocab = [f"word{k}" * (1 + k % 2) for k in range(60)]
    texts = [" ".join(r.sample(vocab, 30)) for _ in range(600)]
    first = N.sketch(texts, 192)
    monkeypatch.setattr(N, "_mix", lambda x: (mixed.append(x.size), mix(x))[1])
    again = N.sketch(texts, 192)
    assert (first == again).all() and not sum(mixed)


def test_known_words_and_others_give_the_sketch_of_all_arrivals():
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdef") for _ in range(r.randint(2, 11))) for _ in range(60)]
    texts = [" ".join([*r.choices(vocab, k=r.randint(1, 40)), *["often"] * r.randint(0, 7), *(f"rare{r.random()}" for _ in range(r.randint(0, 4)))]) for _ in range(80)]
    got, m = N.sketch(texts, 24), 24
    for text, sig in zip(texts, got):
        best, want = np.full(m, np.inf), np.zeros(m, np.uint64)
        for w in set(words(text)):
            seed = N.pd.util.hash_array(np.array([w], object), categorize=False)
            weight = words(text).count(w) * min(8, max(1, len(w) - 2))
            _, t, reg = N._next(seed, np.zeros(1), m, 2000)
            for at, k in zip(t[0] / weight, reg[0]):
                if at < best[k]:
                    best[k], want[k] = at, seed[0]
        assert (sig == want).all()


def test_what_is_kept_is_bounded(monkeypatch):
    known = N.Arrivals(8)
    monkeypatch.setattr(N, "_ROW", 4)
    for start in (0, 5, 100, 110, 0):
        seed = np.arange(start, start + 12).astype(np.uint64) * N._STEP
        row = known.rows(seed, np.ones(12, np.int64), np.ones(12), np.ones(12, bool))
        assert len(known.first) == len(known.by) == len(known.row) <= 16 and (row >= 0).sum() >= 4
        assert (known.by[row[row >= 0]] == seed[row >= 0]).all() and (known.first[row[row >= 0]] & 15 == row[row >= 0, None]).all()


def test_classes_take_no_text_apart_twice(spark):
    texts = ["one two three", "Two, one three", "onetwo three", "one two", None, "", "ONE TWO three!", "a a b", "a b b"]
    df = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "id string, content string")
    members, classes = N._classes(df, "id", "content", 2)
    assert "regexp" not in classes._jdf.queryExecution().optimizedPlan().toString() + members._jdf.queryExecution().optimizedPlan().toString()
    c = {r["id"]: (r["c1"], r["c2"]) for r in members.collect()}
    assert set(c) == {"0", "1", "2", "3", "6", "7", "8"} and c["0"] == c["6"] and len(set(c.values())) == 6
    assert c["0"][1] == c["1"][1] and c["0"][0] == c["2"][0]
    assert {(r["c1"], r["c2"]): r["n"] for r in classes.collect()} == {c[k]: len(words(texts[int(k)])) for k in c}


def test_hashing_rows_without_words():
    def hashed(texts, least, whole):
        return next(N._hashed(iter([pa.RecordBatch.from_pydict({"id": list("abc")[: len(texts)], "content": pa.array(texts, pa.string())})]), least, whole))

    for whole in (True, False):
        assert hashed([], 1, whole).num_rows == hashed([None, "?", "one"], 2, whole).num_rows == 0
    assert hashed(["one", "", "two one"], 0, True)["n"].to_pylist() == [1, 0, 2]
    assert hashed(["", "one", ""], 0, True)["m1"].to_pylist()[::2] == [0, 0]
