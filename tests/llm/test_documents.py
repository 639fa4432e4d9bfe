import random

import pytest

from engramlake.llm import leakage, packing, subjects


def test_packing(spark):
    r = random.Random(2)
    vocab = ["tea", "coffee", "window", "seat", "ruling", "garden"]
    rows = [(k, " ".join(r.choice(vocab) for _ in range(r.choice([0, 5, 40, 90, 250])))) for k in range(300)] + [(900, None), (901, ""), (1, "tea"), (902, "tea " * 1000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "7 as tokens", "8 as part", "'x' as container")
    got = packing.packed(df, capacity=100, texts_per_task=100).collect()
    size = {}
    for x in got:
        assert (x["container"] is None) == (x["tokens"] == 0)
        if x["container"]:
            size[x["container"]] = size.get(x["container"], 0) + x["tokens"]
    want = {}
    for k, t in rows:
        want[k] = want.get(k, 0) + (len(packing.encoder(packing.content(packing.TOKENIZER)).encode_ordinary(t)) if t else 0)
    have = {}
    for x in got:
        have[x["doc_id"]] = have.get(x["doc_id"], 0) + x["tokens"]
    assert have == want and max(size.values()) <= 100 and len(size) <= 1.1 * sum(want.values()) / 100 + 1
    assert all(x["tokens"] == 100 or x["piece"] == max(y["piece"] for y in got if y["doc_id"] == x["doc_id"]) for x in got if x["doc_id"] == 902)
    assert packing.packed(df.where("false")).count() == 0


def test_packing_rule_is_the_least_sum_of_squares():
    r = random.Random(4)
    bins, gaps = packing.Bins(20), {}
    for _ in range(300):
        s = r.randint(1, 20)
        squares = lambda g: sum(n * n for n in (list(g.values()).count(x) for x in range(1, 20)))
        options = [squares(gaps | {b: g - s}) for b, g in gaps.items() if g >= s] + [squares(gaps | {-1: 20 - s})]
        at = bins.place(s)
        gaps[at] = gaps.get(at, 20) - s
        assert gaps[at] >= 0 and squares(gaps) == min(options)


def brute(doc, item):
    runs = {tuple(item[k : k + 12]) for k in range(len(item) - 11)}
    return any(tuple(doc[k : k + 12]) in runs for k in range(len(doc) - 11))


def test_leaks(spark):
    r = random.Random(6)
    word = lambda: r.choice("abcdefghij") + r.choice("xyz")
    items = [(k, " ".join(word() for _ in range(r.randint(5, 40)))) for k in range(20)] + [(50, None), (51, "")]
    docs = []
    for d in range(120):
        ws = [word() for _ in range(r.randint(0, 60))]
        src = items[r.randrange(20)][1].split()
        n, a = r.randint(8, 16), r.randint(0, 20)
        at = r.randint(0, len(ws))
        docs.append((d, " ".join(ws[:at] + [w.upper() for w in src[a : a + n]] + ws[at:])))
    docs += [(500, None), (501, ""), (502, items[3][1] + "! " + items[3][1])]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as item_id", "2 as tiles")
    i = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 as doc_id")
    want = {(x, y) for x, t in docs if t for y, s in items if s and brute(t.lower().split(), s.split()) or t and s and leakage.tiles(leakage.words(s), leakage.words(t))}
    for size in (1 << 20, 1):  # with a filter of 64 bits nearly every window passes, and the join decides
        assert {(x["doc_id"], x["item_id"]) for x in leakage.leaks(d, i, filter_words=size).collect()} == want
    long = spark.createDataFrame([(7, " ".join(f"w{k}" for k in range(40)))], "item_id bigint, text string")
    swapped = spark.createDataFrame([(1, " ".join([f"w{k}" for k in range(20, 40)] + ["x"] + [f"w{k}" for k in range(18)])), (2, " ".join(f"w{k}" for k in range(14)))], "doc_id bigint, text string")
    found = leakage.leaks(swapped, long, min_coverage=0.5).collect()
    assert [(x["doc_id"], x["tiles"], x["reordered"], x["coverage"]) for x in found] == [(1, 2, True, 0.95)]
    assert leakage.leaks(d.where("false"), i).count() == 0 and leakage.leaks(d, i.where("false")).count() == 0


def test_tiles_catch_other_order():
    item = [f"w{k}" for k in range(40)]
    doc = item[20:40] + ["x"] + item[0:18]
    assert [(p, n) for p, _, n in leakage.tiles(item, doc)] == [(20, 20), (0, 18)]
    assert leakage.tiles(item, item[:11]) == [] and leakage.tiles([], doc) == []


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(8)
    nouns = {"law": ["court", "clause", "witness", "statute"], "music": ["chord", "concert", "album", "tempo"], "cooking": ["recipe", "oven", "sauce", "dough"]}
    meta = "the user asked the assistant to remember that the reminder goes out."
    docs, labels, truth = [], [], set()
    for d in range(300):
        chosen = r.sample(list(nouns), r.randint(0, 2))
        lines = [meta] * r.randint(0, 3) + [f"they said the {r.choice(nouns[s])} and the {r.choice(nouns[s])} from name{r.randint(0, 999)} were good." for s in chosen for _ in range(4)]
        r.shuffle(lines)
        docs.append((d, " ".join(lines)))
        truth |= {(d, s) for s in chosen}
        labels += [(d, s) for s in chosen[:1] if d < 60]
    docs += [(900, None), (901, " "), (902, "short one")]
    labels += [(7777, "law"), (1, "unheard-of"), (None, "law")]
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, subject string"), spark.createDataFrame([(s, f"about {s}") for s in nouns], "subject string, description string"), truth


def test_subjects(corpus):
    docs, labels, areas, truth = corpus
    got = {tuple(r) for r in subjects.found(docs.selectExpr("*", "1 as words", "2 as labels"), labels, areas).collect()}
    hit = len(got & truth)
    assert hit / len(got) > 0.95 and hit / len(truth) > 0.95


def test_subjects_of_nothing(corpus):
    docs, labels, areas, _ = corpus
    assert subjects.found(docs.where("false"), labels, areas).count() == 0
    assert subjects.found(docs, labels.where("false"), areas).count() >= 0


def test_sentences():
    text = "## MEMORY\r\n- The user likes tea a lot. It rained all day long!\nINSERT context | They moved to the coast.\n[M1] (context, idle 5d) The court ruled on it today.\nCITE M2\nNOOP"
    assert [" ".join(s) for s in subjects.sentences(text)] == ["the user likes tea a lot", "it rained all day long", "they moved to the coast", "the court ruled on it today"]
