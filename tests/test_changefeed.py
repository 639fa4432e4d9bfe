import random

from engramlake.operators import changefeed as C

RECORD = "id string, section string, project string, content string, source string, created_at bigint, updated_at bigint, last_access bigint, access_count bigint, relevance double, locked boolean, deprecated boolean, deprecated_at bigint, supersedes string, tags array<string>"
OP = f"seq bigint, kind string, at bigint, record struct<{', '.join(x.replace(' ', ':', 1) for x in RECORD.split(', '))}>, id string, content string, reason string, value boolean, ids array<string>, project string"


def record(i, content="c", off=False):
    return (i, "context", None, content, "manual", 1, 1, 1, 0, 0.5, False, off, 0, None, [])


def op(seq, kind, at, i=None, content=None, rec=None):
    return (seq, kind, at, rec, i, content, None, None, None, None)


def fold(base, ops):
    first = {}
    for o in ops:
        k = (*o[1:4], (o[4] or "").lower(), *o[5:])
        first[repr(k)] = min(first.get(repr(k), o), o, key=lambda x: x[0])
    state = {i.lower(): [off, None] for i, off in base}
    todo = [(o[2] // 1000 if o[2] > 10**11 else o[2], o[0], o) for o in first.values() if o[2] is not None]
    for _, seq, o in sorted(todo, key=lambda t: t[:2]):
        kind, rec, i, content = o[1], o[3], (o[4] or "").lower(), o[5]
        if kind == "insert" and rec is not None and rec[0] and rec[3] is not None:
            state.setdefault(rec[0].lower(), [rec[11], seq])
        elif i in state:
            if kind == "update" and content is not None and not state[i][0]:
                state[i][1] = seq
            elif kind in ("deprecate", "keep"):
                state[i][0] = kind == "deprecate"
    return {(i, s) for i, (off, s) in state.items() if not off and s is not None}


def test_random_journals(spark):
    for seed in range(3):
        r = random.Random(seed)
        ids = [f"id{k}" for k in range(6)]
        base = [(i, r.random() < 0.3) for i in ids[:3]]
        ops = []
        for seq in range(160):
            i = r.choice(ids) if r.random() < 0.6 else "id0"  # one hot id
            kind = r.choice(["insert", "update", "update", "deprecate", "keep", "access", "set_locked", None, "odd"])
            at = r.choice([None, r.randint(1, 30), r.randint(1, 30), r.randint(10, 30) * 10**10 + 500])
            i = i.upper() if r.random() < 0.3 else i
            if kind == "insert":
                ops.append(op(seq, kind, at, rec=r.choice([None, record(i), record(i, off=True), record(i, content=None)])))
            else:
                ops.append(op(seq, kind, at, i, r.choice([None, "x", "y"]) if kind == "update" else None))
        ops += [op(1000 + k, *o[1:3], (o[4] or "").upper() or None, o[5], o[3]) for k, o in enumerate(ops[::7])]
        b = spark.createDataFrame([record(i, off=off) for i, off in base], RECORD)
        o = spark.createDataFrame(ops, OP)
        got = {(x["id"], x["seq"]) for x in C.found(b, o, slices=5).collect()}
        assert got == fold(base, ops)


def test_empty_and_clashing_columns(spark):
    b, o = spark.createDataFrame([], RECORD), spark.createDataFrame([], OP)
    assert C.found(b, o).count() == 0 and C.current_state(b, o).count() == 0
    o = spark.createDataFrame([op(1, "insert", 5, rec=record("A", "hello")), op(2, "update", 5, "a", "later"), op(3, "update", 4, "a", "early")], OP).selectExpr("*", "1 as slice", "'z' as digest", "2 as started")
    b = b.selectExpr("*", "1 as at_s", "2 as slice")
    assert [tuple(r) for r in C.current_state(b, o).collect()] == [("a", "later", 5, 2)]
