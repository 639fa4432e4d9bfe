import numpy as np

from engramlake.config import Config
from engramlake.functions import vectors
from engramlake.operators import curation, retrieval
from engramlake.operators import records as R
from engramlake.plans import memory


def test_each_session_is_shown_its_own_memories(spark):
    turns = spark.createDataFrame([("a", 1, "user", "tea"), ("a", 2, "assistant", "noted"), ("b", 1, "user", "seat"), ("c", 1, "user", "hm")], "session string, seq bigint, role string, text string")
    related = spark.createDataFrame([("a", 2, "project", "thesis", "Due friday."), ("a", 1, "context", None, "Likes tea."), ("b", 1, "identity", None, "Sits left.")], "session string, handle int, section string, project string, content string")
    got = {r["session"]: r["prompt"] for r in curation.cycle_prompts(turns, related, Config()).collect()}
    assert got == {
        "a": "Existing memories:\n[M1] (context) Likes tea.\n[M2] (project:thesis) Due friday.\n\nConversation:\nUSER: tea\nASSISTANT: noted\n",
        "b": "Existing memories:\n[M1] (identity) Sits left.\n\nConversation:\nUSER: seat\n",
        "c": "Existing memories: (none)\n\nConversation:\nUSER: hm\n",
    }


def test_union_of_each_session(spark):
    hits = spark.createDataFrame([(s, f"m{k:02d}", 0.3 + 0.01 * k + (0.005 if s == "y" else 0)) for s in "xy" for k in range(15)] + [("x", "m00", 0.9), ("z", "m03", 0.5), ("z", "m01", 0.5)], "session string, id string, cos double")
    got = {}
    for r in retrieval.union_best(hits, 12, ["session"]).orderBy("session", "handle").collect():
        got.setdefault(r["session"], []).append(r["id"])
    assert got == {"x": ["m00", *(f"m{k:02d}" for k in range(14, 3, -1))], "y": [f"m{k:02d}" for k in range(14, 2, -1)], "z": ["m01", "m03"]}


def test_all_turns_of_all_sessions_are_asked(spark, small):
    known = memory.index(spark, small).where(R.matches_scan()).select("id", "vec").orderBy("id").collect()
    said = memory.turns(spark, small).select("session", "seq", vectors.bow_vector("text").alias("vec")).collect()
    ids = [r["id"] for r in known]
    cos = np.round(np.array([r["vec"] for r in said], np.float32) @ np.array([r["vec"] for r in known], np.float32).T, 6).astype(float)
    best: dict[str, dict[str, float]] = {}
    for r, row in zip(said, cos):
        mine = best.setdefault(r["session"], {})
        for k in np.lexsort((np.arange(len(ids)), -row))[:3]:
            if row[k] >= 0.25:
                mine[ids[k]] = max(row[k], mine.get(ids[k], 0))
    want = {s: [c for _, c in sorted((-c, i) for i, c in m.items())[:12]] for s, m in best.items() if m}
    got: dict[str, list[tuple[str, float]]] = {}
    for r in memory.related_by_session(spark, small).orderBy("session", "handle").collect():
        assert r["handle"] == len(got.setdefault(r["session"], [])) + 1
        got[r["session"]].append((r["id"], r["cos"]))
    assert got.keys() == want.keys()
    assert {s: [i for i, _ in v] for s, v in got.items()} == want
    prompts = {r["session"]: r["prompt"] for r in memory.cycle_prompts_related(spark, small).collect()}
    assert prompts.keys() == {r["session"] for r in said}
    assert all(f"[M{len(got[s])}] " in p and f"[M{len(got[s]) + 1}] (" not in p for s, p in prompts.items() if s in got)
