"""The store as an object: what a host calls. Every method is a few small jobs; bulk work uses the operators.

embed turns a list of texts into vectors, generate(system, user, grammar, max_tokens) into a reply; without embed
hashed bags of words are used, without generate curation waits and recall is refused.
"""

from __future__ import annotations

import time
import uuid
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, functions as F

from engramlake.config import Config
from engramlake.functions import text, vectors
from engramlake.functions.hashing import fnv1a64_many
from engramlake.operators import curation, embedding, inject, protocol, retrieval
from engramlake.operators import records as R
from engramlake.runtime import cut
from engramlake.sources.notation import OP
from engramlake.sources.store import Store


class Refused(Exception):
    """code is INVALID, NOT_FOUND, LOCKED, MODEL or CONFIG."""

    def __init__(self, code: str, why: str) -> None:
        super().__init__(why)
        self.code = code


class Memory:
    def __init__(self, store: Store, cfg: Config | None = None, embed: Callable | None = None, generate: Callable | None = None, clock: Callable[[], int] = lambda: int(time.time())) -> None:
        self.store, self.cfg, self.embed, self.generate, self.clock = store.open(), cfg or store.cfg, embed, generate, clock
        self.spark = store.spark
        self.active: str | None = None
        self.turns: list[tuple[str, str, int]] = []
        self.pending: dict[tuple[str, str, int], int] = {}
        self.notes: Counter[str] = Counter()
        self.counts = Counter(ops_applied=0, ops_rejected=0, cycles_run=0, recalls_served=0, turns_dropped=0)
        self.last_cycle: int | None = None
        self.last_review: int | None = None
        #: Says which model the kept vectors are of.
        self.model = {"name": getattr(embed, "__name__", "embed") if embed else "hashed words", "prefix": self.cfg.passage_prefix}

    # reading -----------------------------------------------------------------------------------------

    def records(self) -> DataFrame:
        return self.store.records(self.clock())

    def _one(self, record_id: str) -> Row | None:
        return self.records().where(F.col("id") == record_id.lower()).first()

    def _vectors(self, records: DataFrame) -> DataFrame:
        """id, content_hash, vec of active records: kept vectors, and new ones only for what has none of its content."""
        kept = self.store.embeddings(self.model)
        if kept is None:
            return embedding.embed(records, self.embed, self.cfg.passage_prefix)
        return embedding.refreshed(kept, records, self.embed, self.cfg.passage_prefix)

    def _index(self) -> DataFrame:
        records = cut(self.records().where("not deprecated"))
        return records.join(self._vectors(records).select("id", "vec"), "id")

    def keep_vectors(self) -> None:
        """Writes the vectors of all active records to the store, so that later searches only embed what has changed since."""
        self.store.save_embeddings(self._vectors(self.records().where("not deprecated")), self.model)

    def _vector(self, question: str) -> list[float]:
        if self.embed is None:
            return vectors.bow([self.cfg.query_prefix + question])[0].tolist()
        v = [float(x) for x in self.embed([self.cfg.query_prefix + question])[0]]
        size = sum(x * x for x in v) ** 0.5
        return [x / size for x in v] if size else v

    def search(self, question: str, section: str = "any", project: str | None = None, k: int = 0) -> DataFrame:
        """Best matches with cos, score, rank; nothing is noted as accessed."""
        if section not in (*R.SECTIONS, "any"):
            raise Refused("INVALID", f"section {section}")
        self._text(question)
        return retrieval.search(self._index(), self._vector(question), self.clock(), self.cfg, section, project or self.active, k or None)

    def list(self, section: str = "any", project: str | None = None, include_deprecated: bool = False) -> DataFrame:
        if section not in (*R.SECTIONS, "any"):
            raise Refused("INVALID", f"section {section}")
        return R.listed(self.records(), section, project, include_deprecated)

    def stats(self) -> dict:
        counts = R.stats(self.records()).first().asDict()
        return counts | dict(self.counts) | {"journal_ops": self.store.ops().count(), "last_cycle_at": self.last_cycle or 0, "last_compaction_at": self.store.manifest["last_compaction"] or 0}

    # projects ----------------------------------------------------------------------------------------

    def projects(self) -> list[str]:
        return [r["slug"] for r in self.store.projects().orderBy("slug").collect()]

    def select_project(self, slug: str | None) -> None:
        """None selects none; an unknown slug is created if the configuration says so."""
        if slug is not None:
            self._slug(slug)
            if slug not in self.projects():
                if not self.cfg.autocreate:
                    raise Refused("NOT_FOUND", slug)
                self._append(kind="project_create", project=slug)
        self.active = slug

    # changes -----------------------------------------------------------------------------------------

    def _text(self, value: str) -> None:
        if not isinstance(value, str) or not value.strip(text.SPACE) or any(0xD800 <= ord(c) <= 0xDFFF for c in value):
            raise Refused("INVALID", "a text is needed")

    def _slug(self, value: str) -> None:
        ok = isinstance(value, str) and 1 <= len(value) <= 64 and value[0] != "-" and all(c in "abcdefghijklmnopqrstuvwxyz0123456789-" for c in value)
        if not ok:
            raise Refused("INVALID", f"slug {value!r}")

    def _content(self, value: str) -> None:
        self._text(value)
        if len(value) > self.cfg.content_max_chars:
            raise Refused("INVALID", f"over {self.cfg.content_max_chars} characters")

    def _append(self, **op) -> None:
        row = {"at": self.clock(), "seq": None} | op
        names = [f.name for f in self._op_schema().fields]
        self.store.append(self.spark.createDataFrame([tuple(row.get(n) for n in names)], self._op_schema()), self.store.next_batch())
        if op["kind"] != "access" or op.get("ids"):
            self.counts["ops_applied"] += 1

    def _op_schema(self):
        return self.spark.createDataFrame([], OP).schema

    def insert(self, section: str, content: str, project: str | None = None, locked: bool = False, source: str = "manual") -> str:
        if section not in R.SECTIONS:
            raise Refused("INVALID", f"section {section}")
        self._content(content)
        if section == "project":
            project = project or self.active
            if project is None:
                raise Refused("INVALID", "no project")
            self._slug(project)
            if project not in self.projects():
                raise Refused("NOT_FOUND", project)
        elif project is not None:
            raise Refused("INVALID", "only project records have a project")
        if section == "identity" and R.stats(self.records()).first()["identity_count"] >= self.cfg.identity_max_records:
            raise Refused("INVALID", "identity is full")
        now, new = self.clock(), str(uuid.uuid4())
        self._append(kind="insert", record=(new, section, project, content, source, now, now, now, 0, R.FIRST_RELEVANCE[source], locked, False, 0, None, []))
        return new

    def _existing(self, record_id: str) -> Row:
        try:
            uuid.UUID(record_id)
        except (ValueError, AttributeError, TypeError) as e:
            raise Refused("INVALID", f"id {record_id!r}") from e
        if (r := self._one(record_id)) is None:
            raise Refused("NOT_FOUND", record_id)
        return r

    def update(self, record_id: str, content: str) -> None:
        self._content(content)
        r = self._existing(record_id)
        if r["locked"]:
            raise Refused("LOCKED", record_id)
        if r["deprecated"]:
            raise Refused("INVALID", f"{record_id} is deprecated")
        self._append(kind="update", id=r["id"], content=content)

    def deprecate(self, record_id: str, reason: str | None = None) -> None:
        r = self._existing(record_id)
        if r["locked"]:
            raise Refused("LOCKED", record_id)
        self._append(kind="deprecate", id=r["id"], reason=reason)

    def set_locked(self, record_id: str, value: bool) -> None:
        self._append(kind="set_locked", id=self._existing(record_id)["id"], value=value)

    # prompts -----------------------------------------------------------------------------------------

    def build_prompt(self, base: str, message: str) -> str:
        """The base prompt with the memories that matter for the message; those that fit are noted as accessed."""
        self._text(message)
        now, vec, cfg = self.clock(), self._vector(message), self.cfg
        identity = R.identity(self.records())
        found = [inject.budget_prefix(identity, [F.desc("locked"), F.desc("relevance"), F.col("created_at"), F.col("id")], cfg.identity_tokens)]
        for section, budget in (("context", cfg.context_tokens), ("project", cfg.project_tokens)):
            if section == "project" and self.active is None:
                continue
            hits = retrieval.search(self._index(), vec, now, cfg, section, self.active).drop("rank")
            found.append(inject.budget_prefix(hits, [F.desc("score"), F.desc("updated_at"), F.col("id")], budget))
        lines: list[list[str]] = []
        for df in found:
            rows = df.where("injected").orderBy("rank").select("id", text.data_line(F.col("content")).alias("line")).collect()
            self.notes.update(r["id"] for r in rows)
            lines.append([r["line"] for r in rows])
        template = inject.TEMPLATE
        if cfg.template_path:
            with open(cfg.template_path, encoding="utf-8") as f:
                template = f.read()
        return inject.render(base or "", lines[0], lines[1], lines[2] if len(lines) > 2 else [], self.active or "", template)

    def recall(self, question: str) -> tuple[str, list[Row]]:
        """The model's answer from the memories and the records it cites, which are boosted."""
        self._text(question)
        if self.generate is None:
            raise Refused("MODEL", "no text model")
        found = retrieval.search(self._index(), self._vector(question), self.clock(), self.cfg, "any", self.active, self.cfg.recall_k)
        numbered = found.withColumn("handle", F.col("rank"))
        rows = numbered.orderBy("handle").collect()
        if not rows:
            raise Refused("NOT_FOUND", "nothing remembered")
        user = curation.recall_prompt(question, numbered).first()["prompt"]
        reply = self.generate(protocol.RECALL, user, protocol.grammar("recall", len(rows)), self.cfg.recall_answer_tokens)
        parsed = self._parse(reply, len(rows))
        answer = next((p["text"] for p in parsed if p["kind"] == "ANSWER"), None)
        if not answer:
            raise Refused("NOT_FOUND", "no answer in memory")
        handles = dict.fromkeys(p["handle"] for p in parsed if p["kind"] == "CITE")
        cited = [rows[h - 1] for h in handles]
        self.notes.update(r["id"] for r in cited)
        self.flush_access()
        self.counts["recalls_served"] += 1
        return answer, cited

    def _parse(self, reply: str, handles: int) -> list[Row]:
        one = self.spark.createDataFrame([(0, reply)], "k int, reply string")
        return protocol.parse(one, "k", "reply", handles).orderBy("line_no").collect()

    # curation ----------------------------------------------------------------------------------------

    def observe_turn(self, role: str, said: str) -> None:
        if role not in ("user", "assistant"):
            raise Refused("INVALID", f"role {role}")
        self._text(said)
        self.turns.append((role, said, self.clock()))
        if len(self.turns) > self.cfg.event_queue_max:
            self.counts["turns_dropped"] += len(self.turns) - self.cfg.event_queue_max
            self.turns = self.turns[-self.cfg.event_queue_max :]

    def flush_access(self) -> None:
        if self.notes:
            ids = list(self.notes.elements())
            self.notes.clear()
            self._append(kind="access", ids=ids)

    def tick(self, force: bool = False, full: bool = False) -> None:
        """What is due: a cycle by count or idle time, a review by its interval, access notes, a compaction."""
        cfg, now = self.cfg, self.clock()
        idle = bool(self.turns) and now - self.turns[-1][2] >= cfg.idle_flush
        if self.generate is not None:
            while self.turns and (force or idle or len(self.turns) >= cfg.turn_batch):
                self.run_cycle(len(self.turns) if force or idle and len(self.turns) < cfg.turn_batch else cfg.turn_batch)
            if full or self.last_review is None or now - self.last_review >= cfg.maintenance_interval:
                self.run_review()
        self.flush_access()
        if full or self.store.compaction_due():
            self.store.compact(now)
            self.keep_vectors()

    def flush(self, full: bool = False) -> None:
        self.tick(force=True, full=full)

    def close(self) -> None:
        self.flush_access()
        if self.store.ops().limit(1).count():
            self.store.compact(self.clock())
            self.keep_vectors()

    def _reject(self) -> bool:
        self.counts["ops_rejected"] += 1
        return False

    def run_cycle(self, n: int) -> None:
        """One reply to the oldest n turns, its ops guarded and applied; the turns stay if the model fails."""
        cfg, now, taken = self.cfg, self.clock(), self.turns[:n]
        index = self._index()
        asked = self.spark.createDataFrame([(k, self._vector(t)) for k, (_, t, _) in enumerate(taken)], "query_id int, vec array<float>")
        hits = retrieval.nearest(index.where(R.matches_scan("any", self.active)), asked, 3, floor=cfg.min_similarity)
        related = retrieval.union_best(hits, 12).join(index.drop("vec"), "id").orderBy("handle")
        rows = related.collect()
        turns = self.spark.createDataFrame([("", k, r, t) for k, (r, t, _) in enumerate(taken)], "session string, seq int, role string, text string")
        shown = related.select("handle", "section", "project", "content")
        user = curation.cycle_prompts(turns, shown, cfg).first()["prompt"]
        instruction = protocol.CURATION
        if cfg.instruction_path:
            try:
                with open(cfg.instruction_path, encoding="utf-8") as f:
                    instruction = f.read()
            except OSError:
                pass
        reply = self.generate(instruction, user, protocol.grammar("curation", len(rows)), 1024)
        self.turns = self.turns[n:]
        slot, seen = 0, set()
        for p in self._parse(reply, len(rows)):
            if p["bad"] or p["kind"] == "NOOP":
                continue
            slot += 1
            if slot > cfg.max_ops_per_cycle or p["kind"] not in ("INSERT", "UPDATE", "DEPRECATE"):
                self._reject()
                continue
            self._curate(p, rows, now, seen)
        self.counts["cycles_run"] += 1
        self.last_cycle = now
        self.flush_access()

    def _curate(self, p: Row, rows: list[Row], now: int, seen: set) -> bool:
        cfg = self.cfg
        try:
            if p["kind"] == "INSERT":
                self._content(p["text"])
                project = self.active if p["section"] == "project" else None
                if p["section"] == "project" and project is None:
                    return self._reject()
                same = self._index().where(F.col("section") == p["section"]).where(F.col("project").eqNullSafe(F.lit(project)))
                best = retrieval.by_cosine(same, self._vector(p["text"]), 1, "any", project, cfg.dup_threshold).first()
                if best is not None:
                    self._append(kind="access", ids=[best["id"]])
                else:
                    self.insert(p["section"], p["text"], project, source="curator")
                return True
            row = rows[p["handle"] - 1]
            if row["locked"]:
                return self._reject()
            if p["kind"] == "UPDATE":
                self._content(p["text"])
            if row["section"] == "identity" and not self._confirmed((row["id"], p["kind"], int(fnv1a64_many([(p["text"] or "").encode()])[0])), now, seen):
                return self._reject()
            if p["kind"] == "UPDATE":
                self.update(row["id"], p["text"])
            else:
                self.deprecate(row["id"], p["text"])
            return True
        except Refused:
            return self._reject()

    def _confirmed(self, key: tuple[str, str, int], now: int, seen: set) -> bool:
        """Whether an equal proposal of an earlier cycle waits; if not, this one starts to wait."""
        if key in seen:
            return False
        seen.add(key)
        window = self.cfg.identity_confirm_window
        self.pending = {k: t for k, t in self.pending.items() if now - t <= window}
        if key in self.pending:
            del self.pending[key]
            return True
        self.pending[key] = now
        return False

    def run_review(self) -> None:
        """Verdicts on decayed records: KEEP boosts and restores, DEPRECATE retires."""
        now, cfg = self.clock(), self.cfg
        self.last_review = now
        found = R.review_candidates(self.records(), now, cfg, cfg.review_batch)
        lines = R.review_lines(found, now)
        rows = lines.orderBy("handle").collect()
        if not rows:
            return
        reply = self.generate(protocol.REVIEW, curation.review_prompt(lines).first()["prompt"], protocol.grammar("review", len(rows)), 512)
        for p in self._parse(reply, len(rows)):
            if p["kind"] == "KEEP":
                self._append(kind="keep", id=rows[p["handle"] - 1]["id"])
            elif p["kind"] == "DEPRECATE":
                self._append(kind="deprecate", id=rows[p["handle"] - 1]["id"], reason=p["text"])
        self.flush_access()
