"""A store on any file system Spark can write to: snapshots, a journal, embeddings, and what is left over.

    _CURRENT                 number of the snapshot in force
    manifest.json            version, times, embedding model
    snapshots/<n>/records    parquet by section; snapshots/<n>/projects
    journal/<n>/batch=<k>    ops since snapshot n; writing a batch again replaces it
    audit/, quarantine/      all ops ever; rows that could not be read or repeat an id, whole, with the reason
    embeddings/<n>           vectors by id and content hash; the manifest says which n is in force

A compaction writes the next snapshot whole and then swaps _CURRENT by a rename; before the swap readers see
the old snapshot with its journal, afterwards the new one, so nothing has to be rolled back.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from engramlake.config import Config
from engramlake.operators import records as R
from engramlake.operators import replay as J
from engramlake.operators.running import numbered
from engramlake.runtime import cut
from engramlake.sources.notation import OP, RECORD

VERSION = 1
#: Room for this many ops in a batch (2^40, which leaves 2^23 batches to a journal).
BATCH_ROWS = 1 << 40


class StoreError(RuntimeError):
    pass


class Store:
    def __init__(self, spark: SparkSession, root: str, cfg: Config | None = None) -> None:
        self.spark, self.root, self.cfg = spark, root.rstrip("/"), cfg or Config()
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # files -------------------------------------------------------------------------------------------

    def _exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{name}"))

    def _read(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.root}/{name}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write(self, name: str, text: str) -> None:
        """Whole or not at all: a temporary file, then a rename over the old one."""
        tmp, to = self._path(f"{self.root}/.{name}.tmp"), self._path(f"{self.root}/{name}")
        stream = self._fs.create(tmp, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(self._fs.makeQualified(tmp), self._fs.makeQualified(to), options)

    # life --------------------------------------------------------------------------------------------

    @property
    def manifest(self) -> dict:
        return json.loads(self._read("manifest.json"))

    @property
    def current(self) -> int:
        return int(self._read("_CURRENT"))

    def create(self, records: DataFrame, now: int, projects: DataFrame | None = None, model: dict | None = None) -> Store:
        """Starts a store from raw records; unreadable ones go to quarantine."""
        if self._exists("_CURRENT"):
            raise StoreError(f"{self.root}: there is a store already")
        rows = cut(records.withColumn("_position", F.monotonically_increasing_id()).withColumn("reason", R.problem()))
        first = R.first_wins(rows.where("reason is null"), "_position").select("_position")
        again = rows.where("reason is null").join(first, "_position", "left_anti").withColumn("reason", F.lit("id seen before"))
        rows.where("reason is not null").unionByName(again).drop("_position").write.mode("append").parquet(f"{self.root}/quarantine")
        good = cut(R.read(rows.join(first, "_position", "left_semi"), now))
        self._snapshot(0, good, R.registry(good, self._none(OP), projects if projects is not None else self._none("slug string")))
        self._write("manifest.json", json.dumps({"store_version": VERSION, "created_at": now, "last_compaction": None, "embedding": model}))
        self._write("_CURRENT", "0")
        return self

    def open(self) -> Store:
        if not self._exists("_CURRENT"):
            raise StoreError(f"{self.root}: no store")
        version = self.manifest.get("store_version")
        if not isinstance(version, int) or not 1 <= version <= VERSION:
            raise StoreError(f"{self.root}: version {version} can't be read")
        return self

    def _none(self, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    def _snapshot(self, n: int, records: DataFrame, projects: DataFrame) -> None:
        records.select(*(f.split()[0] for f in RECORD.split(", "))).write.mode("overwrite").partitionBy("section").parquet(f"{self.root}/snapshots/{n}/records")
        projects.select("slug").write.mode("overwrite").parquet(f"{self.root}/snapshots/{n}/projects")

    # reading -----------------------------------------------------------------------------------------

    def base(self) -> DataFrame:
        return self.spark.read.schema(RECORD).parquet(f"{self.root}/snapshots/{self.current}/records")

    def ops(self) -> DataFrame:
        path = f"journal/{self.current}"
        if not self._exists(path):
            return self._none(OP)
        return self.spark.read.schema(OP).parquet(f"{self.root}/{path}").select(*self._columns())

    @staticmethod
    def _columns() -> list[str]:
        return ["seq", "kind", "at", "record", "id", "content", "reason", "value", "ids", "project"]

    def records(self, now: int) -> DataFrame:
        return J.replay(self.base(), self.ops(), now)

    def projects(self) -> DataFrame:
        created = self.ops().where("kind = 'project_create'").select(F.col("project").alias("slug"))
        return self.spark.read.parquet(f"{self.root}/snapshots/{self.current}/projects").unionByName(created).distinct()

    # writing -----------------------------------------------------------------------------------------

    def append(self, ops: DataFrame, batch: int) -> None:
        """Ops of one batch, in their order; the same batch written again replaces itself.

        seq is made of the batch and the row's place in it, so ops of a later batch come later.
        """
        types = {f.name: f.dataType for f in self._none(OP).schema}
        for name in self._columns():
            if name not in ops.columns:
                ops = ops.withColumn(name, F.lit(None).cast(types[name]))
        ops = ops.select(F.monotonically_increasing_id().alias("_n"), *self._columns()[1:])
        if ops.rdd.getNumPartitions() > 1:  # within one partition the rows are numbered without gaps already
            ops = numbered(ops, [F.col("_n")]).drop("_n").withColumnRenamed("place", "_n")
        rows = ops.select((F.lit(batch) * BATCH_ROWS + F.col("_n")).alias("seq"), *self._columns()[1:])
        rows.write.mode("overwrite").parquet(f"{self.root}/journal/{self.current}/batch={batch}")
        if self.cfg.audit_log:
            rows.write.mode("overwrite").parquet(f"{self.root}/audit/snapshot={self.current}/batch={batch}")

    def next_batch(self) -> int:
        path = f"journal/{self.current}"
        if not self._exists(path):
            return 0
        done = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/{path}"))]
        return max((int(d.split("=")[1]) + 1 for d in done if d.startswith("batch=")), default=0)

    def compaction_due(self) -> bool:
        return self.ops().count() > self.cfg.journal_max_ops

    def compact(self, now: int) -> int:
        """The next snapshot: the journal applied, what is due for purging left out. Returns its number."""
        n = self.current + 1
        self._snapshot(n, R.compacted(self.records(now), now, self.cfg), self.projects())
        self._write("manifest.json", json.dumps(self.manifest | {"last_compaction": now}))
        self._write("_CURRENT", str(n))
        return n

    def save_embeddings(self, vectors: DataFrame, model: dict) -> None:
        """Written beside those in force, which vectors may be read from, then put in force by the manifest."""
        manifest = self.manifest
        n = (manifest.get("embeddings") or 0) + 1
        vectors.write.mode("overwrite").parquet(f"{self.root}/embeddings/{n}")
        self._write("manifest.json", json.dumps(manifest | {"embedding": model, "embeddings": n}))
        if n > 2:
            self._fs.delete(self._path(f"{self.root}/embeddings/{n - 2}"), True)

    def embeddings(self, model: dict) -> DataFrame | None:
        """Kept vectors, if they are of this model (else all have to be made anew)."""
        manifest = self.manifest
        if manifest.get("embedding") != model or not manifest.get("embeddings"):
            return None
        return self.spark.read.parquet(f"{self.root}/embeddings/{manifest['embeddings']}")
