"""Records: reading with defaults, listing, statistics, review and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from engramlake.config import Config
from engramlake.functions import scoring
from engramlake.functions.text import label, slug_valid, str_blank, uuid_valid

SECTIONS = ("identity", "context", "project")
SOURCES = ("seed", "manual", "curator")
#: Relevance of a record that comes without one.
FIRST_RELEVANCE = {"seed": 1.0, "manual": 0.8, "curator": 0.6}


def problem(r: str = "") -> Column:
    """Why a record can't be read, null if it can; the first reason counts."""
    c = lambda n: F.col(r + n)
    in_project = c("section") == "project"
    return (
        F.when(~uuid_valid(c("id")), "id")
        .when(~F.coalesce(c("section").isin(*SECTIONS), F.lit(False)), "section")
        .when(str_blank(c("content")), "content")
        .when(in_project & ~slug_valid(c("project")), "project")
        .when(~in_project & c("project").isNotNull(), "project")
        .when(c("source").isNotNull() & ~c("source").isin(*SOURCES), "source")
    )


def read(rows: DataFrame, now: int) -> DataFrame:
    """Readable rows with every default filled in; see quarantine for the others."""
    first = F.when(F.col("source") == "seed", FIRST_RELEVANCE["seed"]).when(F.col("source") == "curator", FIRST_RELEVANCE["curator"]).otherwise(FIRST_RELEVANCE["manual"])
    created = F.coalesce("created_at", F.lit(now))
    updated = F.coalesce("updated_at", created)
    off = F.coalesce("deprecated", F.lit(False))
    # the first condition follows from the second; it is one that a scan can use
    whole = F.col("id").isNotNull() & F.col("content").isNotNull() & F.col("section").isin(*SECTIONS)
    return rows.where(whole).where(problem().isNull()).select(
        F.lower("id").alias("id"), "section", "project", "content", F.coalesce("source", F.lit("manual")).alias("source"),
        created.alias("created_at"), updated.alias("updated_at"), F.coalesce("last_access", created).alias("last_access"),
        scoring.clamp_count(F.coalesce("access_count", F.lit(0))).alias("access_count"),
        scoring.clamp_relevance(F.coalesce("relevance", first)).alias("relevance"),
        F.coalesce("locked", F.lit(False)).alias("locked"), off.alias("deprecated"),
        F.when(~off, F.lit(0)).otherwise(F.coalesce("deprecated_at", updated)).cast("bigint").alias("deprecated_at"),
        F.nullif(F.lower("supersedes"), F.lit("")).alias("supersedes"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
    )


def quarantine(rows: DataFrame) -> DataFrame:
    """id and reason of the rows that read leaves out."""
    return rows.select("id", problem().alias("reason")).where("reason is not null")


def first_wins(rows: DataFrame, position: str) -> DataFrame:
    """Of rows with one id the first by position; partial aggregation keeps hot ids cheap."""
    return rows.groupBy(F.lower("id").alias("key")).agg(F.min_by(F.struct("*"), position).alias("row")).select("row.*")


def matches_scan(section: str = "any", project: str | None = None) -> Column:
    """Active rows of a section; project rows only of the given project, none without one."""
    in_section = F.lit(True) if section == "any" else F.col("section") == section
    in_project = (F.col("project") == project) if project is not None else F.lit(False)
    return ~F.col("deprecated") & in_section & ((F.col("section") != "project") | F.coalesce(in_project, F.lit(False)))


def matches_list(section: str = "any", project: str | None = None, include_deprecated: bool = False) -> Column:
    """As for a list: without a project the rows of all projects."""
    in_section = F.lit(True) if section == "any" else F.col("section") == section
    in_project = F.lit(True) if project is None else (F.col("section") != "project") | (F.col("project") == project)
    return (F.lit(include_deprecated) | ~F.col("deprecated")) & in_section & in_project


def listed(records: DataFrame, section: str = "any", project: str | None = None, include_deprecated: bool = False) -> DataFrame:
    return records.where(matches_list(section, project, include_deprecated)).orderBy("created_at", "id")


def identity(records: DataFrame) -> DataFrame:
    """Active identity rows: locked first, then by relevance, age and id."""
    return records.where("section = 'identity' and not deprecated").orderBy(F.desc("locked"), F.desc("relevance"), "created_at", "id")


def stats(records: DataFrame) -> DataFrame:
    """One row: active records by section, and deprecated ones."""
    active = lambda s: F.count_if((F.col("section") == s) & ~F.col("deprecated")).alias(f"{s}_count")
    return records.agg(*(active(s) for s in SECTIONS), F.count_if("deprecated").alias("deprecated_count"))


def registry(records: DataFrame, ops: DataFrame, projects: DataFrame) -> DataFrame:
    """Known slugs: registered, created by an op, or used by a record."""
    return (
        projects.select("slug")
        .unionByName(ops.where("kind = 'project_create'").select(F.col("project").alias("slug")))
        .unionByName(records.where("section = 'project'").select(F.col("project").alias("slug")))
        .where(slug_valid(F.col("slug")))
        .distinct()
    )


def with_label(records: DataFrame) -> DataFrame:
    return records.withColumn("label", label(F.col("section"), F.col("project")))


def as_json(records: DataFrame) -> DataFrame:
    """id and the record as a JSON object; times as integers, absent values as null."""
    fields = [
        "id", "section", "project", "content", "source", *(F.col(c).alias(f"{c}_unix") for c in ("created_at", "updated_at", "last_access")),
        "access_count", "relevance", "locked", "deprecated", F.col("deprecated_at").alias("deprecated_at_unix"), "supersedes", "tags",
    ]
    return records.select("id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def effective(records: DataFrame, now: int, cfg: Config) -> DataFrame:
    return records.withColumn("effective", scoring.effective_relevance(now, cfg))


def review_candidates(records: DataFrame, now: int, cfg: Config, batch: int | None = None) -> DataFrame:
    """Decayed rows that nothing protects, least relevant first, numbered; batch None takes all."""
    rows = effective(records, now, cfg).where(~F.col("deprecated") & ~F.col("locked") & (F.col("section") != "identity") & (F.col("effective") < cfg.prune_threshold))
    return rows.orderBy("effective", "id").limit(batch) if batch else rows


def review_lines(candidates: DataFrame, now: int) -> DataFrame:
    """handle, id, line of each candidate (as many as one review takes)."""
    idle = F.floor(F.greatest(F.lit(0), F.lit(now) - F.col("last_access")) / 86400).cast("bigint")
    numbered = candidates.withColumn("handle", F.row_number().over(W.orderBy("effective", "id")))
    text = F.concat(F.lit("[M"), F.col("handle").cast("string"), F.lit("] "), F.expr("left(lbl, length(lbl) - 1)"), F.lit(", idle "), idle.cast("string"), F.lit("d) "), F.col("content"))
    return numbered.withColumn("lbl", label(F.col("section"), F.col("project"))).select("handle", "id", text.alias("line"))


def purge_due(now: int, cfg: Config) -> Column:
    return F.col("deprecated") & (F.lit(now) - F.col("deprecated_at") >= cfg.purge_after)


def compacted(records: DataFrame, now: int, cfg: Config) -> DataFrame:
    """The rows a compaction keeps."""
    return records.where(~purge_due(now, cfg))
