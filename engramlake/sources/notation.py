"""The text notation of stores: tagged objects with typed literals, read and written as rows.

    #memory { id: u"...", section: "context", created_at: t"2026-07-29T10:12:00Z", tags: ["a"], }

Section files are split at lines that start with a tag, journals at every line, so both are read in
parallel; a text that can't be parsed becomes a row with a reason instead of a record.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from engramlake.operators.running import numbered
from engramlake.runtime import cut

from engramlake.config import duration_seconds
from engramlake.functions.text import decode_escapes

RECORD = "id string, section string, project string, content string, source string, created_at bigint, updated_at bigint, last_access bigint, access_count bigint, relevance double, locked boolean, deprecated boolean, deprecated_at bigint, supersedes string, tags array<string>"
OP = f"seq bigint, kind string, at bigint, record struct<{', '.join(f.replace(' ', ': ', 1) for f in RECORD.split(', '))}>, id string, content string, reason string, value boolean, ids array<string>, project string"

_TOKEN = re.compile(
    r'(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<long>"""(?P<body>.*?)""")|(?P<typed>[utrb]"(?:[^"\\]|\\.)*")|(?P<str>"(?:[^"\\]|\\.)*")'
    r"|(?P<num>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<tag>#\w+)|(?P<word>[A-Za-z_]\w*)|(?P<punct>[{}\[\]:,])",
    re.S,
)
_TIME = re.compile(r"(\d{4})-(\d\d)-(\d\d)[Tt](\d\d):(\d\d):(\d\d)(?:\.\d+)?(?:[Zz]|([+-])(\d\d):(\d\d))")
_UUID = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}")


class NotationError(ValueError):
    pass


def time_seconds(text: str) -> int:
    m = _TIME.fullmatch(text)
    if not m or int(m[6]) > 60 or int(m[4]) > 23 or int(m[5]) > 59 or int(m[8] or 0) > 23 or int(m[9] or 0) > 59:
        raise NotationError(f"no time: {text}")
    try:
        day = datetime(int(m[1]), int(m[2]), int(m[3]), tzinfo=timezone.utc)
    except ValueError as e:
        raise NotationError(str(e)) from e
    shift = timedelta(hours=int(m[8] or 0), minutes=int(m[9] or 0)) * (-1 if m[7] == "-" else 1)
    return int((day + timedelta(hours=int(m[4]), minutes=int(m[5]), seconds=int(m[6])) - shift - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds())


class Typed(str):
    """A literal with a type letter: u (id), t (seconds as text), r (duration), b (bytes)."""

    letter = ""


def _typed(token: str) -> Typed:
    letter, body = token[0], token[2:-1]
    if letter == "u":
        body = body.lower()
        if not _UUID.fullmatch(body):
            raise NotationError(f"no id: {body}")
    elif letter == "t":
        body = str(time_seconds(body))
    elif letter == "r":
        seconds = duration_seconds(body)
        if seconds is None:
            raise NotationError(f"no duration: {body}")
        body = str(seconds)
    out = Typed(body)
    out.letter = letter
    return out


def values(text: str) -> Iterator[tuple[str | None, object]]:
    """(tag, value) of each value in the text; raises NotationError where it can't go on."""
    tokens, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise NotationError(f"at {at}")
        at = m.end()
        if m.lastgroup != "skip" and not m["skip"]:
            tokens.append(m)
    place = 0

    def peek() -> str:
        return tokens[place].group() if place < len(tokens) else ""

    def take() -> re.Match:
        nonlocal place
        if place >= len(tokens):
            raise NotationError("text ends early")
        place += 1
        return tokens[place - 1]

    def value() -> object:
        m = take()
        if m["long"]:
            return m["body"]
        if m["typed"]:
            return _typed(m["typed"])
        if m["str"]:
            raw = m["str"][1:-1]
            return raw if any(ord(c) < 32 for c in raw) else decode_escapes(raw)
        if m["num"]:
            return float(m["num"]) if re.search(r"[.eE]", m["num"]) else int(m["num"])
        if m["word"] in ("true", "false", "null"):
            return {"true": True, "false": False, "null": None}[m["word"]]
        if m["tag"]:  # a tag inside a value adds nothing to it
            return value()
        if m["punct"] == "[":
            out = []
            while peek() != "]":
                out.append(value())
                if peek() == ",":
                    take()
            take()
            return out
        if m["punct"] == "{":
            fields: dict = {}
            while peek() != "}":
                k = take()
                name = k["word"] or (k["str"] or "")[1:-1]
                if not name or take().group() != ":":
                    raise NotationError("a field needs a name and a colon")
                fields[name] = value()
                if peek() == ",":
                    take()
            take()
            return fields
        raise NotationError(f"unexpected {m.group()}")

    while place < len(tokens):
        tag = take().group()[1:] if peek().startswith("#") else None
        yield tag, value()


def _is(v: object, letter: str) -> bool:
    return isinstance(v, Typed) and v.letter == letter


def _record(o: object) -> dict:
    """A record's fields as the table has them; a field of the wrong type makes the whole record unreadable."""
    if not isinstance(o, dict):
        raise NotationError("a record is an object")
    out: dict = {}
    for name, ok, turn in (
        ("id", lambda v: _is(v, "u"), str), ("section", lambda v: type(v) is str, str), ("project", lambda v: type(v) is str, str), ("content", lambda v: type(v) is str, str), ("source", lambda v: type(v) is str, str),
        *((t, lambda v: _is(v, "t"), int) for t in ("created_at", "updated_at", "last_access", "deprecated_at")),
        ("access_count", lambda v: type(v) is int, int), ("relevance", lambda v: type(v) in (int, float), float), ("locked", lambda v: type(v) is bool, bool), ("supersedes", lambda v: _is(v, "u"), str),
        ("tags", lambda v: isinstance(v, list) and all(type(x) is str for x in v), list),
    ):
        if (v := o.get(name)) is not None:
            if not ok(v):
                raise NotationError(f"wrong {name}")
            out[name] = turn(v)
    status = o.get("status")
    if status not in (None, "active", "deprecated"):
        raise NotationError("wrong status")
    return out | {"deprecated": status == "deprecated"}


def _op(o: object) -> dict:
    if not isinstance(o, dict) or type(o.get("kind")) is not str or not _is(o.get("at"), "t"):
        raise NotationError("an op needs kind and at")
    out: dict = {"kind": o["kind"], "at": int(o["at"])}
    if o.get("record") is not None:
        out["record"] = _record(o["record"])
    for name in ("content", "reason", "project"):
        if type(o.get(name)) is str:
            out[name] = o[name]
    if _is(o.get("id"), "u"):
        out["id"] = str(o["id"])
    if type(o.get("value")) is bool:
        out["value"] = o["value"]
    if isinstance(o.get("ids"), list):
        out["ids"] = [str(i) for i in o["ids"] if _is(i, "u")]
    return out


def _parsed(tag: str, build):
    """A column function: text -> JSON of the one tagged value in it, or of {"_bad": reason}, with _torn if it can't even be parsed."""

    @F.pandas_udf(T.StringType())
    def parse(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            try:
                found = list(values(t or ""))
            except NotationError as e:
                out.append(json.dumps({"_bad": str(e) or "unreadable", "_torn": True}))
                continue
            try:
                if not found:
                    out.append(None)
                elif len(found) > 1 or found[0][0] != tag:
                    raise NotationError(f"one #{tag} is expected")
                else:
                    out.append(json.dumps(build(found[0][1])))
            except NotationError as e:
                out.append(json.dumps({"_bad": str(e) or "unreadable"}))
        return pd.Series(out, dtype=object)

    return parse


def read_section(spark: SparkSession, path: str) -> DataFrame:
    """Rows of RECORD with position, raw and bad (a reason, or null) of section files or folders of them."""
    raw = F.when(F.col("value").rlike(r"\A\s*(?:#|//)"), F.col("value")).otherwise(F.concat(F.lit("#memory"), F.col("value")))
    rows = spark.read.option("lineSep", "\n#memory").option("recursiveFileLookup", "true").text(path).select(F.monotonically_increasing_id().alias("position"), raw.alias("raw"))
    parsed = rows.withColumn("j", _parsed("memory", _record)("raw")).where("j is not null")
    return parsed.select("position", "raw", F.from_json("j", RECORD + ", _bad string").alias("r")).select("position", "raw", "r.*").withColumnRenamed("_bad", "bad")


def journal_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows of OP with bad (a reason, or null) and torn: every line of a journal in its order, numbered by seq from 0.

    A folder's files follow each other by path, which is the order of write_journal's appends; within a file the place counts.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.col("value").alias("raw")
    )
    placed = numbered(lines.where("trim(raw) <> ''"), [F.col("file"), F.col("block"), F.col("row")])
    parsed = placed.withColumn("j", _parsed("op", _op)("raw")).where("j is not null")
    rows = parsed.select((F.col("place") - 1).alias("seq"), F.from_json("j", OP.replace("seq bigint, ", "") + ", _bad string, _torn boolean").alias("r")).select("seq", "r.*")
    return rows.withColumnRenamed("_bad", "bad").withColumn("torn", F.coalesce("_torn", F.lit(False))).drop("_torn")


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """Rows of OP of a journal, in the order of seq.

    A value that is no op, or an op that lacks something, is left out (journal_lines shows it). A last line that can't be
    parsed is a torn tail and is left out; one that can't be parsed before a later line raises.
    """
    lines = cut(journal_lines(spark, path))
    ends = lines.agg(F.max("seq").alias("last"), F.min(F.when(F.col("torn"), F.col("seq"))).alias("torn")).first()
    if ends["torn"] is not None and ends["torn"] < ends["last"]:
        raise NotationError(f"{path}: damaged before its end")
    return lines.where("bad is null").drop("bad", "torn")


def _quoted(c: Column) -> Column:
    escaped = c
    for raw, out in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(out))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def _when(c: Column) -> Column:
    return F.concat(F.lit('t"'), F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"'))


def record_text(prefix: str = "") -> Column:
    """One record in the notation, on one line, with the fields in their fixed order."""
    c = lambda n: F.col(prefix + n)
    null = F.lit("null")
    field = lambda n, v: F.concat(F.lit(f"{n}: "), F.coalesce(v, null))
    uid = lambda n: F.concat(F.lit('u"'), F.lower(c(n)), F.lit('"'))
    parts = [
        field("id", uid("id")), field("section", _quoted(c("section"))), field("project", _quoted(c("project"))), field("content", _quoted(c("content"))), field("source", _quoted(c("source"))),
        *(field(n, _when(c(n))) for n in ("created_at", "updated_at", "last_access")), field("access_count", c("access_count").cast("string")), field("relevance", c("relevance").cast("string")),
        field("locked", c("locked").cast("string")), field("status", F.when(c("deprecated"), F.lit('"deprecated"')).otherwise(F.lit('"active"'))),
        F.when(c("deprecated"), field("deprecated_at", _when(c("deprecated_at")))), field("supersedes", uid("supersedes")),
        F.concat(F.lit("tags: ["), F.array_join(F.transform(c("tags"), _quoted), ", "), F.lit("]")),
    ]
    return F.concat(F.lit("#memory { "), F.concat_ws(", ", *parts), F.lit(" }"))


def op_text() -> Column:
    """One op in the notation, on one line."""
    kind = F.col("kind")
    some = lambda kinds, name, v: F.when(kind.isin(*kinds) & v.isNotNull(), F.concat(F.lit(f"{name}: "), v))
    uid = lambda c: F.concat(F.lit('u"'), F.lower(c), F.lit('"'))
    parts = [
        F.concat(F.lit("kind: "), _quoted(kind)), F.concat(F.lit("at: "), _when(F.col("at"))), some(["insert"], "record", record_text("record.")),
        some(["update", "deprecate", "keep", "set_locked"], "id", uid(F.col("id"))), some(["update"], "content", _quoted(F.col("content"))), some(["deprecate"], "reason", _quoted(F.col("reason"))),
        some(["set_locked"], "value", F.col("value").cast("string")), some(["access"], "ids", F.concat(F.lit("["), F.array_join(F.transform("ids", uid), ", "), F.lit("]"))),
        some(["project_create"], "project", _quoted(F.col("project"))),
    ]
    return F.concat(F.lit("#op { "), F.concat_ws(", ", *parts), F.lit(" }"))


def write_section(records: DataFrame, path: str) -> None:
    records.select(record_text().alias("value")).write.mode("overwrite").text(path)


def write_journal(ops: DataFrame, path: str) -> None:
    """Appends one op a line, in order of seq within this call; every call adds a folder after those there are."""
    spark = ops.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    n = max((int(d.split("-")[1]) + 1 for d in done if d.startswith("append-")), default=0)
    ops.orderBy("seq").select(op_text().alias("value")).write.mode("errorifexists").text(f"{path}/append-{n:012d}")
