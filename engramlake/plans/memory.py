"""Queries over the memory store and their SQL.

Times are measured from the export. Vector queries use hashed bags of words over contents, and the table
embeddings as an index of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from engramlake.config import Config
from engramlake.functions import hashing, scoring, text, time, vectors
from engramlake.operators import curation, embedding, inject, protocol, replay as J, retrieval
from engramlake.operators import records as R
from engramlake.operators.running import numbered
from engramlake.runtime import cut, tasks_for

NOW = 1_785_319_920
CFG = Config()
QUERY = "the user keeps notes about the sourdough starter and the key change"
PROJECT = "lab-arnillo"
HANDLES = 12

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def memory(s: SparkSession, d: str) -> DataFrame:
    return R.read(table(s, d, "asper_record"), NOW)


def turns(s: SparkSession, d: str) -> DataFrame:
    return curation.turns_accepted(table(s, d, "asper_turn"))


def index(s: SparkSession, d: str) -> DataFrame:
    return memory(s, d).withColumn("vec", vectors.bow_vector("content"))


# SQL of the same views. ---------------------------------------------------------------------------------

_BLANK = r"regexp_full_match({0}, '[ \t\n\r\x0B\f]*')"
_UUID = "regexp_full_match({0}, '[0-9A-Fa-f]{{8}}-[0-9A-Fa-f]{{4}}-[0-9A-Fa-f]{{4}}-[0-9A-Fa-f]{{4}}-[0-9A-Fa-f]{{12}}')"
_SLUG = "regexp_full_match({0}, '[a-z0-9][a-z0-9-]{{0,63}}')"


def _problem(p: str) -> str:
    return f"""CASE WHEN NOT coalesce({_UUID.format(p + 'id')}, false) THEN 'id' WHEN NOT coalesce({p}section IN ('identity', 'context', 'project'), false) THEN 'section'
  WHEN coalesce({_BLANK.format(p + 'content')}, true) THEN 'content'
  WHEN {p}section = 'project' AND NOT coalesce({_SLUG.format(p + 'project')}, false) THEN 'project' WHEN {p}section <> 'project' AND {p}project IS NOT NULL THEN 'project'
  WHEN {p}source IS NOT NULL AND {p}source NOT IN ('seed', 'manual', 'curator') THEN 'source' END"""


def _read(source: str, extra: str = "") -> str:
    return f"""SELECT lower(id) AS id, section, project, content, coalesce(source, 'manual') AS source, coalesce(created_at, {NOW}) AS created_at,
  coalesce(updated_at, created_at, {NOW}) AS updated_at, coalesce(last_access, created_at, {NOW}) AS last_access,
  greatest(0, least(4294967295, coalesce(access_count, 0)))::BIGINT AS access_count,
  greatest(0.0, least(1.0, coalesce(relevance, CASE source WHEN 'seed' THEN 1.0 WHEN 'curator' THEN 0.6 ELSE 0.8 END)))::DOUBLE AS relevance,
  coalesce(locked, false) AS locked, coalesce(deprecated, false) AS deprecated,
  (CASE WHEN NOT coalesce(deprecated, false) THEN 0 ELSE coalesce(deprecated_at, updated_at, created_at, {NOW}) END)::BIGINT AS deprecated_at,
  nullif(lower(supersedes), '') AS supersedes, coalesce(tags, []) AS tags{extra} FROM {source} WHERE ({_problem('')}) IS NULL"""


MEM = f"WITH mem AS ({_read('asper_record')})\n"
TURNS = rf"""WITH turn AS (SELECT session, seq, any_value(role) AS role, any_value(text) AS text, any_value("at") AS "at" FROM asper_turn
  WHERE role IN ('user', 'assistant') AND NOT coalesce({_BLANK.format('text')}, true) GROUP BY session, seq)
"""
_LIFE = "CASE section WHEN 'context' THEN 2592000 WHEN 'project' THEN 7776000 ELSE 0 END"
_FACTOR = f"CASE WHEN ({_LIFE}) <= 0 OR {NOW} - {{0}} <= 0 THEN 1.0 ELSE pow(0.5::DOUBLE, ({NOW} - {{0}})::DOUBLE / ({_LIFE})) END"
_EFF = f"relevance * ({_FACTOR.format('last_access')})"
_FNV_BUCKET = "list_reduce(list_concat([5], list_transform(range(1, least(127, octet_length(encode(w))) + 1), lambda i: (ascii_at(w, i) & 15)::BIGINT)), lambda h, b: (xor(h, b) * 3) & 15)"
_LABEL = "'(' || CASE WHEN section = 'project' THEN 'project:' || project ELSE section END || ')'"


@query("WITH x AS (SELECT 1) " + _read("asper_record").replace("coalesce(tags, []) AS tags", "array_to_string(coalesce(tags, []), '|') AS tags"))
def record_read(s, d):
    """Every readable record with its defaults and clamps."""
    return memory(s, d).withColumn("tags", F.array_join("tags", "|"))


@query(f"SELECT id, {_problem('')} AS reason FROM asper_record WHERE ({_problem('')}) IS NOT NULL")
def record_quarantine(s, d):
    return R.quarantine(table(s, d, "asper_record"))


@query(MEM + "SELECT id, section, project, created_at FROM mem WHERE NOT deprecated")
def list_active(s, d):
    return R.listed(memory(s, d)).select("id", "section", "project", "created_at")


@query(MEM + f"SELECT id, section, project, deprecated FROM mem WHERE section <> 'project' OR project = '{PROJECT}'")
def list_project(s, d):
    return R.listed(memory(s, d), project=PROJECT, include_deprecated=True).select("id", "section", "project", "deprecated")


@query(MEM + "SELECT id, row_number() OVER (ORDER BY locked DESC, relevance DESC, created_at, id) AS place FROM mem WHERE section = 'identity' AND NOT deprecated")
def identity_order(s, d):
    """Every active identity row; identity_max_records only bounds what is inserted, never what is listed."""
    rows = R.identity(memory(s, d)).select("id", "locked", "relevance", "created_at")
    return numbered(rows, [F.desc("locked"), F.desc("relevance"), F.col("created_at"), F.col("id")]).select("id", "place")


@query(MEM + "SELECT count(*) FILTER (WHERE section = 'identity' AND NOT deprecated) AS identity_count, count(*) FILTER (WHERE section = 'context' AND NOT deprecated) AS context_count, count(*) FILTER (WHERE section = 'project' AND NOT deprecated) AS project_count, count(*) FILTER (WHERE deprecated) AS deprecated_count FROM mem")
def stats_counts(s, d):
    return R.stats(memory(s, d))


@query(MEM + f"SELECT DISTINCT slug FROM (SELECT slug FROM asper_project UNION ALL SELECT project FROM asper_op WHERE kind = 'project_create' UNION ALL SELECT project FROM mem WHERE section = 'project') WHERE {_SLUG.format('slug')}")
def project_registry(s, d):
    return R.registry(memory(s, d), table(s, d, "asper_op"), table(s, d, "asper_project"))


@query(MEM + "SELECT id, project FROM mem WHERE section = 'project' AND project NOT IN (SELECT slug FROM asper_project)")
def unregistered_projects(s, d):
    """Project rows whose slug is not registered."""
    m = memory(s, d).where("section = 'project'")
    return m.join(table(s, d, "asper_project").select(F.col("slug").alias("project")), "project", "left_anti").select("id", "project")


@query(MEM + f"SELECT id, {_LABEL} AS label, len(tags)::INTEGER AS tag_count, tags[1] AS first_tag FROM mem")
def record_labels(s, d):
    """Label and tag accessors."""
    return R.with_label(memory(s, d)).select("id", "label", F.size("tags").alias("tag_count"), F.try_element_at("tags", F.lit(1)).alias("first_tag"))


@query(MEM + """SELECT id, to_json({'id': id, 'section': section, 'project': project, 'source': source, 'access_count': access_count, 'locked': locked, 'deprecated': deprecated, 'updated_at_unix': updated_at}) AS json FROM mem""")
def record_json(s, d):
    """The same object, as both sides write it (content and numbers with a fraction are written differently by the two engines)."""
    got = R.as_json(memory(s, d))
    schema = "id string, section string, project string, source string, access_count bigint, locked boolean, deprecated boolean, updated_at_unix bigint"
    return got.select("id", F.to_json(F.from_json("json", schema), {"ignoreNullFields": "false"}).alias("json"))


@query(MEM + f"SELECT id, round({_EFF}, 6) AS effective FROM mem")
def eff_relevance(s, d):
    return R.effective(memory(s, d), NOW, CFG).select("id", F.round("effective", 6).alias("effective"))


@query(MEM + f"SELECT id, round({_EFF}, 6) AS effective FROM mem WHERE NOT deprecated AND NOT locked AND section <> 'identity' AND {_EFF} < 0.15")
def review_all(s, d):
    return R.review_candidates(memory(s, d), NOW, CFG).select("id", F.round("effective", 6).alias("effective"))


@query(MEM + f"""SELECT row_number() OVER (ORDER BY eff, id)::INTEGER AS handle, id, '[M' || row_number() OVER (ORDER BY eff, id) || '] ' || left({_LABEL}, length({_LABEL}) - 1) || ', idle ' || (greatest(0, {NOW} - last_access) // 86400) || 'd) ' || content AS line
FROM (SELECT *, {_EFF} AS eff FROM mem WHERE NOT deprecated AND NOT locked AND section <> 'identity' AND {_EFF} < 0.15 ORDER BY eff, id LIMIT 16)""")
def review_batch(s, d):
    return R.review_lines(R.review_candidates(memory(s, d), NOW, CFG, CFG.review_batch), NOW)


@query(MEM + f"SELECT id, deprecated_at FROM mem WHERE deprecated AND {NOW} - deprecated_at >= 5184000")
def purge_due(s, d):
    return memory(s, d).where(R.purge_due(NOW, CFG)).select("id", "deprecated_at")


@query(MEM + f"SELECT id, section, project, relevance FROM mem WHERE NOT (deprecated AND {NOW} - deprecated_at >= 5184000)")
def compaction_snapshot(s, d):
    return R.compacted(memory(s, d), NOW, CFG).select("id", "section", "project", "relevance")


_OP_PROBLEM = f"""CASE WHEN NOT coalesce(kind IN ('insert', 'update', 'deprecate', 'keep', 'set_locked', 'access', 'project_create'), false) THEN 'kind' WHEN "at" IS NULL THEN 'at'
  WHEN kind = 'insert' AND (record IS NULL OR ({_problem('record.')}) IS NOT NULL) THEN 'record'
  WHEN kind IN ('update', 'deprecate', 'keep', 'set_locked') AND NOT coalesce({_UUID.format('id')}, false) THEN 'id'
  WHEN kind = 'update' AND coalesce({_BLANK.format('content')}, true) THEN 'content' WHEN kind = 'set_locked' AND "value" IS NULL THEN 'value' WHEN kind = 'access' AND ids IS NULL THEN 'ids'
  WHEN kind = 'project_create' AND NOT coalesce({_SLUG.format('project')}, false) THEN 'project' END"""
OPS = f""", good AS (SELECT *, CASE WHEN "at" > 100000000000 THEN "at" // 1000 ELSE "at" END AS t FROM asper_op WHERE ({_OP_PROBLEM}) IS NULL)
"""


@query(f"SELECT seq, kind, {_OP_PROBLEM} AS reason FROM asper_op WHERE ({_OP_PROBLEM}) IS NOT NULL")
def op_malformed(s, d):
    return J.malformed(table(s, d, "asper_op"))


@query(f"""SELECT count(*) FILTER (WHERE ({_OP_PROBLEM}) IS NOT NULL) AS bad, min(seq) FILTER (WHERE ({_OP_PROBLEM}) IS NOT NULL) > max(seq) FILTER (WHERE ({_OP_PROBLEM}) IS NULL) AS only_tail FROM asper_op""")
def journal_tail(s, d):
    return J.journal_ends_torn(table(s, d, "asper_op"))


@query(f"WITH x AS (SELECT 1){OPS} SELECT lower(i) AS id, count(*) AS n FROM (SELECT unnest(ids) AS i FROM good WHERE kind = 'access') GROUP BY 1")
def access_flush(s, d):
    return J.access_counts(table(s, d, "asper_op"))


REPLAY = (
    MEM
    + OPS
    + f""", ins AS (SELECT lower(record.id) AS k, arg_min(record, seq) AS r, min(seq) AS born FROM good WHERE kind = 'insert' GROUP BY 1),
flat AS (SELECT unnest(r), born FROM ins),
fresh AS ({_read('flat', ', born')}),
beg AS (SELECT *, -1 AS born FROM mem UNION ALL SELECT * FROM fresh WHERE id NOT IN (SELECT id FROM mem)),
acc AS (SELECT lower(i) AS id, seq, t, count(*) AS n FROM (SELECT unnest(ids) AS i, seq, t FROM good WHERE kind = 'access') GROUP BY 1, 2, 3),
ev AS (
  SELECT b.id, b.deprecated AS off, b.born, e.seq, e.kind, e.t, e.content, e.v, e.n FROM beg b JOIN (
    SELECT lower(id) AS id, seq, kind, t, content, "value" AS v, 1 AS n FROM good WHERE kind IN ('update', 'deprecate', 'keep', 'set_locked')
    UNION ALL SELECT id, seq, 'access', t, NULL, NULL, n FROM acc) e ON e.id = b.id AND e.seq > b.born
),
st AS (SELECT *, last_value(CASE WHEN kind IN ('keep', 'deprecate') THEN kind END IGNORE NULLS) OVER w AS st, max(CASE WHEN kind = 'keep' THEN seq ELSE born END) OVER w AS kept FROM ev WINDOW w AS (PARTITION BY id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
chg AS (
  SELECT id, arg_max(content, seq) FILTER (WHERE kind = 'update' AND coalesce(st = 'keep', NOT off)) AS content, arg_max(t, seq) FILTER (WHERE kind = 'update' AND coalesce(st = 'keep', NOT off)) AS upd,
    arg_max(v, seq) FILTER (WHERE kind = 'set_locked') AS locked, arg_max(t, seq) FILTER (WHERE kind IN ('keep', 'access')) AS acc,
    coalesce(sum(n) FILTER (WHERE kind = 'access'), 0) AS touch, coalesce(sum(n) FILTER (WHERE kind IN ('access', 'keep')), 0) AS boost,
    arg_max(kind, seq) FILTER (WHERE kind IN ('keep', 'deprecate')) AS st, max(kept) FILTER (WHERE kind = 'deprecate') AS stretch
  FROM st GROUP BY id
),
gone AS (SELECT s.id, arg_min(s.t, s.seq) AS t FROM st s JOIN chg c ON c.id = s.id AND s.kept = c.stretch WHERE s.kind = 'deprecate' GROUP BY 1),
now_is AS (
  SELECT b.id, section, project, coalesce(c.content, b.content) AS content, b.source, coalesce(c.upd, b.updated_at) AS updated_at, coalesce(c.acc, b.last_access) AS last_access,
    (b.access_count + coalesce(c.touch, 0))::BIGINT AS access_count, least(1.0, b.relevance + 0.05::DOUBLE * coalesce(c.boost, 0)) AS relevance, coalesce(c.locked, b.locked) AS locked,
    CASE WHEN c.st IS NULL THEN b.deprecated ELSE c.st = 'deprecate' END AS deprecated,
    (CASE WHEN c.st IS NULL OR (c.st = 'deprecate' AND b.deprecated AND c.stretch = b.born) THEN b.deprecated_at WHEN c.st = 'deprecate' THEN g.t ELSE 0 END)::BIGINT AS deprecated_at
  FROM beg b LEFT JOIN chg c ON c.id = b.id LEFT JOIN gone g ON g.id = b.id
)
"""
)


@query(REPLAY + "SELECT id, section, content, updated_at, last_access, access_count, round(relevance, 6) AS relevance, locked, deprecated, deprecated_at FROM now_is")
def replay_state(s, d):
    got = J.replay(table(s, d, "asper_record"), table(s, d, "asper_op"), NOW)
    return got.select("id", "section", "content", "updated_at", "last_access", "access_count", F.round("relevance", 6).alias("relevance"), "locked", "deprecated", "deprecated_at")


@query(
    MEM
    + OPS
    + """, e AS (
  SELECT lower(coalesce(record.id, id)) AS id, seq, kind, coalesce(record.content, content) AS content, "value" AS v, false AS off FROM good WHERE kind IN ('insert', 'update', 'deprecate', 'keep', 'set_locked')
  UNION ALL SELECT id, -1, 'start', NULL, locked, deprecated FROM mem),
a AS (SELECT *, sum(CASE WHEN kind IN ('start', 'insert') AND length(coalesce(content, '')) <= 500 THEN 1 ELSE 0 END) OVER w AS begun,
  coalesce(last_value(CASE WHEN kind IN ('start', 'set_locked') THEN v END IGNORE NULLS) OVER w, false) AS locked FROM e WINDOW w AS (PARTITION BY id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, begun > 0 AND NOT (kind = 'insert' AND begun = 1) AS there FROM a),
c AS (SELECT *, last_value(CASE WHEN kind = 'start' THEN NOT off WHEN there AND kind = 'keep' THEN true WHEN there AND kind = 'deprecate' AND NOT locked THEN false END IGNORE NULLS) OVER (PARTITION BY id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS active FROM b)
SELECT seq, kind, CASE WHEN kind IN ('insert', 'update') AND length(coalesce(content, '')) > 500 THEN 'invalid' WHEN kind = 'insert' AND there THEN 'invalid' WHEN kind = 'insert' THEN 'ok' WHEN NOT there THEN 'not_found'
  WHEN kind IN ('update', 'deprecate') AND locked THEN 'locked' WHEN kind = 'update' AND NOT coalesce(active, true) THEN 'invalid' ELSE 'ok' END AS outcome FROM c WHERE kind <> 'start'"""
)
def op_outcomes(s, d):
    return J.op_outcomes(table(s, d, "asper_record"), table(s, d, "asper_op"), NOW)


@query(REPLAY + "SELECT n.id FROM now_is n LEFT JOIN mem m ON m.id = n.id AND NOT m.deprecated AND m.content = n.content WHERE NOT n.deprecated AND m.id IS NULL")
def stale_embeddings(s, d):
    """Active records after the journal whose vector, kept from before it, is missing or of another content."""
    before = memory(s, d).where("not deprecated").select("id", hashing.fnv1a64(F.col("content")).alias("content_hash"))
    return embedding.stale(before, J.replay(table(s, d, "asper_record"), table(s, d, "asper_op"), NOW)).select("id")


# Scalar functions. --------------------------------------------------------------------------------------


@query("SELECT id, length(content) AS chars, octet_length(encode(content)) AS bytes, greatest(1, octet_length(encode(content)) // 4) AS tokens FROM asper_record")
def token_estimate(s, d):
    c = F.col("content")
    return table(s, d, "asper_record").select("id", text.utf8_count(c).alias("chars"), F.octet_length(c).cast("bigint").alias("bytes"), text.token_heuristic(c).alias("tokens"))


@query(r"""SELECT id, '- ' || regexp_replace(content, '[\x{00}-\x{1F}\x{7F}\x{85}\x{2028}\x{2029}]', ' ', 'g') AS line FROM asper_record""")
def sanitize_line(s, d):
    return table(s, d, "asper_record").select("id", text.data_line(F.col("content")).alias("line"))


@query(rf"SELECT session, seq, any_value(trim(text, E' \t\n\r\x0B\f')) AS trimmed, any_value(coalesce({_BLANK.format('text')}, true)) AS blank FROM asper_turn GROUP BY session, seq")
def trim_and_blank(s, d):
    return table(s, d, "asper_turn").dropDuplicates(["session", "seq"]).select("session", "seq", text.str_trim(F.col("text")).alias("trimmed"), text.str_blank(F.col("text")).alias("blank"))


@query(f"SELECT id, project, coalesce({_SLUG.format('project')}, false) AS slug_ok, coalesce({_UUID.format('supersedes')}, false) AS uuid_ok FROM asper_record")
def slug_and_uuid(s, d):
    return table(s, d, "asper_record").select("id", "project", text.slug_valid(F.col("project")).alias("slug_ok"), text.uuid_valid(F.col("supersedes")).alias("uuid_ok"))


@query(r"""SELECT id, CASE WHEN contains(c, '\') THEN replace(replace(replace(replace(c, '\', '\\'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') ELSE c END AS escaped, c AS decoded
FROM (SELECT id, replace(replace(content, ' / ', '\'), 'ä', chr(10)) AS c FROM asper_record WHERE content LIKE '% / %')""")
def escapes_roundtrip(s, d):
    """s6, s7: contents with a backslash put in for each ' / ', escaped and back."""
    c = F.replace(F.replace("content", F.lit(" / "), F.lit("\\")), F.lit("ä"), F.lit("\n"))
    rows = table(s, d, "asper_record").where(F.contains("content", F.lit(" / "))).select("id", text.esc_encode(c).alias("escaped"))
    return rows.select("id", "escaped", text.esc_decode(F.col("escaped")).alias("decoded"))


@query("""SELECT id, (SELECT list_reduce(list_concat([14695981039346656037::UHUGEINT], list_transform(range(1, octet_length(encode(content)) + 1), lambda i: ('0x' || hex(encode(content))[2 * i - 1:2 * i])::INTEGER::UHUGEINT)),
  lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT))::DECIMAL(20, 0) AS fnv FROM asper_record""")
def content_fnv(s, d):
    return table(s, d, "asper_record").select("id", hashing.fnv1a64(F.col("content")).alias("fnv"))


@query("SELECT id, sha256(content) AS sha, base64(encode(content)) AS b64, content AS back, lower(id) AS uuid FROM asper_record")
def sha_and_base64(s, d):
    b64 = hashing.base64_encode(F.col("content"))
    return table(s, d, "asper_record").select(
        "id", hashing.sha256(F.col("content")).alias("sha"), b64.alias("b64"), F.decode(hashing.base64_decode(b64), "UTF-8").alias("back"), hashing.bytes_to_uuid(hashing.uuid_to_bytes(F.col("id"))).alias("uuid")
    )


@query("SELECT id, strftime(make_timestamp(created_at * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS text, created_at AS back, created_at - 5400 AS shifted, NULL::BIGINT AS bad FROM asper_record WHERE created_at IS NOT NULL")
def rfc3339_roundtrip(s, d):
    t = time.format_rfc3339(F.col("created_at"))
    shifted = F.concat(F.expr("left(text, 19)"), F.lit(".25+01:30"))
    rows = table(s, d, "asper_record").where("created_at is not null").select("id", t.alias("text"))
    return rows.select("id", "text", time.parse_rfc3339(F.col("text")).alias("back"), time.parse_rfc3339(shifted).alias("shifted"), time.parse_rfc3339(F.expr("left(text, 10)")).alias("bad"))


@query("""SELECT id, n AS days, n * 86400 + (n % 24) * 3600 + (n % 60) * 60 + 5 AS total, n * 604800 AS weeks, NULL::BIGINT AS bad FROM (SELECT id, coalesce(abs(access_count), 1) % 1000 AS n FROM asper_record)""")
def duration_parse(s, d):
    rows = table(s, d, "asper_record").select("id", (F.coalesce(F.abs("access_count"), F.lit(1)) % 1000).alias("n"))
    w = F.format_string("P%dDT%dH%dM5S", F.col("n"), F.col("n") % 24, F.col("n") % 60)
    return rows.select("id", F.col("n").alias("days"), time.parse_duration(w).alias("total"), time.parse_duration(F.format_string("P%dW", F.col("n"))).alias("weeks"), time.parse_duration(F.format_string("P%dM", F.col("n"))).alias("bad"))


# Vectors. ---------------------------------------------------------------------------------------------------

_WORDS = r"list_filter(regexp_split_to_array({0}, '[ \t\n\r\x0B\f]+'), lambda w: w <> '')"
_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _bow(view: str, key: str, column: str) -> str:
    """Words of at most 127 bytes only need the lowest four bits of each byte."""
    return f"""word AS (SELECT {key}, unnest({_WORDS.format(_LOW.format(column))}) AS w FROM {view}),
spelt AS (SELECT DISTINCT w, left(hex(encode(w)), 254) AS h FROM word),
slot AS (SELECT w, list_reduce(list_concat([5], list_transform(range(1, length(h) // 2 + 1), lambda i: instr('0123456789ABCDEF', h[2 * i:2 * i]) - 1)), lambda a, b: (xor(a, b) * 3) & 15) AS b FROM spelt),
tf AS (SELECT {key}, b, count(*)::DOUBLE AS n FROM word JOIN slot USING (w) GROUP BY ALL),
size AS (SELECT {key}, sqrt(sum(n * n)) AS z FROM tf GROUP BY ALL),
bow AS (SELECT {key}, b, (n / z)::FLOAT AS x FROM tf JOIN size USING ({key}))"""


SEARCH = (
    MEM
    + f""", q AS (SELECT 'q' AS qid, '{QUERY}' AS t), """
    + _bow("mem", "id", "content")
    + ", "
    + _bow("q", "qid", "t").replace("word", "qword").replace("spelt", "qspelt").replace("slot", "qslot").replace("tf", "qtf").replace("size", "qsize").replace("bow", "qbow")
    + f""", cosine AS (SELECT id, sum(bow.x::DOUBLE * qbow.x::DOUBLE) AS cos FROM bow JOIN qbow USING (b) GROUP BY id),
scored AS (SELECT m.*, coalesce(c.cos, 0.0) AS cos, 0.7::DOUBLE * coalesce(c.cos, 0.0) + 0.2::DOUBLE * {_EFF} + 0.1::DOUBLE * ({_FACTOR.format('updated_at')}) AS score FROM mem m LEFT JOIN cosine c USING (id) WHERE NOT deprecated)
"""
)
_RANKED = "SELECT id, round(cos, 6) AS cos, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, updated_at DESC, id)::INTEGER AS rank FROM scored WHERE {0} AND cos >= {1} ORDER BY score DESC, updated_at DESC, id LIMIT {2}"


def _search(s, d, **how) -> DataFrame:
    found = retrieval.search(index(s, d), vectors.bow([QUERY])[0].tolist(), NOW, CFG, **how)
    return found.select("id", F.round("cos", 6).alias("cos"), F.round("score", 6).alias("score"), "rank")


@query(SEARCH + _RANKED.format("section = 'context'", 0.25, 6))
def search_context(s, d):
    return _search(s, d, section="context")


@query(SEARCH + _RANKED.format(f"section = 'project' AND project = '{PROJECT}'", 0.25, 8))
def search_project(s, d):
    return _search(s, d, section="project", project=PROJECT)


@query(SEARCH + _RANKED.format("section <> 'project'", 0.25, 12))
def search_any(s, d):
    return _search(s, d)


@query(SEARCH + _RANKED.format(f"(section <> 'project' OR project = '{PROJECT}')", 0.8, 50))
def search_floor(s, d):
    return _search(s, d, project=PROJECT, floor=0.8, k=50)


@query(SEARCH + "SELECT id, round(cos, 6) AS cos FROM scored WHERE section <> 'project' ORDER BY cos DESC, updated_at DESC, id LIMIT 40")
def rank_by_cosine(s, d):
    return retrieval.by_cosine(index(s, d), vectors.bow([QUERY])[0].tolist(), 40).select("id", F.round("cos", 6).alias("cos"))


@query(SEARCH + f"SELECT id, round(cos, 6) AS cos, round({_EFF}, 6) AS effective, round({_FACTOR.format('updated_at')}, 6) AS recency, round(score, 6) AS score FROM scored")
def score_components(s, d):
    rows = index(s, d).where("not deprecated").withColumn("cos", retrieval.cosine(vectors.bow([QUERY])[0].tolist()))
    fresh = scoring.decay_factor(F.lit(NOW) - F.col("updated_at"), scoring.half_life(F.col("section"), CFG))
    return rows.select("id", F.round("cos", 6).alias("cos"), F.round(scoring.effective_relevance(NOW, CFG), 6).alias("effective"), F.round(fresh, 6).alias("recency"), F.round(scoring.score(F.col("cos"), NOW, CFG), 6).alias("score"))


@query(MEM + ", " + _bow("mem", "id", "content") + " SELECT id, b::INTEGER AS bucket, round(x::DOUBLE, 6) AS weight FROM bow")
def bow_vectors(s, d):
    return index(s, d).select("id", F.posexplode("vec").alias("bucket", "x")).where("x > 0").select("id", "bucket", F.round(F.col("x").cast("double"), 6).alias("weight"))


@query("""WITH p AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_dot_product(q.embedding::FLOAT[64]::DOUBLE[], e.embedding::DOUBLE[]), 5) AS cos FROM embeddings q JOIN embeddings e ON true WHERE q.vec_id % 100 = 0)
SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, id) AS r FROM p) WHERE r <= 10""")
def nearest_embeddings(s, d):
    """The ten nearest of every hundredth vector over the whole index."""
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), vectors.normalized(F.col("embedding")).alias("vec"))
    return retrieval.nearest(e, e.where("id % 100 = 0").withColumnRenamed("id", "query_id"), 10).select("query_id", "id")


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS length, 1.0::DOUBLE AS after FROM embeddings")
def vector_lengths(s, d):
    """A7, s46: norms before and after normalizing."""
    return table(s, d, "embeddings").select("vec_id", F.round(vectors.norm(F.col("embedding")), 5).alias("length"), F.round(vectors.norm(vectors.normalized(F.col("embedding"))), 5).alias("after"))


_TURN_KNN = (
    MEM
    + ", "
    + TURNS.removeprefix("WITH ")
    + ", asked AS (SELECT session || ':' || seq AS tid, text FROM turn WHERE seq % 100 = 0), "
    + _bow("mem", "id", "content")
    + ", "
    + _bow("asked", "tid", "text").replace("word", "qword").replace("spelt", "qspelt").replace("slot", "qslot").replace("tf", "qtf").replace("size", "qsize").replace("bow", "qbow")
    + """, pair AS (SELECT tid, id, round(sum(bow.x::DOUBLE * qbow.x::DOUBLE), 5) AS cos FROM bow JOIN qbow USING (b) JOIN mem USING (id) WHERE NOT deprecated AND section <> 'project' GROUP BY ALL)
"""
)


def _per_turn(s, d) -> DataFrame:
    asked = turns(s, d).where("seq % 100 = 0").select(F.concat_ws(":", "session", F.col("seq").cast("string")).alias("query_id"), vectors.bow_vector("text").alias("vec"))
    return retrieval.nearest(index(s, d).where(R.matches_scan()), asked, 3, floor=CFG.min_similarity)


@query(_TURN_KNN + "SELECT tid AS query_id, count(*) AS hits, max(cos) AS best FROM (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY cos DESC, id) AS r FROM pair WHERE cos >= 0.25) WHERE r <= 3 GROUP BY 1")
def related_per_turn(s, d):
    """The three nearest memories of every hundredth turn, counted with the best cosine."""
    return _per_turn(s, d).groupBy("query_id").agg(F.count("*").alias("hits"), F.round(F.max("cos"), 5).alias("best"))


@query(_TURN_KNN + "SELECT count(*) AS n, max(cos) AS best FROM (SELECT id, max(cos) AS cos FROM (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY cos DESC, id) AS r FROM pair WHERE cos >= 0.25) WHERE r <= 3 GROUP BY id ORDER BY 2 DESC LIMIT 12)")
def related_union(s, d):
    """A3, T5: their union by id with the best cosine, twelve at most."""
    return retrieval.union_best(_per_turn(s, d)).agg(F.count("*").alias("n"), F.round(F.max("cos"), 5).alias("best"))


def _related(s, d) -> DataFrame:
    """session, id, cos, handle: three memories for each turn, their union by id for each session, twelve at most."""
    told = table(s, d, "asper_turn").select("session", "seq", "role", "text")
    # in as many tasks as they deserve: most sessions whole in one, so that what they share is found there, a long one in stretches
    told = told.withColumn("stretch", F.floor(F.col("seq") / 64)).repartition(tasks_for(told, 1 << 20), "session", "stretch")
    said = curation.turns_accepted(told, ["stretch"]).select("session", "seq", vectors.bow_vector("text").alias("vec"))
    hits = retrieval.nearest_of_all(index(s, d).where(R.matches_scan()), said, 3, floor=CFG.min_similarity, per="session", cap=HANDLES)
    return retrieval.union_best(hits, HANDLES, ["session"])


@query()
def related_by_session(s, d):
    """The memories related to all turns of each session, numbered best first."""
    return _related(s, d).select("session", "handle", "id", F.round("cos", 5).alias("cos"))


@query(
    MEM
    + OPS
    + ", asked AS (SELECT seq AS tid, record.section AS section, record.project AS project, record.content AS content FROM good WHERE kind = 'insert' AND seq % 100 = 0), "
    + _bow("mem", "id", "content")
    + ", "
    + _bow("asked", "tid", "content").replace("word", "qword").replace("spelt", "qspelt").replace("slot", "qslot").replace("tf", "qtf").replace("size", "qsize").replace("bow", "qbow")
    + """ SELECT tid AS query_id, round(max(cos), 3) AS cos FROM (SELECT tid, m.id, round(sum(bow.x::DOUBLE * qbow.x::DOUBLE), 5) AS cos FROM bow JOIN qbow USING (b) JOIN mem m USING (id) JOIN asked a USING (tid)
  WHERE NOT m.deprecated AND m.section = a.section AND m.project IS NOT DISTINCT FROM a.project GROUP BY ALL) WHERE cos >= 0.92 GROUP BY 1"""
)
def insert_duplicates(s, d):
    """Inserts (every hundredth op) that repeat an active record of the same section and project."""
    asked = J.readable(table(s, d, "asper_op")).where("kind = 'insert' and seq % 100 = 0")
    asked = asked.select(F.col("seq").alias("query_id"), vectors.bow_vector("record.content").alias("vec"), curation.scope(F.col("record.section"), F.col("record.project")).alias("scope"))
    active = index(s, d).where("not deprecated").withColumn("scope", curation.scope(F.col("section"), F.col("project")))
    return curation.duplicates(asked, active, CFG).select("query_id", F.round("cos", 3).alias("cos"))


# Budgets and prompts. -------------------------------------------------------------------------------------

_LINE = r"regexp_replace(content, '[\x{00}-\x{1F}\x{7F}\x{85}\x{2028}\x{2029}]', ' ', 'g')"
_PREFIX = (
    MEM
    + f""", ranked AS (SELECT id, project, content, row_number() OVER (PARTITION BY project ORDER BY relevance DESC, created_at, id) AS rank, greatest(1, octet_length(encode('- ' || {_LINE} || chr(10))) // 4) AS tokens FROM mem WHERE section = 'project' AND NOT deprecated),
sums AS (SELECT *, sum(tokens) OVER (PARTITION BY project ORDER BY rank) AS used FROM ranked)
"""
)


def _prefix(s, d) -> DataFrame:
    rows = memory(s, d).where("section = 'project' and not deprecated")
    return inject.budget_prefix(rows, [F.desc("relevance"), F.col("created_at"), F.col("id")], CFG.project_tokens, ["project"])


@query(_PREFIX + "SELECT id, project, rank::INTEGER AS rank, tokens, used::BIGINT AS used FROM sums WHERE used <= 800")
def budget_prefix(s, d):
    """B1: what of each project fits its budget."""
    return _prefix(s, d).where("injected").select("id", "project", "rank", "tokens", "used")


@query(_PREFIX + f"SELECT project, string_agg('- ' || {_LINE}, chr(10) ORDER BY rank) AS block FROM sums WHERE used <= 800 GROUP BY project")
def project_blocks(s, d):
    """The block of lines of each project."""
    lines = _prefix(s, d).where("injected").withColumn("line", text.data_line(F.col("content")))
    return inject.joined(lines, "rank", "line", ["project"])


_TAIL = (
    TURNS
    + """, said AS (SELECT session, seq, CASE role WHEN 'user' THEN 'USER: ' ELSE 'ASSISTANT: ' END || text AS line FROM turn),
cost AS (SELECT *, greatest(1, octet_length(encode(line)) // 4) AS tokens, row_number() OVER (PARTITION BY session ORDER BY seq DESC) AS rn FROM said),
tail AS (SELECT *, sum(tokens) OVER (PARTITION BY session ORDER BY rn) AS used FROM cost)
"""
)


@query(_TAIL + "SELECT session, seq, line, tokens FROM tail WHERE used <= 1200 OR rn = 1")
def transcript_tail(s, d):
    return inject.transcript_tail(turns(s, d), CFG.transcript_tokens)


@query(_TAIL + "SELECT session, 'Existing memories: (none)' || chr(10) || chr(10) || 'Conversation:' || chr(10) || string_agg(line, chr(10) ORDER BY seq) || chr(10) AS prompt FROM tail WHERE used <= 1200 OR rn = 1 GROUP BY session")
def cycle_prompts(s, d):
    """The prompt of a cycle for each session, before anything is remembered."""
    nothing = memory(s, d).where("false").select(F.lit(1).alias("handle"), "section", "project", "content")
    return curation.cycle_prompts(turns(s, d), nothing, CFG)


@query()
def cycle_prompts_related(s, d):
    """The prompt of a cycle for each session with the memories related to its turns."""
    shown = _related(s, d).join(memory(s, d).where(R.matches_scan()).select("id", "section", "project", "content"), "id")
    return curation.cycle_prompts(turns(s, d), shown.select("session", "handle", "section", "project", "content"), CFG)


@query()
def render_prompt(s, d):
    """The whole prompt for one message (one row; its parts have SQL of their own)."""
    vec = vectors.bow([QUERY])[0].tolist()
    lines = {}
    ident = inject.budget_prefix(memory(s, d).where("section = 'identity' and not deprecated"), [F.desc("locked"), F.desc("relevance"), F.col("created_at"), F.col("id")], CFG.identity_tokens)
    lines["identity"] = [r[0] for r in ident.where("injected").orderBy("rank").select(text.data_line(F.col("content"))).collect()]
    for section, project, budget in (("context", None, CFG.context_tokens), ("project", PROJECT, CFG.project_tokens)):
        hits = retrieval.search(index(s, d), vec, NOW, CFG, section, project)
        hits = inject.budget_prefix(hits.drop("rank"), [F.desc("score"), F.desc("updated_at"), F.col("id")], budget)
        lines[section] = [r[0] for r in hits.where("injected").orderBy("rank").select(text.data_line(F.col("content"))).collect()]
    prompt = inject.render("You are a helpful assistant.", lines["identity"], lines["context"], lines["project"], PROJECT)
    return s.createDataFrame([(prompt,)], "prompt string")


# Turns and protocol. --------------------------------------------------------------------------------------


@query(TURNS + "SELECT session, seq, role FROM turn")
def turn_filter(s, d):
    return turns(s, d).select("session", "seq", "role")


@query(TURNS + "SELECT session, seq, (row_number() OVER (PARTITION BY session ORDER BY seq) - 1) // 4 AS batch FROM turn")
def turn_batches(s, d):
    return curation.turn_batches(turns(s, d), CFG)


@query(TURNS + """SELECT session, seq, gap FROM (SELECT session, seq, "at" - lag("at") OVER (PARTITION BY session ORDER BY seq) AS gap FROM turn WHERE "at" IS NOT NULL) WHERE gap >= 30""")
def idle_gaps(s, d):
    return curation.idle_gaps(turns(s, d), CFG)


@query(TURNS + "SELECT session, seq FROM (SELECT session, seq, row_number() OVER (PARTITION BY session ORDER BY seq DESC) AS r FROM turn) WHERE r <= 256")
def turn_queue(s, d):
    return curation.queued(turns(s, d), CFG).select("session", "seq")


_TRIM = r"trim({0}, E' \t\n\r\x0B\f')"
PARSED = rf"""WITH raw AS (SELECT doc_id, i AS line_no, {_TRIM.format("parts[i]")} AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), unnest(range(1, len(parts) + 1)) AS u(i)),
cutup AS (SELECT *, regexp_extract(line, '^(INSERT|UPDATE|DEPRECATE|KEEP|CITE|ANSWER)(?:[ \t]|$)', 1) AS verb, regexp_matches(line, '^(?:INSERT|UPDATE|DEPRECATE)(?:[ \t]+.*? \|| \|)(?: |$)') AS has_sep,
  {_TRIM.format(r"regexp_extract(line, '^(?:INSERT|UPDATE|DEPRECATE)[ \t]+(.*?)(?: \|$| \| .*$)', 1)")} AS head, {_TRIM.format(r"regexp_extract(line, '^(?:INSERT|UPDATE|DEPRECATE).*? \| (.*)$', 1)")} AS tail FROM raw WHERE line <> ''),
num AS (SELECT *, try_cast(CASE WHEN verb IN ('UPDATE', 'DEPRECATE') THEN regexp_extract(head, '^M(\d+)(?:[ \t]|$)', 1) WHEN verb IN ('KEEP', 'CITE') THEN regexp_extract(line, '^\w+[ \t]+M(\d+)(?:[ \t]|$)', 1) END AS INTEGER) AS h FROM cutup),
parsed AS (SELECT doc_id, line_no, CASE WHEN line IN ('NOOP', 'NOMEM') THEN line WHEN verb = 'INSERT' AND has_sep AND head IN ('identity', 'context', 'project') THEN 'INSERT'
  WHEN verb IN ('UPDATE', 'DEPRECATE') AND has_sep AND h BETWEEN 1 AND {HANDLES} THEN verb WHEN verb IN ('KEEP', 'CITE') AND h BETWEEN 1 AND {HANDLES} THEN verb WHEN verb = 'ANSWER' AND regexp_matches(line, '^ANSWER[ \t]+\|') THEN 'ANSWER' END AS kind, head, h,
  CASE WHEN verb = 'ANSWER' THEN {_TRIM.format(r"regexp_extract(line, '^ANSWER[ \t]+\|(.*)$', 1)")} ELSE tail END AS tail FROM num)
"""


def parsed(s, d) -> DataFrame:
    return protocol.parse(table(s, d, "documents").where("text is not null"), "doc_id", "text", HANDLES)


@query(PARSED + "SELECT doc_id, line_no, kind, CASE WHEN kind = 'INSERT' THEN head END AS section, CASE WHEN kind IN ('UPDATE', 'DEPRECATE', 'KEEP', 'CITE') THEN h END AS handle, CASE WHEN kind IN ('INSERT', 'UPDATE', 'DEPRECATE', 'ANSWER') THEN tail END AS text, kind IS NULL AS bad FROM parsed")
def protocol_parse(s, d):
    """G1 over all documents, most of which are no replies: their lines count as malformed."""
    return parsed(s, d)


@query(PARSED + "SELECT coalesce(kind, 'BAD') AS kind, count(*) AS n FROM parsed GROUP BY 1")
def protocol_tallies(s, d):
    return protocol.tallies(parsed(s, d))


@query(PARSED + "SELECT doc_id, line_no, kind, slot, slot <= 8 AS taken FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS slot FROM parsed WHERE kind <> 'NOOP')")
def op_cap(s, d):
    return protocol.capped(parsed(s, d), "doc_id", CFG.max_ops_per_cycle).select("doc_id", "line_no", "kind", "slot", "taken")


@query(PARSED + "SELECT doc_id, h AS handle, min(line_no) AS line_no FROM parsed WHERE kind = 'CITE' GROUP BY ALL")
def cite_dedup(s, d):
    return protocol.cites(parsed(s, d), "doc_id")


@query(PARSED + "SELECT doc_id, arg_min(tail, line_no) AS answer FROM parsed WHERE kind = 'ANSWER' GROUP BY 1")
def first_answer(s, d):
    return protocol.answers(parsed(s, d), "doc_id")


_GUARD = (
    PARSED
    + ", "
    + MEM.removeprefix("WITH ")
    + """, cand AS (SELECT row_number() OVER (ORDER BY created_at, id) AS h, id, locked, section AS r_section FROM (SELECT * FROM mem WHERE NOT deprecated ORDER BY created_at, id LIMIT 12)),
ops AS (SELECT p.*, c.locked AS r_locked, c.r_section, c.id FROM parsed p LEFT JOIN cand c ON c.h = p.h AND p.kind IN ('UPDATE', 'DEPRECATE') WHERE p.kind IN ('INSERT', 'UPDATE', 'DEPRECATE')),
judged AS (SELECT *, CASE WHEN kind IN ('UPDATE', 'DEPRECATE') AND coalesce(r_locked, false) THEN 'locked' WHEN kind IN ('UPDATE', 'DEPRECATE') AND r_section IS NULL THEN 'not_found' WHEN kind <> 'DEPRECATE' AND coalesce(tail, '') = '' THEN 'blank'
  WHEN kind <> 'DEPRECATE' AND length(tail) > 500 THEN 'too_long' WHEN kind = 'INSERT' AND head = 'project' THEN 'no_project' END AS reason FROM ops)
"""
)


@query(_GUARD + "SELECT doc_id, line_no, kind, reason, kind <> 'INSERT' AND coalesce(r_section, '') = 'identity' AND reason IS NULL AS needs_quorum FROM judged")
def guarded_ops(s, d):
    """Reasons against the ops of all replies, handles meaning the twelve oldest active records."""
    from pyspark.sql import Window as W

    oldest = memory(s, d).where("not deprecated").orderBy("created_at", "id").limit(HANDLES)
    cand = oldest.select(F.row_number().over(W.orderBy("created_at", "id")).alias("handle"), F.col("locked").alias("r_locked"), F.col("section").alias("r_section"))
    ops = parsed(s, d).where("kind in ('INSERT', 'UPDATE', 'DEPRECATE')").join(F.broadcast(cand), "handle", "left")  # twelve rows
    return curation.guarded(ops, CFG).select("doc_id", "line_no", "kind", "reason", "needs_quorum")


@query(
    MEM
    + OPS
    + """, prop AS (SELECT DISTINCT lower(g.id) AS id, g.kind, md5(coalesce(g.content, g.reason, '')) AS hash, g.t FROM good g WHERE g.kind IN ('update', 'deprecate', 'keep')),
gap AS (SELECT *, t - lag(t) OVER w AS gap FROM prop WINDOW w AS (PARTITION BY id, kind, hash ORDER BY t)),
part AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 604800 THEN 1 ELSE 0 END) OVER (PARTITION BY id, kind, hash ORDER BY t) AS stretch FROM gap)
SELECT id, kind, hash, t AS "at", row_number() OVER (PARTITION BY id, kind, hash, stretch ORDER BY t) % 2 = 0 AS confirmed FROM part"""
)
def quorum_confirm(s, d):
    """Proposals that an equal one within seven days confirms."""
    ops = J.readable(table(s, d, "asper_op")).where("kind in ('update', 'deprecate', 'keep')")
    return curation.quorum(ops.select(F.lower("id").alias("id"), "kind", F.md5(F.coalesce("content", "reason", F.lit(""))).alias("hash"), "at"), CFG.identity_confirm_window)


@query(
    MEM
    + f""", cand AS (SELECT id, right(id, 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') AS keep FROM mem WHERE NOT deprecated AND NOT locked AND section <> 'identity' AND {_EFF} < 0.15)
SELECT m.id, round(CASE WHEN c.keep THEN least(1.0, relevance + 0.05::DOUBLE) ELSE relevance END, 6) AS relevance, coalesce(NOT c.keep, deprecated) AS deprecated,
  CASE WHEN c.keep THEN 0 WHEN NOT c.keep THEN {NOW} ELSE deprecated_at END::BIGINT AS deprecated_at, CASE WHEN c.keep THEN {NOW} ELSE last_access END::BIGINT AS last_access FROM mem m LEFT JOIN cand c USING (id)"""
)
def review_applied(s, d):
    """Verdicts on all review candidates, KEEP for ids that end in an even digit, else DEPRECATE."""
    m = memory(s, d)
    even = F.expr("right(id, 1) in ('0', '2', '4', '6', '8', 'a', 'c', 'e')")
    verdicts = R.review_candidates(m, NOW, CFG).select("id", F.when(even, "KEEP").otherwise("DEPRECATE").alias("kind"))
    return curation.reviewed(m, verdicts, NOW).select("id", F.round("relevance", 6).alias("relevance"), "deprecated", "deprecated_at", "last_access")


@query(SEARCH + """, hit AS (SELECT id FROM scored WHERE section <> 'project' AND cos >= 0.25 ORDER BY score DESC, updated_at DESC, id LIMIT 12)
SELECT id, access_count + (id IN (SELECT id FROM hit))::INTEGER AS access_count, round(CASE WHEN id IN (SELECT id FROM hit) THEN least(1.0, relevance + 0.05::DOUBLE) ELSE relevance END, 6) AS relevance FROM mem""")
def recall_touched(s, d):
    """Records after a recall that cites all it found."""
    cited = retrieval.search(index(s, d), vectors.bow([QUERY])[0].tolist(), NOW, CFG, k=CFG.recall_k).select("id", F.lit(1).alias("n"))
    return curation.touched(memory(s, d), cited, NOW).select("id", "access_count", F.round("relevance", 6).alias("relevance"))
