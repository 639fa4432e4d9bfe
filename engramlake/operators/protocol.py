"""The line protocol between engine and text model: parsing, limits, grammars, instructions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from engramlake.functions.text import str_trim

# What the model is told.
CURATION = """\
You maintain the long-term memory of an AI assistant. You will see
the recent conversation and a list of existing memories labeled [M1]...[Mn].

Decide what deserves to be remembered.
Answer ONLY with operations, one per line:

INSERT identity | <fact>    the assistant's persona, values, tone, style
INSERT context | <fact>     the user, their preferences, their environment
INSERT project | <fact>     the currently active project
UPDATE M<n> | <fact>        replace an existing memory with a better version
DEPRECATE M<n> | <reason>   the memory is wrong or obsolete
NOOP                        nothing worth remembering

Rules:
- A fact is one self-contained sentence (max 500 characters), understandable
  without the conversation.
- Prefer UPDATE over INSERT when an existing memory covers the same topic.
- Store durable facts, not chit-chat. Never store secrets or one-off trivia.
- When in doubt: NOOP.
"""
REVIEW = """\
You maintain the long-term memory of an AI assistant. The memories
listed below, labeled [M1]...[Mn], have decayed and are candidates for
removal.

Review each candidate. Answer ONLY with operations, one per line:

DEPRECATE M<n> | <reason>   the memory is wrong, obsolete, or useless
KEEP M<n>                   the memory is still valuable
NOOP                        no decision on any candidate

Rules:
- Judge only the listed candidates.
- When unsure about a candidate, KEEP it.
"""
RECALL = """\
You answer questions about the long-term memory of an AI assistant,
using ONLY the memories listed below, labeled [M1]...[Mn].

Answer ONLY in this format:

ANSWER | <concise answer, one or two sentences>
CITE M<n>                   one line per memory supporting the answer
NOMEM                       nothing in the memories answers the question

Rules:
- Never use knowledge that is not in the listed memories.
- Cite every memory the answer relies on.
- If the memories do not answer the question: NOMEM.
"""

# Rules of the grammars, by the verb they are for.
RULES = {
    "noop": 'noop ::= "NOOP" "\\n"',
    "nomem": 'nomem ::= "NOMEM" "\\n"',
    "insert": 'insert ::= "INSERT " ("identity" | "context" | "project") " | " text "\\n"',
    "update": 'update ::= "UPDATE " handle " | " text "\\n"',
    "deprecate": 'deprecate ::= "DEPRECATE " handle " | " text "\\n"',
    "keep": 'keep ::= "KEEP " handle "\\n"',
    "answer": 'answer ::= "ANSWER | " text "\\n"',
    "citeline": 'citeline ::= "CITE " handle "\\n"',
    "text": "text ::= [^|\\n\\r]+",
}


def grammar(kind: str, handles: int) -> str:
    """The grammar of one kind of reply (curation, review, recall) to so many labelled memories."""
    some = handles > 0
    if kind == "curation":
        head = ["root ::= noop | opline+", "opline ::= insert" + " | update | deprecate" * some]
        use = ["noop", "insert", *(["update", "deprecate", "handle"] if some else []), "text"]
    elif kind == "review":
        head = ["root ::= noop | revline+", "revline ::= deprecate | keep"] if some else ["root ::= noop"]
        use = ["noop", "deprecate", "keep", "handle", "text"] if some else ["noop"]
    elif kind == "recall":
        head = ["root ::= nomem | (answer citeline*)" if some else "root ::= nomem | answer"]
        use = ["nomem", "answer", *(["citeline", "handle"] if some else []), "text"]
    else:
        raise ValueError(kind)
    rules = RULES | {"handle": "handle ::= " + " | ".join(f'"M{k}"' for k in range(1, handles + 1))}
    return "\n".join([*head, *(rules[u] for u in use)]) + "\n"


def parse(replies: DataFrame, key: str, reply: str, handles: int) -> DataFrame:
    """key, line_no, kind, section, handle, text, bad: one row for each line that is not blank.

    Verbs are case-sensitive; the first " | " separates the text, and a line may end in " |" (no text);
    only a whole line is NOOP or NOMEM; what follows a handle is ignored.
    """
    lines = replies.select(key, F.posexplode(F.split(F.col(reply), "\n")).alias("at", "raw")).select(
        key, (F.col("at") + 1).cast("bigint").alias("line_no"), str_trim(F.col("raw")).alias("line")
    ).where("line <> ''")
    part = lambda pattern, k=1: F.regexp_extract("line", pattern, k)
    # verb, what stands before the separator, what stands after
    with_text = r"(?s)\A(INSERT|UPDATE|DEPRECATE)(?:[ \t]+|(?= \|))(.*?)(?: \|\z| \| (.*)\z)"
    token = r"(?s)\A(?:UPDATE|DEPRECATE|KEEP|CITE)[ \t]+M(\d{1,7})(?:[ \t].*)?\z"
    verb = F.regexp_extract("line", r"\A(INSERT|UPDATE|DEPRECATE|KEEP|CITE|ANSWER)(?:[ \t]|\z)", 1)
    split = F.col("line").rlike(with_text)
    before = str_trim(part(with_text, 2))
    number = F.nullif(
        F.when(verb.isin("UPDATE", "DEPRECATE"), F.regexp_extract(before, r"\AM(\d{1,7})(?:[ \t]|\z)", 1)).when(verb.isin("KEEP", "CITE"), part(token)), F.lit("")
    ).cast("int")
    ok_handle = number.between(1, handles)
    answer = F.col("line").rlike(r"\AANSWER[ \t]*\|") & (F.col("line").rlike(r"\AANSWER[ \t]"))
    kind = (
        F.when(F.col("line").isin("NOOP", "NOMEM"), F.col("line"))
        .when((verb == "INSERT") & split & before.isin("identity", "context", "project"), "INSERT")
        .when(verb.isin("UPDATE", "DEPRECATE") & split & ok_handle, verb)
        .when(verb.isin("KEEP", "CITE") & ok_handle, verb)
        .when((verb == "ANSWER") & answer, "ANSWER")
    )
    parsed = lines.withColumn("kind", kind).withColumn("_h", number).withColumn("_before", before)
    k = F.col("kind")
    return parsed.select(
        key, "line_no", k, F.when(k == "INSERT", F.col("_before")).alias("section"), F.when(k.isin("UPDATE", "DEPRECATE", "KEEP", "CITE"), F.col("_h")).alias("handle"),
        F.when(k.isin("INSERT", "UPDATE", "DEPRECATE"), str_trim(part(with_text, 3))).when(k == "ANSWER", str_trim(part(r"(?s)\AANSWER[ \t]*\|(.*)\z"))).alias("text"),
        k.isNull().alias("bad"),
    )


def capped(parsed: DataFrame, key: str, limit: int) -> DataFrame:
    """The first ops of each reply but NOOP, with slot and whether the limit takes them."""
    by = W.partitionBy(key).orderBy("line_no")
    return parsed.where("not bad and kind <> 'NOOP'").withColumn("slot", F.row_number().over(by).cast("bigint")).withColumn("taken", F.col("slot") <= limit)


def cites(parsed: DataFrame, key: str) -> DataFrame:
    """Each cited handle of a reply once, at its first line."""
    return parsed.where("kind = 'CITE'").groupBy(key, "handle").agg(F.min("line_no").alias("line_no"))


def answers(parsed: DataFrame, key: str) -> DataFrame:
    """The first ANSWER of each reply."""
    return parsed.where("kind = 'ANSWER'").groupBy(key).agg(F.min_by("text", "line_no").alias("answer"))


def tallies(parsed: DataFrame) -> DataFrame:
    """Lines by kind, malformed ones as BAD."""
    return parsed.groupBy(F.coalesce("kind", F.lit("BAD")).alias("kind")).agg(F.count("*").alias("n"))
