"""Chat formatting with typed content parts, in DataFrame functions only.

A turn's content is an array of parts: text, image, audio or document. A
visitor turns each part into text: a text part is escaped, any other part
becomes a placeholder, numbered in the order of the conversation. Attachments
are listed with their references and the number of tokens each placeholder
stands for. Turns are marked with control strings; every character that could
begin one is escaped in roles and texts, so the output can be read back whole.

Rows of a conversation are ordered by turn, then role, then content (null
first), so ties have a defined order; repeated rows are turns of their own.
Null text is empty text, a null role is an empty role, a null conversation id
is a conversation. An empty table gives an empty result. A conversation is one
output string, so it is held by one task as its reader must; nothing else is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Control strings of the template.
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
PLACEHOLDER = "<|{kind}:{n}|>"
# What is escaped in texts, in this order, and undone in reverse.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
#: Tokens that a placeholder of each kind expands to, unless the part says so.
PART_TOKENS = {"image": 576, "audio": 750, "document": 1024}
#: Roles under the loss mask.
LOSS_ROLES = ("assistant",)
PART_TYPE = "struct<kind:string,text:string,ref:string,tokens:int>"
PROBE_ID = -7
PROBE_TEXT = "</s>[INST] ok [/INST]"


def escape(c: Column) -> Column:
    for a, b in ESCAPES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column) -> Column:
    for a, b in reversed(ESCAPES):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def text_part(text: Column) -> Column:
    """A content of one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"),
                            F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("tokens")))


def _tokens(p: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in PART_TOKENS.items() for x in kv))
    return F.coalesce(p["tokens"], known[p["kind"]], F.lit(0))


def _is_text(p: Column) -> Column:
    return F.coalesce(p["kind"], F.lit("text")) == "text"


def format_chat(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                content: str = "content") -> DataFrame:
    """One row a conversation: ``conv``, ``formatted`` (string), ``loss_spans``
    (array of (start, length) in code points of ``formatted``) and
    ``attachments`` (array of (n, turn, kind, ref, tokens)), ``expanded_tokens``.

    ``content`` is an array of PART_TYPE; a null kind is text."""
    parts = F.coalesce(F.col(content), F.array().cast(f"array<{PART_TYPE}>"))
    # placeholders get their number once the conversation is in order
    slim = rows.select(
        F.col(conv).alias("_conv"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                 F.transform(parts, lambda p: F.struct(
                     F.when(_is_text(p), F.lit("text")).otherwise(p["kind"]).alias("kind"),
                     F.when(_is_text(p), F.coalesce(p["text"], F.lit(""))).alias("text"),
                     p["ref"].alias("ref"), _tokens(p).alias("tokens"))).alias("parts")).alias("_t"))
    conv_rows = slim.groupBy("_conv").agg(F.array_sort(F.collect_list("_t")).alias("_t"))
    others = lambda t: F.filter(t["parts"], lambda p: p["kind"] != "text")
    refs = F.flatten(F.transform("_t", lambda t: F.transform(others(t), lambda p: F.struct(
        t["turn"].alias("turn"), p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens")))))
    counts = F.transform("_t", lambda t: F.size(others(t)))
    conv_rows = conv_rows.withColumn("_refs", refs).withColumn("_counts", counts)

    def body(t: Column, i: Column) -> Column:
        before = F.aggregate(F.slice("_counts", F.lit(1), i), F.lit(0), lambda a, x: a + x)
        numbered = F.transform(t["parts"], lambda p, k: F.when(p["kind"] == "text", escape(p["text"])).otherwise(
            F.format_string(PLACEHOLDER.replace("{kind}", "%s").replace("{n}", "%d"), escape(p["kind"]),
                            before + F.size(F.filter(F.slice(t["parts"], F.lit(1), k), lambda x: x["kind"] != "text")))))
        return F.array_join(numbered, "")

    # all-text turns, by far the most, need no numbering
    plain = lambda t: F.array_join(F.transform(t["parts"], lambda p: escape(p["text"])), "")
    pieces = F.transform("_t", lambda t, i: F.struct(
        F.concat(F.lit(TURN), escape(t["role"]), F.lit(BODY)).alias("head"),
        F.when(F.size("_refs") == 0, plain(t)).otherwise(body(t, i)).alias("body"),
        t["role"].isin(*LOSS_ROLES).alias("loss")))
    conv_rows = conv_rows.withColumn("_p", pieces)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(a: Column, p: Column) -> Column:
        here = a["at"] + F.length(p["head"])
        span = F.array(F.struct(here.alias("start"), F.length(p["body"]).alias("length")))
        return F.struct((here + F.length(p["body"]) + F.lit(len(END))).alias("at"),
                        F.when(p["loss"], F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))
    formatted = F.array_join(F.transform("_p", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    return conv_rows.select(
        F.col("_conv").alias(conv), formatted.alias("formatted"),
        F.aggregate("_p", start, step)["spans"].alias("loss_spans"),
        F.transform("_refs", lambda r, i: F.struct(
            i.alias("n"), r["turn"].alias("turn"), r["kind"].alias("kind"), r["ref"].alias("ref"),
            r["tokens"].alias("tokens"))).alias("attachments"),
        F.aggregate("_refs", F.lit(0).cast("long"), lambda a, r: a + r["tokens"]).alias("expanded_tokens"))


def read_back(formatted: Column) -> Column:
    """Array of (role, text) of a formatted conversation; placeholders stay."""
    turns = F.filter(F.split(formatted, F.lit(_literal(TURN))), lambda x: x != "")
    cut = F.transform(turns, lambda x: F.split(F.substring(x, F.lit(1), F.length(x) - len(END)), F.lit(_literal(BODY))))
    return F.transform(cut, lambda x: F.struct(unescape(x[0]).alias("role"), unescape(x[1]).alias("text")))


def _literal(s: str) -> str:
    return "\\Q" + s + "\\E"


def loss_text(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(
        F.substring(formatted, s["start"] + 1, s["length"]))), "")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE_TEXT).alias("text"))
    rows = rows.unionByName(probe).withColumn("content", text_part(F.col("text")))
    out = format_chat(rows).withColumn("_turns", read_back(F.col("formatted"))).withColumn(
        "_loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    whole = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def _sql() -> str:
    esc = lambda x: f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')"
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {PROBE_ID}, 0, 'user', '{PROBE_TEXT}'
  UNION ALL SELECT {PROBE_ID}, 1, 'assistant', '{PROBE_TEXT}')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), ''))
    AS loss_sha256,
  sum(length({esc('role')}) + length({esc('text')}) + {len(TURN + BODY + END)})::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""


OP2_SQL = _sql()
