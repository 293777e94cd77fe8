"""Chat formatting of typed content parts, with a loss mask and a reversible escape.

A turn becomes ``<s>role\\nbody</s>``. Texts may contain anything: inside them every control string gets
one more backslash after its first character, and reading takes it away again. A visitor turns parts
into the body: texts escaped, image, audio and document parts as one placeholder each, with the
reference and the number of tokens the placeholder expands to.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: The control strings are one of the openers followed by one of these.
RESTS = "/?s>|br>|image>|audio>|document>|/?INST\\]"
OPEN, CLOSE, LINE = "<s>", "</s>", "<br>"
MEDIA = ("image", "audio", "document")
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


@dataclass(frozen=True)
class Expansion:
    """Tokens that placeholders stand for."""

    image_patch: int = 28
    audio_tokens_per_second: float = 12.5
    tokens_per_page: int = 256


def escape(text: Column) -> Column:
    return F.regexp_replace(text, f"([<\\[])(\\\\*)({RESTS})", "$1\\\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, f"([<\\[])\\\\(\\\\*)({RESTS})", "$1$2$3")


def text_part(text: Column) -> Column:
    """A text as a typed part."""
    none = F.lit(None)
    fields = {"type": F.lit("text"), "text": text} | {n: none.cast(t) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))}
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def _cost(part: Column, rates: Expansion) -> Column:
    patches = F.ceil(F.coalesce(part["width"], F.lit(0)) / rates.image_patch) * F.ceil(F.coalesce(part["height"], F.lit(0)) / rates.image_patch)
    return (
        F.when(part["type"] == "image", patches)
        .when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * rates.audio_tokens_per_second))
        .when(part["type"] == "document", F.coalesce(part["pages"], F.lit(0)) * rates.tokens_per_page)
        .otherwise(F.lit(0))
        .cast("long")
    )


def _is_media(part: Column) -> Column:
    return F.coalesce(part["type"].isin(*MEDIA), F.lit(False))


def _visited(parts: Column) -> Column:
    """Body of a turn: the visitor keeps finished output and the run of text it is in, which is escaped as a whole.

    Neighbouring texts are one run, so that no control string can come about where two of them meet.
    """
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("run"))

    def visit(state: Column, part: Column) -> Column:
        placed = F.struct(F.concat(state["done"], escape(state["run"]), F.lit("<"), part["type"], F.lit(">")).alias("done"), F.lit("").alias("run"))
        longer = F.struct(state["done"].alias("done"), F.concat(state["run"], F.coalesce(part["text"], F.lit(""))).alias("run"))
        return F.when(_is_media(part), placed).otherwise(longer)

    return F.aggregate(parts, start, visit, lambda state: F.concat(state["done"], escape(state["run"])))


def format_chat(turns: DataFrame, rates: Expansion = Expansion()) -> DataFrame:
    """One row per turn: conv_id, turn, formatted, loss_start, loss_chars, attachments, expanded_tokens.

    ``turns`` has conv_id, turn, role and text, or parts instead of (or after) text; the text is a text part, and all parts
    go through the visitor. A null text, role, part or part list is empty. A part of unknown type counts as text. The conversation is the concatenation of
    ``formatted`` ordered by turn (nulls first), role and text. The loss mask covers assistant bodies;
    offsets are code points within the row. attachments lists ref, type, the placeholder's number and its tokens.
    """
    parts = F.array().cast(PARTS)
    if "text" in turns.columns:
        parts = F.array(text_part(F.col("text").cast("string"))).cast(PARTS)
    if "parts" in turns.columns:
        parts = F.concat(parts, F.coalesce(F.col("parts").cast(PARTS), F.array().cast(PARTS)))
    role = F.regexp_replace(escape(F.coalesce(F.col("role").cast("string"), F.lit(""))), "\n", LINE)
    media = F.filter(parts, _is_media)
    attachments = F.transform(
        media, lambda p, i: F.struct(p["ref"].alias("ref"), p["type"].alias("type"), i.alias("number"), _cost(p, rates).alias("tokens"))
    )
    heads = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.concat(F.lit(OPEN), role, F.lit("\n")).alias("head"),
        _visited(parts).alias("body"),
        attachments.alias("attachments"),
        (F.col("role") == "assistant").alias("learn"),
    )
    return heads.select(
        "conv_id",
        "turn",
        F.concat("head", "body", F.lit(CLOSE)).alias("formatted"),
        F.length("head").alias("loss_start"),
        F.when(F.col("learn"), F.length("body")).otherwise(F.lit(0)).alias("loss_chars"),
        "attachments",
        F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"),
    )


def read_chat(formatted: DataFrame) -> DataFrame:
    """Back from formatted turns: conv_id, turn, role, text, loss_text, formatted_chars. Placeholders stay in the text."""
    whole = F.substring("formatted", F.lit(len(OPEN) + 1), F.length("formatted") - len(OPEN) - len(CLOSE))
    split = F.instr("whole", "\n")
    return (
        formatted.withColumn("whole", whole)
        .withColumn("split", split)
        .select(
            "conv_id",
            "turn",
            unescape(F.regexp_replace(F.substring("whole", F.lit(1), F.col("split") - 1), LINE, "\n")).alias("role"),
            unescape(F.substring("whole", F.col("split") + 1, F.length("whole"))).alias("text"),
            unescape(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_chars"))).alias("loss_text"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )


def read_parts(formatted: DataFrame) -> DataFrame:
    """Back from formatted turns to their parts: conv_id, turn, parts (type, text, ref, tokens) in order.

    Placeholders are told from the same letters inside texts, where a backslash keeps them apart; the n-th placeholder is
    the n-th attachment. Texts between placeholders come back whole, empty ones are left out.
    """
    whole = F.substring("formatted", F.lit(len(OPEN) + 1), F.length("formatted") - len(OPEN) - len(CLOSE))
    body = F.expr("substring(whole, instr(whole, '\n') + 1)")
    texts = F.transform(F.split(body, f"<({'|'.join(MEDIA)})>", -1), unescape)
    place = F.struct(F.lit("text").alias("type"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("tokens"))

    def around(text: Column, i: Column) -> Column:
        own = F.array(place.withField("text", text))
        media = F.transform(
            F.filter("attachments", lambda a: a["number"] == i),
            lambda a: F.struct(a["type"].alias("type"), F.lit(None).cast("string").alias("text"), a["ref"].alias("ref"), a["tokens"].alias("tokens")),
        )
        return F.concat(own, media)

    parts = F.filter(F.flatten(F.transform(texts, around)), lambda p: (p["type"] != "text") | (p["text"] != ""))
    return formatted.withColumn("whole", whole).select("conv_id", "turn", parts.cast("array<struct<type:string,text:string,ref:string,tokens:bigint>>").alias("parts"))


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation: running hashes, so a long conversation is never held."""
    key: object = _digests  # no conversation yet
    state: list = []
    done: list[tuple] = []

    def close() -> None:
        if state:
            done.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

    def rows() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = [c.split()[0] for c in DIGEST.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names)

    for batch in batches:
        for conv, role, text, loss, chars in zip(
            *(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "loss_text", "formatted_chars")), strict=True
        ):
            if conv != key or not state:
                close()
                key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            state[2] += len(loss)
            state[3].update(loss.encode())
            state[4] += chars
        if done:
            yield rows()
            done = []
    close()
    if done:
        yield rows()


def conversation_digests(read: DataFrame) -> DataFrame:
    """Per conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. A null conv_id is one conversation."""
    ordered = read.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(_digests, DIGEST)


CHAT_SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss,
         regexp_replace(text, '([<\\[])(\\\\*)(/?s>|br>|image>|audio>|document>|/?INST\\])', '\\1\\\\\\2\\3', 'g') AS body,
         replace(regexp_replace(role, '([<\\[])(\\\\*)(/?s>|br>|image>|audio>|document>|/?INST\\])', '\\1\\\\\\2\\3', 'g'), chr(10), '<br>') AS head
  FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       sum(length(loss))::BIGINT AS loss_chars,
       sha256(string_agg(loss, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
       sum(length(head) + length(body) + 8)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
