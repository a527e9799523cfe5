"""Chat formatting with typed content parts.

A turn holds a list of parts: text, image, audio or document. A visitor flattens them in order; text is escaped, each
attachment becomes a placeholder <|kind:n|>, where n counts the attachments of the conversation from 0, and its reference,
turn (counted from 0 in the output) and expanded token count are recorded. Parts of another type become <|unknown:n|> with
their type as reference and no tokens. The template writes each turn as

    <s>role LF text </s>

and texts escape its control signs reversibly: a backslash becomes two, < becomes <\\ and [ becomes [\\, so that no text
can hold <s>, </s>, <|, [INST] or [/INST]. In roles a line feed is written as backslash n. The loss mask covers the texts
of assistant turns, placeholders included, as code-point spans of the output.

A conversation is one row of output, so its turns come together in one task; turns without conv_id belong to none, and each
is a conversation of its own, formatted without a shuffle. Nulls: a null text, role or list of parts counts as empty, turns
without number come first. Turns of equal number go by role, then parts; repeated rows are turns of their own. Very long
texts are not cut. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlight.llm.tables import read, small_batches

PART = T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("width", T.LongType()), T.StructField("height", T.LongType()), T.StructField("seconds", T.DoubleType()), T.StructField("pages", T.LongType())])
PARTS = T.ArrayType(PART)
ATTACHMENT = T.StructType([T.StructField("kind", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("placeholder", T.StringType()), T.StructField("turn", T.LongType()), T.StructField("tokens", T.LongType())])

#: Tokens that attachments expand to: an image has one a square of PATCH pixels, audio so many a second, a document so many a page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 14, 25, 800


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "<\\").replace("[", "[\\")


def unescaped(text: str) -> str:
    return re.sub(r"([<\[])\\|\\\\", lambda m: m[1] or "\\", text)


def escaped_role(role: str) -> str:
    return escaped(role).replace("\n", "\\n")


def unescaped_role(role: str) -> str:
    return re.sub(r"([<\[])\\|\\(n|\\)", lambda m: m[1] or ("\n" if m[2] == "n" else "\\"), role)


class Visitor:
    """Flattens the parts of a conversation's turns, one turn after the other."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.turn = 0
        self.attachments: list[dict] = []

    def body(self, parts) -> str:
        """The flattened text of the next turn."""
        self.out = []
        for part in parts if parts is not None else ():
            if part is not None:
                getattr(self, f"visit_{part['type'] or 'text'}", self.visit_unknown)(part)
        self.turn += 1
        return "".join(self.out)

    def visit_text(self, part) -> None:
        self.out.append(escaped(part["text"] or ""))

    def attach(self, kind: str, ref: str | None, tokens: int) -> None:
        placeholder = f"<|{kind}:{len(self.attachments)}|>"
        self.out.append(placeholder)
        self.attachments.append({"kind": kind, "ref": ref or "", "placeholder": placeholder, "turn": self.turn, "tokens": tokens})

    def visit_image(self, part) -> None:
        self.attach("image", part["ref"], math.ceil(number(part["width"]) / PATCH) * math.ceil(number(part["height"]) / PATCH))

    def visit_audio(self, part) -> None:
        self.attach("audio", part["ref"], math.ceil(number(part["seconds"]) * AUDIO_RATE))

    def visit_document(self, part) -> None:
        self.attach("document", part["ref"], int(number(part["pages"])) * PAGE_TOKENS)

    def visit_unknown(self, part) -> None:
        self.attach("unknown", part["type"], 0)


def number(x) -> float:
    """A size; one that is missing, negative or no number counts as 0."""
    return float(x) if x is not None and 0 < x < math.inf else 0.0


def written(turns) -> tuple[str, list[int], list[dict]]:
    """The formatted conversation, the flat list of loss spans, and the attachments in order."""
    out, spans, at, visitor = [], [], 0, Visitor()
    for turn in turns:
        body = visitor.body(turn["parts"])
        head = f"<s>{escaped_role(turn['role'])}\n"
        if turn["role"] == "assistant":
            spans += [at + len(head), at + len(head) + len(body)]
        out += [head, body, "</s>"]
        at += len(head) + len(body) + 4
    return "".join(out), spans, visitor.attachments


def _formatted(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in rows:
        done = [written(turns) for turns in pdf["turns"]]
        yield pd.DataFrame({"conv_id": pdf["conv_id"], "formatted": [x for x, _, _ in done], "loss_spans": [s for _, s, _ in done], "attachments": [a for _, _, a in done], "attachment_tokens": [sum(x["tokens"] for x in a) for _, _, a in done]})


def formatted(turns: DataFrame) -> DataFrame:
    """turns: conv_id, turn, role, parts. A row for each conversation: conv_id, formatted, loss_spans (start and end in turn),
    attachments in order, and attachment_tokens, what they expand to in all."""
    small_batches(turns.sparkSession)
    each = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), "parts").alias("said"))
    grouped = each.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("turns"))
    alone = each.where("conv_id IS NULL").select("conv_id", F.array("said").alias("turns"))
    schema = T.StructType([T.StructField("conv_id", turns.schema["conv_id"].dataType), T.StructField("formatted", T.StringType()), T.StructField("loss_spans", T.ArrayType(T.LongType())), T.StructField("attachments", T.ArrayType(ATTACHMENT)), T.StructField("attachment_tokens", T.LongType())])
    return grouped.unionByName(alone).mapInPandas(_formatted, schema)


def parsed(output: str) -> list[tuple[str, str]]:
    """The roles and texts of a formatted conversation; placeholders stay as they are."""
    out = []
    for turn in output.split("</s>")[:-1]:
        role, _, body = turn.removeprefix("<s>").partition("\n")
        out.append((unescaped_role(role), unescaped(body)))
    return out


DIGESTS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "attachment_tokens"]


def _digests(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in rows:
        out = []
        for conv, text, spans, attached, tokens in zip(pdf["conv_id"], pdf["formatted"], pdf["loss_spans"], pdf["attachments"], pdf["attachment_tokens"], strict=True):
            turns = parsed(text)
            loss = "".join(unescaped(text[a:b]) for a, b in zip(spans[::2], spans[1::2], strict=True))
            said = "".join(f"{role}\n{body}\n" for role, body in turns)
            out.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text), len(attached), tokens))
        yield pd.DataFrame(out, columns=DIGESTS).astype({"conv_id": "Int64"})


def as_parts(rows: DataFrame) -> DataFrame:
    """Rows of conv_id, turn, role, text as turns of one text part."""
    part = F.struct(F.lit("text").alias("type"), "text", *[F.lit(None).cast(f.dataType).alias(f.name) for f in PART.fields[2:]])
    return rows.select("conv_id", "turn", "role", F.array(part).alias("parts"))


def op8_chat_formatting(spark, sf_dir):
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(own)
    return formatted(as_parts(rows)).mapInPandas(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, attachment_tokens long")


OP8_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]', NULL), (-7, 1, 'assistant', '</s>[INST] ok [/INST]', NULL)),
e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '<', '<\'), '[', '[\') AS body,
  replace(replace(replace(replace(role, '\', '\\'), '<', '<\'), '[', '[\'), chr(10), '\n') AS head FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(head) + length(body) + 8)::BIGINT AS formatted_chars, 0::BIGINT AS n_attachments, 0::BIGINT AS attachment_tokens
FROM e GROUP BY conv_id, alone
"""
