"""Chat formatting with typed content parts.

A visitor walks the parts of a turn (text, image, audio, document) and writes text with its control
strings escaped and every other part as a placeholder of its expanded token count; attachment
references are recorded in order. Turns are written one after another in the order of the
conversation, so a conversation of any length is formatted as a stream.

``turns`` read back from a formatted chunk equal what was written.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from laneflow.llm import shared
from laneflow.llm.shared import F

#: Strings that mark turns and attachments here or in common chat templates.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
OPEN, ROLE_END, CLOSE = "<|turn|>", "<|text|>", "<|end|>\n"
#: Tokens that stand for one attachment where the part doesn't say: by kind.
TOKENS = {"image": 256, "audio": 128, "document": 512}

ESCAPE = re.compile("|".join(f"{re.escape(c[:-1])}(?=\\\\*{re.escape(c[-1])})" for c in CONTROL))
UNESCAPE = re.compile("|".join(f"{re.escape(c[:-1])}\\\\(?=\\\\*{re.escape(c[-1])})" for c in CONTROL))
TURN = re.compile(
    f"{re.escape(OPEN)}(.*?){re.escape(ROLE_END)}(.*?){re.escape(CLOSE)}", re.DOTALL
)
PLACE = re.compile(r"<\|(image|audio|document):(\d+):(\d+)\|>")


def escape(text: str) -> str:
    """Put a backslash before the last character of every control string, and before one more in
    those that have some already; ``unescape`` takes one away."""
    return ESCAPE.sub(lambda m: m.group() + "\\", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(lambda m: m.group()[:-1], text)


@dataclass
class Written:
    """What a visitor has written of one turn."""

    pieces: list[str] = field(default_factory=list)
    attachments: list[tuple[str, str, int]] = field(default_factory=list)
    tokens: int = 0


class Visitor:
    """Writes the parts of a turn in order. Attachments are numbered through the conversation."""

    def __init__(self, first: int = 0, tokens: dict[str, int] | None = None):
        self.first, self.tokens = first, TOKENS | (tokens or {})

    def visit(self, parts) -> Written:
        out = Written()
        for part in parts:
            kind = part.get("type") or "text"
            if kind == "text":
                out.pieces.append(escape(part.get("text") or ""))
            elif kind in self.tokens:
                self._attachment(kind, part, out)
            else:
                raise ValueError(f"unknown part type {kind!r}")
        return out

    def _attachment(self, kind: str, part: dict, out: Written) -> None:
        tokens = int(part.get("tokens") or self.tokens[kind])
        out.pieces.append(f"<|{kind}:{self.first + len(out.attachments)}:{tokens}|>")
        out.attachments.append((kind, part.get("ref") or "", tokens))
        out.tokens += tokens


def parts_of(text: str | None, typed: bool) -> list[dict]:
    """Typed parts of a turn: a JSON array where ``typed``, else one text part."""
    if typed and text:
        told = json.loads(text)
        return told if isinstance(told, list) else [{"type": "text", "text": str(told)}]
    return [{"type": "text", "text": text or ""}]


def write_turn(role: str, written: Written) -> str:
    return f"{OPEN}{escape(role)}{ROLE_END}{''.join(written.pieces)}{CLOSE}"


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """Role and text of every turn, unescaped; placeholders stay in the text."""
    end = 0
    for m in TURN.finditer(formatted):
        if m.start() != end:
            raise ValueError(f"no turn begins at {end}")
        yield unescape(m.group(1)), unescape(m.group(2))
        end = m.end()
    if end != len(formatted):
        raise ValueError(f"no turn begins at {end}")


def ordered(rows: DataFrame) -> DataFrame:
    """Rows of a conversation together and in order: by turn, then role, then text; nulls first.

    The order inside a conversation makes one stream of it, which one task reads with constant
    memory; only the digest of the whole conversation is kept, never its rows.
    """
    return (
        rows.select(
            F.col("conv_id").cast("long").alias("conv_id"),
            F.col("turn").cast("long").alias("turn"),
            F.col("role").cast("string").alias("role"),
            F.col("text").cast("string").alias("text"),
        )
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )


def format_turns(rows: DataFrame, typed: bool = False) -> DataFrame:
    """``conv_id, place, role, formatted, attachments, tokens`` for each turn.

    The formatted conversation is the ``formatted`` of its turns by ``place``. Null role and text
    are empty, null conversation ids form one conversation. Repeated rows are turns of their own.
    ``text`` is plain, or a JSON array of parts ``{type, text | ref, tokens}`` where ``typed``.
    """
    schema = (
        "conv_id long, place long, role string, formatted string, "
        "attachments array<struct<kind: string, ref: string, tokens: long>>, tokens long"
    )
    return ordered(rows).mapInArrow(lambda batches: formatted(batches, typed), schema)


def formatted(batches: Iterator[pa.RecordBatch], typed: bool) -> Iterator[pa.RecordBatch]:
    current, place, numbered = object(), 0, 0
    for batch in batches:
        for part in shared.parts(batch):
            out = []
            for row in part.to_pylist():
                if row["conv_id"] != current:
                    current, place, numbered = row["conv_id"], 0, 0
                written = Visitor(numbered).visit(parts_of(row["text"], typed))
                role = row["role"] or ""
                out.append((current, place, role, write_turn(role, written), written.attachments, written.tokens))
                place, numbered = place + 1, numbered + len(written.attachments)
            columns = list(zip(*out, strict=True))
            kinds = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))
            found = [[dict(zip(("kind", "ref", "tokens"), a, strict=True)) for a in x] for x in columns[4]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(columns[0], pa.int64()),
                    pa.array(columns[1], pa.int64()),
                    pa.array(columns[2], pa.string()),
                    pa.array(columns[3], pa.string()),
                    pa.array(found, kinds),
                    pa.array(columns[5], pa.int64()),
                ],
                ["conv_id", "place", "role", "formatted", "attachments", "tokens"],
            )


class Digest:
    """What is read back of one conversation, turn by turn."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.chars, self.loss_chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str) -> None:
        self.chars += len(formatted)
        for role, text in read_turns(formatted):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
            if role == "assistant":
                self.loss_chars += len(text)
                self.loss.update(text.encode())

    def row(self) -> tuple:
        return (
            self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars
        )


def digests(rows: DataFrame, typed: bool = False) -> DataFrame:
    """One row per conversation, read back from its formatted turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_one: Digest | None = None
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def table(done: list[tuple]) -> pa.RecordBatch:
            columns = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in formatted(batches, typed):
            done = []
            for conv_id, text in zip(
                batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist(), strict=True
            ):
                if open_one is None or open_one.conv_id != conv_id:
                    if open_one:
                        done.append(open_one.row())
                    open_one = Digest(conv_id)
                open_one.add(text)
            if done:
                yield table(done)
        if open_one:
            yield table([open_one.row()])

    schema = (
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
    return ordered(rows).mapInArrow(run, schema)


#: Fixed value: the conversation that the query adds, in which every text is a control string.
ADDED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the added one, formatted and read back."""
    rows = shared.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame(ADDED, "conv_id long, turn long, role string, text string")
    return digests(rows.unionByName(added))


def _escapes(column: str) -> str:
    patterns = (re.sub(r"([|\[\]])", r"\\\1", c[:-1]) + r"\\*" + re.sub(r"([|\[\]])", r"\\\1", c[-1]) for c in CONTROL)
    return " + ".join(f"len(regexp_extract_all({column}, '{p}'))" for p in patterns)


SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES {", ".join(f"({c}, {t}, '{r}', '{x}')" for c, t, r, x in ADDED)}
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(OPEN + ROLE_END + CLOSE)} + length(role) + length(text) + {_escapes("role")} + {_escapes("text")})::BIGINT
    AS formatted_chars
FROM t GROUP BY conv_id
"""
