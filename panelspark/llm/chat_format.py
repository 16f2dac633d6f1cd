"""Conversations as training text: a compiled template writes each one, and its generation marks say what to learn.

Turns are shuffled once by conversation and sorted there; a worker reads the sorted rows as a stream and holds one
conversation at a time. TEMPLATE opens a turn by "### role:" and closes it by "</turn>", each on a line of its own. Within a text,
`escape` puts a backslash before either of these strings and doubles the backslashes that stand before it, so that a reader finds
only the template's own marks and `unescape` gives back any text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.chat_template import compile_template, text_of
from panelspark.llm.common import bound_batches

TEMPLATE = """\
{%- for m in messages -%}
{{ '### ' ~ m.role | escape_name ~ ':\\n' }}
{%- if m.role == 'assistant' -%}
{%- generation -%}{{ m.text | escape }}{%- endgeneration -%}
{%- else -%}
{{ m.text | escape }}
{%- endif -%}
{{ '\\n</turn>\\n' }}
{%- endfor -%}"""
CONTROL = re.compile(r"(\\*)(### |</turn>)")
ESCAPED = re.compile(r"(\\+)(### |</turn>)")
TURN = re.compile(r"### ((?:[^\\:\n]|\\.)*):\n(.*?)\n</turn>\n", re.S)
NAME = re.compile(r"[\\:\n]")


def escape(text) -> str:
    """The text with no control string that isn't behind an odd number of backslashes."""
    return CONTROL.sub(r"\1\1\\\2", text_of(text))


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: m[1][:len(m[1]) // 2] + m[2], text)


def escape_name(name) -> str:
    """A role on one line, without a colon of its own."""
    return NAME.sub(lambda m: "\\n" if m[0] == "\n" else "\\" + m[0], text_of(name))


def unescape_name(name: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], name, flags=re.S)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape_name(m[1]), unescape(m[2])))
        at = m.end()
    return out


def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[dict]]]:
    """(id, messages) from rows that are sorted by conversation; a conversation may cross batches."""
    now, messages = None, []
    for batch in batches:
        for key, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
            if messages and key != now:
                yield now, messages
                messages = []
            now = key
            messages.append({"role": role, "text": text})
    if messages:
        yield now, messages


def _packed(rows: Iterator[tuple], schema: pa.Schema, most: int = 256, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows (their second value is a text) as batches of bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1])
        if len(held) == most or size > most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


SPANS = "array<struct<start: bigint, stop: bigint>>"
ARROW = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string()}
ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _key_type(df: DataFrame) -> tuple[str, pa.DataType]:
    kind = df.schema["conv_id"].dataType.simpleString()
    if kind not in ARROW:
        raise ValueError(f"a conversation's id is a whole number or a string, not {kind}")
    return kind, ARROW[kind]


def render(turns: DataFrame, template: str = TEMPLATE, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """conv_id, formatted, loss: one row for each conversation; `loss` has the spans (code points) under generation marks.

    Turns go by number, a null number first, equal numbers by role and text; rows that repeat are turns of their own. A null role or
    text counts as empty. Rows with a null id are one conversation. Other columns are not read; no rows give none. A conversation is one
    row of the result, so it has to fit into a worker, but no more than one does.
    """
    bound_batches(turns.sparkSession)
    rows = turns.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"),
                        *[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(a) for c, a in ((role_col, "role"), (text_col, "text"))])
    kind, arrow = _key_type(rows)
    schema = pa.schema([("conv_id", arrow), ("formatted", pa.string()), ("loss", ARROW_SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        write = compile_template(template, escape=escape, escape_name=escape_name)

        def written():
            for key, messages in conversations(batches):
                text, spans = write({"messages": messages})
                yield key, text, [{"start": a, "stop": b} for a, b in spans]
        return _packed(written(), schema)

    together = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return together.mapInArrow(run, f"conv_id {kind}, formatted string, loss {SPANS}")


def read_back(rendered: DataFrame) -> DataFrame:
    """conv_id, turns (role and text, a line each), n_turns, loss_text, n_chars, all read from `formatted` and `loss` alone."""
    kind, arrow = _key_type(rendered)
    schema = pa.schema([("conv_id", arrow), ("turns", pa.string()), ("n_turns", pa.int64()), ("loss_text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read():
            for batch in batches:
                for key, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss"))):
                    turns = read_turns(text)
                    loss = "".join(unescape(text[s["start"]:s["stop"]]) for s in spans)
                    yield key, "".join(f"{role}\n{said}\n" for role, said in turns), len(turns), loss, len(text)
        return _packed(read(), schema)

    return rendered.select("conv_id", "formatted", "loss").mapInArrow(
        run, f"conv_id {kind}, turns string, n_turns bigint, loss_text string, n_chars bigint")


def digests(read: DataFrame) -> DataFrame:
    return read.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
                       F.sha2("loss_text", 256).alias("loss_sha256"), F.col("n_chars").alias("formatted_chars"))
