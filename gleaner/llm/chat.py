"""Chat formatting: every assistant turn becomes an example of its own.

An example is one text: all turns before, then the assistant's. Only its reply, ``loss_start`` to ``loss_end`` in characters, is trained
on. A turn is written ``<turn ROLE>``, a line end, its text, ``</turn>`` and a line end. In texts a backslash goes before every backslash and
before every ``<turn`` and ``</turn``, in roles before every backslash, ``<`` and ``>``; so a mark never occurs inside a text, and
:func:`turns_of` gives back what was written. A conversation that doesn't end with the assistant's turn has one more example, of all its
turns and with nothing to train on, so that no turn is lost.

Turns are dealt by conversation and sorted, on disk where needed; a task holds one conversation's text so far, which is what an example
is, and gives examples out a few MB at a time. The examples of a conversation of n turns hold about n^2 / 2 turns of text: that is the
method, and one task makes them.

Rows go by turn, null first, then by role and text: repeated turns all stay. Null text and role are read as empty. Rows without an id
make one conversation, whose id is null. Other columns are ignored. Empty texts are turns too; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXAMPLE = "conv_id long, example int, text string, loss_start long, loss_end long"
#: Characters of examples that a batch has about.
BATCH = 1 << 21

_MARK = re.compile(r"\\|<(?=/?turn)")
_ROLE_MARK = re.compile(r"[\\<>]")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<turn ([^\\>]*(?:\\.[^\\>]*)*)>\n([^\\<]*(?:(?:\\.|<(?!/?turn))[^\\<]*)*)</turn>\n", re.S)


def escaped(text: str) -> str:
    return _MARK.sub(r"\\\g<0>", text) if "\\" in text or "<" in text else text


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def opened(role: str) -> str:
    return "<turn " + _ROLE_MARK.sub(r"\\\g<0>", role) + ">\n"


CLOSED = "</turn>\n"


def turns_of(text: str) -> list[tuple[str, str]]:
    """Roles and texts of an example's turns."""
    turns, at = [], 0
    while at < len(text):
        found = _TURN.match(text, at)
        if not found:
            raise ValueError(f"no turn at character {at}")
        turns.append((unescaped(found[1]), unescaped(found[2])))
        at = found.end()
    return turns


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], size=lambda row: 64) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += size(row)
        if weight >= BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)


def _expand(target: str):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        conv, so_far, n, open_end = (), "", 0, False  # no id equals ()
        for batch in batches:
            for key, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if conv != (key,):
                    if open_end:
                        yield conv[0], n, so_far, None, None
                    conv, so_far, n = (key,), "", 0
                head, body = opened(role), escaped(text)
                start = len(so_far) + len(head)
                so_far = "".join((so_far, head, body, CLOSED))
                open_end = role != target
                if not open_end:
                    yield key, n, so_far, start, start + len(body)
                    n += 1
        if open_end:
            yield conv[0], n, so_far, None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(
            each(batches), ["conv_id", "example", "text", "loss_start", "loss_end"],
            [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()], lambda row: len(row[2]),
        )

    return run


def examples(
    conversations: DataFrame, target: str = "assistant", conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """``conv_id, example, text, loss_start, loss_end``; a conversation's examples lie one after the other, in order, in one partition."""
    told = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    rows = conversations.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), told(role_col, "role"),
        told(text_col, "text"),
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_expand(target), EXAMPLE)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def of(conv, last: str, loss, loss_chars: int, chars: int) -> tuple:
        turns, told = turns_of(last), hashlib.sha256()
        for role, text in turns:
            told.update(f"{role}\n{text}\n".encode())
        return conv, len(turns), told.hexdigest(), loss_chars, loss.hexdigest(), chars

    def each() -> Iterator[tuple]:
        conv, last, loss, loss_chars, chars, due = (), "", hashlib.sha256(), 0, 0, 0
        for batch in batches:
            for key, n, text, start, end in zip(
                *(batch.column(c).to_pylist() for c in ("conv_id", "example", "text", "loss_start", "loss_end"))
            ):
                if conv != (key,):
                    if conv:
                        yield of(conv[0], last, loss, loss_chars, chars)
                    conv, loss, loss_chars, chars, due = (key,), hashlib.sha256(), 0, 0, 0
                if n != due:
                    raise ValueError(f"example {n} of conversation {key} comes where {due} is due")
                if start is not None:
                    reply = unescaped(text[start:end])
                    loss.update(reply.encode())
                    loss_chars += len(reply)
                last, chars, due = text, chars + len(text), due + 1
        if conv:
            yield of(conv[0], last, loss, loss_chars, chars)

    return _batches(
        each(), ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()],
    )


def read_back(examples: DataFrame) -> DataFrame:
    """A row for each conversation, from the rows of :func:`examples` as they lie: its turns as the last example has them, and all text
    under the mask."""
    return examples.mapInArrow(
        _digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )


#: A conversation whose texts look like marks.
TRICKY = r"\### Assistant: </turn> ok"


def op13_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame(
        [(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], "conv_id long, turn long, role string, text string",
    )
    return read_back(examples(rows.unionByName(more)))
