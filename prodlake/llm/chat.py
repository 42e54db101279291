"""Chat formatting with a grammar that is parsed back.

    conversation = turn*
    turn         = "<|im_start|>" role LF text "<|im_end|>" LF

Every stretch of rendered turns is read again by a deterministic parser and compared with its
source.  Turns that come back different are escaped until the stretch is identical: a control
string gets one backslash more behind its ``<|``, and the parser takes one off, so escaping is
reversible and text without control strings stays as it is.  In a role a line feed is written
``<|nl|>``.  The loss mask is the list of code-point ranges of the assistant texts.

Rows are range partitioned by conversation and turn, so that a conversation of any size is
spread over tasks.  A task writes pieces of whole turns, of about ``PIECE`` characters at most;
a conversation in the middle of a task that fits into one piece is ``whole``.  Digests of whole
conversations are taken where they are read; the pieces of the others are brought together by
conversation and read as a stream, one piece at a time.

Defined cases: a null text or role is empty; rows without conv_id are one conversation of their
own; a null turn comes first; rows of the same turn follow each other by role and text and
repeated rows stay; a text longer than a piece is a piece of its own; an empty table gives no
conversations; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

START, END, LINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
LEARNED = "assistant"  # the role under the loss mask
PIECE = 1 << 20  # characters after which a piece is closed

_MARK = re.compile(r"<\|im_(?:start|end)\|>")
_TEXT = re.compile(r"<\|(?=\\*im_(?:start|end)\|>)")
_ROLE = re.compile(r"<\|(?=\\*(?:im_start|im_end|nl)\|>)")
_TEXT_BACK = re.compile(r"<\|\\(?=\\*im_(?:start|end)\|>)")
_ROLE_BACK = re.compile(r"<\|\\(?=\\*(?:im_start|im_end|nl)\|>)")

PIECES = (
    "conv_id bigint, part int, seq int, whole boolean, n_turns int, text string, loss array<struct<start:int,end:int>>"
)
DIGESTS = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
)

Turn = tuple[str, str]  # role and text


class GrammarError(ValueError):
    """A text that the grammar does not produce."""


def escape_text(text: str) -> str:
    return _TEXT.sub(r"<|\\", text)


def escape_role(role: str) -> str:
    return _ROLE.sub(r"<|\\", role).replace("\n", LINE)


def unescape_text(text: str) -> str:
    return _TEXT_BACK.sub("<|", text) if "<|\\" in text else text


def unescape_role(role: str) -> str:
    return _ROLE_BACK.sub("<|", role.replace(LINE, "\n")) if "<|" in role else role


def parse(rendered: str) -> Iterator[tuple[str, str, int, int]]:
    """``role, text, start, end`` of every turn; the range is that of the text as rendered."""
    at = 0
    while at < len(rendered):
        if not rendered.startswith(START, at):
            raise GrammarError(f"no turn starts at {at}")
        line = rendered.find("\n", at)
        role = rendered[at + len(START) : line]
        if line < 0 or _MARK.search(role):
            raise GrammarError(f"no role at {at}")
        mark = _MARK.search(rendered, line + 1)
        if mark is None or mark[0] != END or rendered[mark.end() : mark.end() + 1] != "\n":
            raise GrammarError(f"the turn at {at} does not end")
        yield unescape_role(role), unescape_text(rendered[line + 1 : mark.start()]), line + 1, mark.start()
        at = mark.end() + 1


def _same(rendered: str, turns: list[Turn]) -> list[tuple[int, int]] | None:
    """The ranges of the texts, if ``rendered`` reads back as ``turns``."""
    try:
        found = list(parse(rendered))
    except GrammarError:
        return None
    return [f[2:] for f in found] if [f[:2] for f in found] == turns else None


def _turn(role: str, text: str) -> str:
    return f"{START}{role}\n{text}{END}\n"


def render(turns: list[Turn]) -> tuple[str, list[tuple[int, int]]]:
    """The text of some turns and the range of each turn's text, checked by reading it back."""
    written = [_turn(*t) for t in turns]
    rendered = "".join(written)
    places = _same(rendered, turns)
    if places is None:
        # a turn that does not come back alone is escaped: its text, then its role as well
        for i, turn in enumerate(turns):
            for spelled in ((turn[0], escape_text(turn[1])), (escape_role(turn[0]), turn[1]), (escape_role(turn[0]), escape_text(turn[1]))):
                if _same(written[i], [turn]) is not None:
                    break
                written[i] = _turn(*spelled)
        rendered = "".join(written)
        places = _same(rendered, turns)
    if places is None:
        raise GrammarError("turns that the grammar cannot carry")
    return rendered, places


def _format(piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        turns: list[Turn] = []
        size, begun, single, first = 0, False, True, True
        current: int | None = None

        def close(last: bool, closed: bool) -> pa.RecordBatch:
            """A piece; ``last`` of its conversation, which is ``closed`` if it cannot go on elsewhere."""
            nonlocal seq
            text, places = render(turns)
            loss = [{"start": a, "end": b} for (role, _), (a, b) in zip(turns, places, strict=True) if role == LEARNED]
            row = [current, part, seq, closed and last and single, len(turns), text, loss]
            seq += 1
            turns.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _TYPES, strict=True)], names=_NAMES)

        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                role, text = role or "", text or ""
                if begun and conv_id != current:
                    yield close(True, not first)
                    size, single, first = 0, True, False
                elif begun and size + len(text) > piece:
                    yield close(False, False)
                    size, single = 0, False
                current, begun = conv_id, True
                turns.append((role, text))
                size += len(text)
        if begun:
            # the first and the last conversation of a task may have turns in other tasks
            yield close(True, False)

    return run


_NAMES = ["conv_id", "part", "seq", "whole", "n_turns", "text", "loss"]
_TYPES = [
    pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.string(),
    pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])),
]


def format_conversations(conversations: DataFrame, piece: int = PIECE) -> DataFrame:
    """The pieces of all conversations (conv_id, turn, role, text): a row holds whole turns,
    ``text`` as a model reads it and ``loss``, the ranges it learns from.  The pieces of a
    conversation follow each other by ``part`` and ``seq``."""
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = conversations.select(F.col("conv_id").cast("bigint"), "turn", "role", "text")
    rows = rows.repartitionByRange(parts, *order[:2]).sortWithinPartitions(*order)
    return rows.select("conv_id", "role", "text").mapInArrow(_format(piece), PIECES)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations whose pieces come one after the other."""
    done: list[tuple] = []
    state: list | None = None

    def result() -> tuple:
        conv_id, turns, all_, chars, loss, size = state
        return conv_id, turns, all_.hexdigest(), chars, loss.hexdigest(), size

    for batch in batches:
        for row in range(batch.num_rows):
            conv_id, part, seq, whole, _, text, mask = (batch.column(c)[row].as_py() for c in range(7))
            if state is None or whole or state[0] != conv_id:
                if state is not None:
                    done.append(result())
                state = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, said, _, _ in parse(text):
                state[1] += 1
                state[2].update(f"{role}\n{said}\n".encode())
            for span in mask:
                learned = unescape_text(text[span["start"] : span["end"]])
                state[3] += len(learned)
                state[4].update(learned.encode())
            state[5] += len(text)
        if len(done) >= 4096:
            yield _digest_batch(done)
            done = []
    if state is not None:
        done.append(result())
    if done:
        yield _digest_batch(done)


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [c.split()[0] for c in DIGESTS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per conversation, parsed from the written pieces: its number of turns, digests of its turns
    and of the text under the loss mask, both unescaped, and its formatted length."""
    pieces = spark.read.schema(PIECES).parquet(path)
    whole = pieces.filter("whole").mapInArrow(_digests, DIGESTS)
    # a digest runs over a conversation from front to back; only its pieces stream through a task
    split = pieces.filter("NOT whole").repartition(F.col("conv_id"))
    split = split.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part", "seq")
    return whole.union(split.mapInArrow(_digests, DIGESTS))


def write_conversations(conversations: DataFrame, path: str, **options) -> None:
    format_conversations(conversations, **options).write.option("compression", "zstd").parquet(path)


def round_trip(conversations: DataFrame, **options) -> DataFrame:
    """Write the conversations to fresh files in the shared folder and digest what is read back."""
    spark = conversations.sparkSession
    path = scratch_path(spark, "chat")
    write_conversations(conversations, path, **options)
    return read_digests(spark, path)
