"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to one string; nothing else is known
of it. Successive turn prefixes are rendered and consecutive outputs compared: where the longer
output starts with the shorter, the difference is the new turn's span; where it doesn't, the
template rewrites history, and the turn is marked. The text's own place inside an assistant's
span is found by rendering the turn once more with a marker for its text.

Every prefix is rendered whole, so a conversation's turns are held and its cost grows with the square
of its length. A template whose attribute `stateless` is true declares that a turn depends on no
other turns: its conversations are streamed, and those of more than BLOCK turns go on in blocks,
each rendered after its first and its last preceding turn, which gives the same.

Defined results: null text and null role count as empty; very long texts are rendered whole; turns with equal numbers (null first)
are ordered by role, then text; repeated rows are turns of their own; a null conv_id is one
conversation; no rows give no rows; other
columns are dropped, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

BLOCK = 128
MARK = "\ue000\ue001\ue000"

CONTROL = re.compile(r"\\|###|</turn>")
ROLE_CONTROL = re.compile(r"\\|###|</turn>|:")
ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
PIECE = re.compile(r"### ((?:[^\\:]|\\(?:\\|###|</turn>|:))*): (.*)</turn>\n", re.S)


def escape(text: str, control: re.Pattern = CONTROL) -> str:
    return control.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def turn_template(turns: list[Turn]) -> str:
    """`### role: text</turn>` for each turn, with control strings inside texts escaped."""
    return "".join(f"### {escape(role, ROLE_CONTROL)}: {escape(text)}</turn>\n" for role, text in turns)


turn_template.stateless = True


def read_piece(piece: str) -> Turn:
    """The inverse of turn_template for one turn."""
    m = PIECE.fullmatch(piece)
    if not m:
        raise ValueError("not one formatted turn")
    return unescape(m[1]), unescape(m[2])


def locate(turns: Iterable[Turn], template: Template = turn_template, loss_role: str = "assistant", block: int = BLOCK) -> Iterator[tuple[str, int, int, int | None, int | None, bool]]:
    """(piece, start, end, loss start, loss end, rewrites) for each turn. start..end is the turn's
    span in the whole output, the loss span that of its text; rewrites: the template changed what
    it had rendered before, and the piece starts where the outputs part."""
    stateless = getattr(template, "stateless", False)
    at = 0
    first: Turn | None = None
    seen: list[Turn] = []
    before = template([])
    for turn in turns:
        if stateless and len(seen) >= block:
            seen = [first, seen[-1]]
            before = template(seen)
        if first is None:
            first = turn
        now = template([*seen, turn])
        rewrites = not now.startswith(before)
        common = len(before)
        if rewrites:
            common = next((i for i, (a, b) in enumerate(zip(before, now)) if a != b), min(len(before), len(now)))
            at -= len(before) - common
        piece = now[common:]
        lo = hi = None
        if turn[0] == loss_role:
            marked = template([*seen, (turn[0], MARK)])[common:]
            head = marked.find(MARK)
            if head >= 0:
                lo, hi = at + head, at + len(piece) - (len(marked) - head - len(MARK))
        yield piece, at, at + len(piece), lo, hi, rewrites
        at += len(piece)
        seen.append(turn)
        before = now


def by_conversation(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """(conv_id, its rows) of rows sorted by conv_id. The rows are a stream to be used up first."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    pending = next(rows, None)
    while pending is not None:
        key = pending[0]

        def group() -> Iterator[tuple]:
            nonlocal pending
            while pending is not None and pending[0] == key:
                row, pending = pending, next(rows, None)
                yield row

        stream = group()
        yield key, stream
        for _ in stream:
            pass


PIECES = "conv_id long, pos long, piece string, start long, end long, loss_start long, loss_end long, rewrites boolean"


def batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    kept: list[tuple] = []
    for row in rows:
        kept.append(row)
        if len(kept) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept), schema.types)], schema.names)
            kept = []
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept), schema.types)], schema.names)


def format_conversations(turns: DataFrame, template: Template = turn_template, loss_role: str = "assistant") -> DataFrame:
    """One row a turn, in order within each partition: its piece of the output, spans of the piece
    and of the text under the loss mask (code points from the conversation's start)."""
    schema = pa.schema([(n, {"string": pa.string(), "boolean": pa.bool_()}.get(t, pa.int64())) for n, t in (x.split() for x in PIECES.split(", "))])

    def rows(batches):
        for key, stream in by_conversation(batches):
            for pos, x in enumerate(locate(((r[1], r[2]) for r in stream), template, loss_role)):
                yield key, pos, *x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(rows(batches), schema)

    clean = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = clean.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ordered.mapInArrow(run, PIECES)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_rewrites long"


def digests(pieces: DataFrame) -> DataFrame:
    """One row a conversation, read back from the pieces of turn_template's output."""
    schema = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (x.split() for x in DIGESTS.split(", "))])

    def rows(batches):
        for key, stream in by_conversation(batches):
            turns, loss, n, loss_chars, chars, rewrites = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0
            for _, _, piece, start, end, lo, hi, again in stream:
                role, text = read_piece(piece)
                turns.update(f"{role}\n{text}\n".encode())
                n, chars, rewrites = n + 1, end, rewrites + again
                if lo is not None:
                    masked = unescape(piece[lo - start : hi - start])
                    loss_chars += len(masked)
                    loss.update(masked.encode())
            yield key, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, rewrites

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(rows(batches), schema)

    return pieces.mapInArrow(run, DIGESTS)
