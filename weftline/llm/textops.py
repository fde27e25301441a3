"""Words and word-sequence hashes over Arrow string columns, vectorised in numpy.

Words are maximal runs of bytes other than space, tab, \\n, \\v, \\f, \\r. Hashes are 64-bit and
depend on nothing but the words, so that equal word sequences hash alike in every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are worked on in chunks of so many bytes, or one by one if longer.
CHUNK_BYTES = 1_000_000
KEPT_POWERS = 1 << 19
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_R = 0xD1342543DE82EF95
_R_INVERSE = pow(_R, -1, 1 << 64)
_POWERS = {_R: np.ones(1, np.uint64), _R_INVERSE: np.ones(1, np.uint64)}


def byte_values(data: np.ndarray) -> np.ndarray:
    """A random-looking number for each byte."""
    return _BYTE[data]


def powers(n: int, base: int = _R) -> np.ndarray:
    """base^0 ... base^(n - 1); up to KEPT_POWERS stay for the next call."""
    kept = _POWERS[base]
    if len(kept) < n:
        steps = np.full(1 << max(10, (n - 1).bit_length()), base, np.uint64)
        steps[0] = 1
        kept = np.cumprod(steps)
        if len(kept) <= KEPT_POWERS:
            _POWERS[base] = kept
    return kept[:n]


def text_chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, or of one row."""
    sizes = np.diff(text_buffers(texts)[1])
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if len(sizes) > start:
        yield start, len(sizes)


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def bounded(docs: DataFrame) -> DataFrame:
    """docs, after bounding the session's Arrow batches: texts are held several times over on their way to
    Python and back, and Spark's default of 10,000 rows is far more than a task needs at once. A setting
    of the session's own stays."""
    conf = docs.sparkSession.conf
    if conf.get(BATCH) == "10000":
        conf.set(BATCH, str(BATCH_ROWS))
    return docs


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Arrow batches of at most so many rows for the jobs that run within; the session's setting is put back."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(min(int(before), rows) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def others(docs: DataFrame, *added: str, prefix: str = "") -> list[Column]:
    """The columns of docs but those that an operator is about to add under the same name. With a
    prefix, they are taken out of the struct that an operator keeps its rows in meanwhile, so that no
    column of docs can clash with one of the operator's own."""
    taken = {name.lower() for name in added}
    return [F.col(f"{prefix}`{c}`").alias(c) for c in docs.columns if c.lower() not in taken]


def with_text(rows: DataFrame, text: Column, docs: DataFrame, prefix: str = "") -> DataFrame:
    """The columns of docs with a new text; n_chars, where there is one, is its length. Each row of docs is
    in rows, its columns under the prefix."""
    kept = rows.select(text.alias("text"), *([F.col(prefix[:-1]).alias("row")] if prefix else [F.struct("*").alias("row")]))
    new = {"text": lambda kind: F.col("text"), "n_chars": lambda kind: F.length("text").cast(kind)}
    return kept.select(*[(new[c](kind) if c in new else F.col(f"row.`{c}`")).alias(c) for c, kind in docs.dtypes])


class Words:
    """The words of some texts: byte ranges start..end, and first[i]..first[i + 1] those of row i.
    inside: which bytes belong to words, where that is not all but white space."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None):
        self.data, self.offsets = data, offsets
        if inside is None:
            inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        filled = offsets[:-1] < offsets[1:]
        before[offsets[:-1][filled]] = False
        after[offsets[1:][filled] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self._inside = inside

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts())

    def hashes(self, longest: int | None = None) -> np.ndarray:
        """One hash a word, or of its first `longest` bytes."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        at = np.arange(self.start[0], len(self.data)) - np.repeat(self.start, np.diff(np.append(self.start, len(self.data))))
        value = _BYTE[self.data[self.start[0] :]] * powers(int(at.max()) + 1)[at]
        use = self._inside[self.start[0] :]
        if longest is not None:
            use = use & (at < longest)
        return mix(np.add.reduceat(np.where(use, value, np.uint64(0)), self.start - self.start[0]))


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of hashes[i : i + k] for every i; windows may cross rows, see `whole_windows`."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(len(hashes)), out=total[1:])
    return mix((total[k:] - total[:n]) * powers(n, _R_INVERSE) + np.uint64(k))


def whole_windows(first: np.ndarray, k: int) -> np.ndarray:
    """Starts of the k-word windows that lie within one row, in order."""
    counts = np.diff(first)
    usable = np.maximum(counts - k + 1, 0)
    total = int(usable.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(usable)[:-1])), usable)
    return np.arange(total) + shift


def range_hash(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of hashes[start : end] for arrays of ranges."""
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(len(hashes)), out=total[1:])
    inverse = powers(len(hashes) + 1, _R_INVERSE)
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
