"""Best-fit packing with certified bin counts.

Documents become token pieces of at most `capacity`; pieces are dealt over partitions of bounded
size and packed there by best-fit decreasing. Dual-feasible functions bound from below the number
of bins that any packing of a partition needs. A partition that meets its bound is certified and
stays; one with a gap gives up its emptiest bins, whose pieces meet those of other partitions and
are packed again, for as long as that saves bins.

Defined results: null text counts as empty (one piece of the end id); very long texts are tokenised whole
and cut into pieces; an empty table gives no pieces; repeated rows are packed once each; pieces of equal
length are taken in row order; other columns are dropped, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.textops import bounded

from weftline.session import materialize

CAPACITY = 2048
ITEMS_A_PARTITION = 20_000


@lru_cache(maxsize=2)
def tokenizer(json_name: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(json_name))


@lru_cache(maxsize=2)
def special_strings(json_name: str) -> tuple[str, ...]:
    import json

    import public_tokenizers

    with open(public_tokenizers.path(json_name), encoding="utf-8") as f:
        return tuple(t["content"] for t in json.load(f)["added_tokens"])


@lru_cache(maxsize=2)
def ranked(ranks_name: str):
    """A faster encoder of the same vocabulary."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(ranks_name), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str, json_name: str = "byte_bpe_50k.json", ranks_name: str = "byte_bpe_50k.tiktoken") -> np.ndarray:
    """The tokenizer's ids. Texts without its special strings go through the faster encoder, which gives the
    same (tested over all texts of a scale factor)."""
    if any(s in text for s in special_strings(json_name)):
        return np.array(tokenizer(json_name).encode(text, add_special_tokens=False).ids, np.uint32)
    return np.array(ranked(ranks_name).encode_ordinary(text), np.uint32)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of n ids' pieces: full ones, after a shorter first one if n isn't a multiple."""
    head = n % capacity
    starts = [0] if head else []
    starts += range(head, n, capacity)
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], n])]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False, json_name: str = "byte_bpe_50k.json", ranks_name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, the ids as little-endian bytes."""
    schema = PIECES + (", ids binary" if with_ids else "")
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                rows = []
                for key, text in zip(*(c.to_pylist() for c in batch.slice(i, 500).columns)):
                    ids = np.append(token_ids(text or "", json_name, ranks_name), np.uint32(end_id)).astype("<u4")
                    for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                        raw = ids[start : start + length].tobytes()
                        rows.append((key, piece, start, length, zlib.crc32(raw), *[raw] * with_ids))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return bounded(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def best_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the bins' fills. Of the open bins that hold an item, the
    fullest takes it; `open_` has a bit for each free space that some bin has."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    fills: list[int] = []
    open_ = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = open_ >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            b = by_space[space].pop()
            if not by_space[space]:
                open_ &= ~(1 << space)
        else:
            space, b = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        if space > size:
            by_space[space - size].append(b)
            open_ |= 1 << (space - size)
    return bins, offsets, np.array(fills, np.int64)


def lower_bound(sizes: np.ndarray, capacity: int = CAPACITY, steps: int = 30) -> int:
    """No packing has fewer bins: the largest of the bounds by two families of dual-feasible functions."""
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    n, total = np.cumsum(count), np.cumsum(count * np.arange(capacity + 1))
    least = np.arange(0, capacity // 2 + 1)  # sizes under it count nothing, those above capacity - it a whole bin
    whole = n[-1] - n[capacity - least]
    middle = total[capacity - least] - np.where(least > 0, total[np.maximum(least - 1, 0)], 0)
    best = int(np.max(-(-(whole * capacity + middle) // capacity)))
    x = np.arange(capacity + 1)
    for k in range(1, steps + 1):  # scaled by k
        value = np.where((k + 1) * x % capacity == 0, k * x, (k + 1) * x // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


PACKED = PIECES + ", item long, part long, bin long, offset long, bound long, bins long, released boolean"


def pack_parts(items: DataFrame, parts: int, salt: int, capacity: int) -> DataFrame:
    """items dealt over `parts` partitions and packed in each; the emptiest bins of a partition with a gap are released."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("item", ignore_index=True)
        sizes = rows["length"].to_numpy()
        bins, offsets, fills = best_fit_decreasing(sizes, capacity)
        bound = lower_bound(sizes, capacity)
        free = np.zeros(len(fills), bool)
        if len(fills) > bound:
            free[np.argsort(fills, kind="stable")[: 16 * (len(fills) - bound) + 16]] = True
        return rows.assign(bin=bins, offset=offsets, bound=bound, bins=len(fills), released=free[bins])

    dealt = items.select(*[x.split()[0] for x in PIECES.split(", ")], "item", F.pmod(F.xxhash64(F.lit(salt), "item"), F.lit(parts)).alias("part"))
    return dealt.groupBy("part").applyInPandas(pack, PACKED)


def pack(found: DataFrame, capacity: int = CAPACITY, items_a_partition: int = ITEMS_A_PARTITION, rounds: int | None = None) -> DataFrame:
    """`pieces` plus sequence_id, offset, and the bins and lower bound of the partition that a piece was packed
    in. Partitions with a gap exchange for as long as a round saves bins, or that many rounds."""
    items = materialize(found.select(*[x.split()[0] for x in PIECES.split(", ")]).withColumn("item", F.monotonically_increasing_id()), "pieces")
    done: list[DataFrame] = []
    n_items, bins_before, turn = items.count(), None, 0
    while rounds is None or turn < rounds:
        packed = materialize(pack_parts(items, max(1, -(-n_items // items_a_partition)), turn, capacity), "packed").withColumn("turn", F.lit(turn).cast("long"))
        n_bins, n_freed, n_items = packed.agg(
            F.coalesce(F.sum((F.col("offset") == 0).cast("long")), F.lit(0)),
            F.coalesce(F.sum(((F.col("offset") == 0) & F.col("released")).cast("long")), F.lit(0)),
            F.coalesce(F.sum(F.col("released").cast("long")), F.lit(0)),
        ).first()
        if bins_before is not None and n_bins >= bins_before:
            break  # nothing gained: the bins of the turn before stay
        if turn:
            done[-1] = done[-1].filter(~F.col("released"))
        done.append(packed)
        if not n_freed:
            break
        items, bins_before, turn = packed.filter("released"), n_freed, turn + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    sequence = F.shiftleft("turn", 56) + F.shiftleft("part", 24) + F.col("bin")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), "offset", "bins", "bound")
