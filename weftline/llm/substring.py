"""Substring deduplication by relative Lempel-Ziv parsing against blocks of the corpus.

A passage is a window of WINDOW words; every window of a document that starts earlier in the
corpus (smaller doc_id, or the same document further up) is to go. The reference is the corpus
itself. Its blocks are runs of windows with a common least ANCHOR-word hash: equal windows have
equal least hashes, so whatever block a window could be found in carries the same anchor, and each
document needs to be held just against the blocks of its own anchors.

1. Every document is parsed into blocks. Windows seen earlier in the same document are factors of
   their own and take no further part.
2. Blocks meet by anchor; the index holds the first occurrence of each. A block that occurred before as
   a whole is copied from there. Going through a document, a factor is extended for as long as the
   next block continues the copy at the same source; it is emitted with its source and length
   (`parse`). What remains are first occurrences. Where an anchor has but one, nothing else can be equal.
3. Where it has several, factors end inside blocks. At these boundaries the windows themselves
   meet, by hash, and all but the earliest go.
4. Factors, of WINDOW words at least, and boundary windows are united, and their words are removed.

Within a chunk of documents equal blocks, and equal windows, meet before they are shuffled: all but
the earliest are settled there and then spread over all tasks, so that a passage of a third of all
documents is a few rows of one key. What meets is streamed in sorted order with the state of one row.
Blocks are equal by 64 + 32 bits of two hashes beside the anchor's 64, windows by 128 bits.

Defined results: null text has no words; texts of fewer than WINDOW words keep all; very long texts are
parsed whole; repeated rows are one document and get equal results; unlike texts that share a doc_id are
documents of their own, in the order of their hashes; a null doc_id sorts first; an empty table
gives an empty table; other columns pass through, those named as the results are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.textops import Words, bounded, mix, others, range_hash, signed, text_buffers, text_chunks, whole_windows, window_hashes, with_text
from weftline.session import materialize

WINDOW, ANCHOR = 20, 8


def sliding(f, x: np.ndarray, k: int) -> np.ndarray:
    """f over x[i : i + k] for every i, for f one of np.minimum and np.maximum, in log k steps."""
    width = 1
    while 2 * width <= k:
        x = f(x[:-width], x[width:])
        width *= 2
    return f(x[: len(x) - (k - width)], x[k - width :]) if width < k else x


def later_in_row(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which hashes occurred before in their row."""
    both = hashes ^ (rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    ranked = np.sort(both)
    later = np.zeros(len(both), bool)
    if (ranked[1:] == ranked[:-1]).any():
        order = np.argsort(both, kind="stable")
        ranked = both[order]
        later[order[1:][ranked[1:] == ranked[:-1]]] = True
    return later


class Parsed:
    """Words, hashes and first-in-document windows of some texts."""

    def __init__(self, texts: pa.Array, window: int, anchor: int):
        self.words = Words(*text_buffers(texts))
        self.window, self.anchor = window, anchor
        self.hashes = self.words.hashes()
        self.starts = whole_windows(self.words.first, window)
        self.rows = np.searchsorted(self.words.first, self.starts, "right") - 1 if len(self.starts) else self.starts
        self.window_hashes = window_hashes(self.hashes, window)
        self.later = later_in_row(self.window_hashes[self.starts], self.rows)

    def blocks(self) -> tuple[np.ndarray, ...]:
        """anchor, block hash, second hash, row, position (in the row) and number of windows of each block."""
        if not len(self.starts):
            return (np.zeros(0, np.int64),) * 6
        least = sliding(np.minimum, window_hashes(self.hashes, self.anchor), self.window - self.anchor + 1)
        at, rows = self.starts[~self.later], self.rows[~self.later]
        anchors = least[at]
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (rows[1:] != rows[:-1]) | (anchors[1:] != anchors[:-1])
        begin = np.flatnonzero(new)
        count = np.diff(np.append(begin, len(at)))
        start = at[begin]
        end = start + count - 1 + self.window
        second = range_hash(self.hashes * SECOND, start, end) >> np.uint64(33)
        return anchors[begin], range_hash(self.hashes, start, end), second.astype(np.int32), rows[begin], start - self.words.first[rows[begin]], count


SECOND = np.uint64(0xD6E8FEB86659FD93)
LEAST = np.iinfo(np.int64).min


def earliest(key: np.ndarray, doc: np.ndarray, sub: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """For each row the first row of equal key, in the order of documents and places."""
    origin = np.arange(len(key))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key), bool)
    same[1:] = key[order[1:]] == key[order[:-1]]
    twice = same.copy()
    twice[:-1] |= same[1:]
    some = order[twice]
    if len(some):
        some = some[np.lexsort((pos[some], sub[some], doc[some], key[some]))]
        new = np.ones(len(some), bool)
        new[1:] = key[some[1:]] != key[some[:-1]]
        origin[some] = some[np.maximum.accumulate(np.where(new, np.arange(len(some)), 0))]
    return origin


def column(batch: pa.RecordBatch, i: int) -> np.ndarray:
    c = batch.column(i)
    return (c.fill_null(LEAST if c.type == pa.int64() else 0) if c.null_count else c).to_numpy(zero_copy_only=False)


def numbers(c: pa.Array) -> np.ndarray:
    return (c.fill_null(LEAST) if c.null_count else c).to_numpy()


#: settled: the source is known to come earlier; the row needs no other to meet.
BLOCK = "anchor long, block long, second int, doc_id long, sub long, pos int, n int, settled boolean, source long, source_sub long, source_pos int"
NAMES = [x.split()[0] for x in BLOCK.split(", ")]


def blocks(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in text_chunks(batch.column(2)):
                ids, subs, texts = batch.slice(lo, hi - lo).columns
                a, b, c, rows, pos, n = Parsed(texts, window, anchor).blocks()
                if not len(a):
                    continue
                doc, sub = numbers(ids)[rows], numbers(subs)[rows]
                first = earliest(b ^ mix(a) + c.astype(np.uint64), doc, sub, pos)
                settled = (doc != doc[first]) | (sub != sub[first]) | (pos != pos[first])
                of = pa.array(rows)
                source = pa.array(rows[first])
                yield pa.RecordBatch.from_arrays([pa.array(signed(a)), pa.array(signed(b)), pa.array(c), ids.take(of), subs.take(of), pa.array(pos, pa.int32()), pa.array(n, pa.int32()), pa.array(settled), ids.take(source), subs.take(source), pa.array(pos[first], pa.int32())], NAMES)

    return docs.mapInArrow(run, BLOCK)


#: factor: a copy from source; otherwise a first occurrence that shares its anchor with others.
MARK = "doc_id long, sub long, pos int, n int, factor boolean, source long, source_sub long, source_pos int"


class Firsts:
    """Follows sorted rows over batches: which repeat the one before, and where each run began."""

    def __init__(self) -> None:
        self.last: tuple | None = None

    def origins(self, key: list[np.ndarray], place: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        same = np.zeros(len(key[0]), bool)
        same[1:] = np.logical_and.reduce([x[1:] == x[:-1] for x in key])
        same[0] = self.last is not None and all(x[0] == y for x, y in zip(key, self.last[0]))
        begin = np.maximum.accumulate(np.where(same, -1, np.arange(len(same))))
        first = [np.where(begin >= 0, x[begin], self.last[1][i] if self.last else 0) for i, x in enumerate(place)]
        self.last = [x[-1] for x in key], [x[-1] for x in first]
        return same, first


def factors(found: DataFrame) -> DataFrame:
    """From blocks: copies with their sources, and the first occurrences that share their anchor with others."""
    names = [x.split()[0] for x in MARK.split(", ")]

    def marks(batch: pa.RecordBatch, factor: np.ndarray, source: list[pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns[3:7], pa.array(factor), *source], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, anchors = Firsts(), Firsts()
        pending = None  # the first occurrence that the stream stands at, while its anchor has no other block
        for batch in batches:
            settled = batch.filter(batch.column(7))
            if settled.num_rows:
                yield marks(settled, np.ones(settled.num_rows, bool), settled.columns[8:])
            batch = batch.filter(pc.invert(batch.column(7)))
            if not batch.num_rows:
                continue
            anchor, block, second, doc, sub, pos = (column(batch, i) for i in range(6))
            same_anchor, _ = anchors.origins([anchor], [])
            same_block, (o_doc, o_sub, o_pos) = firsts.origins([anchor, block, second], [doc, sub, pos])
            first = np.flatnonzero(~same_block)
            # Repeated rows are the first occurrence itself, not a later one.
            factor = same_block & ((doc != o_doc) | (sub != o_sub) | (pos != o_pos))
            shared = same_anchor[first].copy()
            shared[:-1] |= same_anchor[first[1:]]
            if len(first):
                if pending is not None and same_anchor[first[0]]:
                    yield marks(pending, np.zeros(1, bool), pending.columns[8:])
                pending = None if shared[-1] else batch.slice(int(first[-1]), 1)
            check = np.zeros(len(anchor), bool)
            check[first[shared]] = True
            keep = factor | check
            if keep.any():
                source = [pa.array(o_doc[keep], mask=o_doc[keep] == LEAST), pa.array(o_sub[keep]), pa.array(o_pos[keep], pa.int32())]
                yield marks(batch.filter(pa.array(keep)), factor[keep], source)

    # Settled rows go anywhere, the others to their anchor.
    spread = F.when(F.col("settled"), F.xxhash64("doc_id", "sub", "pos")).otherwise(F.col("anchor"))
    return found.repartition(spread).sortWithinPartitions("settled", "anchor", "block", "second", "doc_id", "sub", "pos").mapInArrow(run, MARK)


def boundary_windows(docs: DataFrame, marks: DataFrame, window: int) -> DataFrame:
    """doc_id, sub, pos of the windows in unsettled blocks that occur earlier in others."""
    names = ["hash", "second", "doc_id", "sub", "pos", "settled"]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in text_chunks(batch.column(2)):
                ids, subs, texts, part = batch.slice(lo, hi - lo).columns
                words = Words(*text_buffers(texts))
                h = words.hashes()
                flat = part.flatten()
                rows = np.repeat(np.arange(hi - lo), part.value_lengths().to_numpy())
                pos, n = (np.asarray(flat.field(i)).astype(np.int64) for i in (0, 1))
                first = np.repeat(words.first[rows] + pos, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                rows = np.repeat(rows, n)
                place = first - words.first[rows]
                one, two = window_hashes(h, window)[first], range_hash(h * SECOND, first, first + window)
                doc, sub = numbers(ids)[rows], numbers(subs)[rows]
                origin = earliest(one ^ mix(two), doc, sub, place)
                settled = (doc != doc[origin]) | (sub != sub[origin]) | (place != place[origin])
                of = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(signed(one)), pa.array(signed(two)), ids.take(of), subs.take(of), pa.array(place, pa.int32()), pa.array(settled)], names)

    def late(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = Firsts()
        for batch in batches:
            gone = column(batch, 5).astype(bool)
            meet = np.flatnonzero(~gone)
            if len(meet):
                a, b, doc, sub, pos = (column(batch, i)[meet] for i in range(5))
                same, (o_doc, o_sub, o_pos) = firsts.origins([a, b], [doc, sub, pos])
                gone[meet] = same & ((doc != o_doc) | (sub != o_sub) | (pos != o_pos))
            if gone.any():
                yield pa.RecordBatch.from_arrays(batch.filter(pa.array(gone)).columns[2:5], names[2:5])

    places = marks.filter(~F.col("factor")).groupBy("doc_id", "sub").agg(F.collect_list(F.struct("pos", "n")).alias("places"))
    texts = docs.alias("d").join(places.alias("p"), same_row("d", "p")).select("d.doc_id", "d.sub", "d.text", "p.places")
    windows = texts.mapInArrow(hashed, "hash long, second long, doc_id long, sub long, pos int, settled boolean")
    spread = F.when(F.col("settled"), F.xxhash64("doc_id", "sub", "pos")).otherwise(F.col("hash"))
    return windows.repartition(spread).sortWithinPartitions("hash", "second", "settled", "doc_id", "sub", "pos").mapInArrow(late, "doc_id long, sub long, pos int")


def same_row(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.sub") == F.col(f"{b}.sub"))


def told_apart(docs: DataFrame, text: str, key: str) -> DataFrame:
    """doc_id, sub, text and the row itself. sub tells unlike texts of one doc_id apart, and is 0 where there are none."""
    own = bounded(docs).select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.struct("*").alias("row"))
    content = F.xxhash64("text")
    twice = own.groupBy("doc_id").agg(F.min(content).alias("lo"), F.max(content).alias("hi")).filter("lo <> hi").select("doc_id")
    twice = materialize(twice, "repeated")
    if twice.isEmpty():
        return own.select("doc_id", F.lit(0).cast("long").alias("sub"), "text", "row")
    found = own.alias("o").join(twice.select("doc_id", F.lit(True).alias("twice")).alias("t"), F.col("o.doc_id").eqNullSafe(F.col("t.doc_id")), "left")
    return found.select("o.doc_id", F.when(F.col("twice"), content).otherwise(F.lit(0)).cast("long").alias("sub"), "text", "row")


def longest(places: np.ndarray) -> np.ndarray:
    """Factors from a document's copied blocks (pos, n, source, source_sub, source_pos), ordered by pos: a
    factor goes on while the next block continues it here and at the source."""
    if not len(places):
        return places
    pos, n, source, sub, at = places.T
    new = np.ones(len(places), bool)
    new[1:] = (pos[1:] != pos[:-1] + n[:-1]) | (source[1:] != source[:-1]) | (sub[1:] != sub[:-1]) | (at[1:] != at[:-1] + n[:-1])
    begin = np.flatnonzero(new)
    out = places[begin]
    out[:, 1] = np.add.reduceat(n, begin)
    return out


FACTOR = "struct<start:bigint,length:bigint,source:bigint,source_start:bigint>"


def deduplicate(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs plus n_words, n_removed, kept (the kept words joined by one space) and n_factors."""
    done = parsed(docs, window, anchor, text, key)
    return done.select(*others(docs, "n_words", "n_removed", "kept", "n_factors", prefix="row."), "cut.n_words", "cut.n_removed", "cut.kept", F.size("cut.factors").cast("long").alias("n_factors"))


def parse(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, start, length, source, source_start: the factors, in words, copied from an earlier document
    or from further up. Repeats within a document that no other document shares have no factor here."""
    return parsed(docs, window, anchor, text, key).select("doc_id", F.explode("cut.factors").alias("f")).select("doc_id", "f.*")


def shortened(docs: DataFrame) -> DataFrame:
    """docs with the kept words as text, where any went, and n_chars, where there is one, in step."""
    new = F.when(F.col("cut.n_removed") > 0, F.col("cut.kept")).otherwise(F.col("row.text"))
    return with_text(parsed(docs), new, docs, prefix="row.")


def parsed(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, the row of docs and cut, a struct of n_words, n_removed, kept and factors."""
    own = told_apart(docs, text, key)
    marks = materialize(factors(blocks(own.select("doc_id", "sub", "text"), window, anchor)), "marks", large=True)
    late = boundary_windows(own.select("doc_id", "sub", "text"), marks, window)
    none = F.lit(None)
    # Written before the last join, so that the shuffles of texts and windows go first, however few rows they left.
    late = materialize(late, "late", large=True)
    late = late.select("doc_id", "sub", "pos", F.lit(1).alias("n"), none.cast("long").alias("source"), none.cast("long").alias("source_sub"), none.cast("int").alias("source_pos"))
    spans = marks.filter("factor").drop("factor").unionByName(late)
    spans = spans.groupBy("doc_id", "sub").agg(F.collect_list(F.struct("pos", "n", "source", "source_sub", "source_pos")).alias("spans"))

    @F.arrow_udf(f"struct<n_words:bigint,n_removed:bigint,kept:string,factors:array<{FACTOR}>>")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        counts, removed, kept, made = [], [], [], []
        for lo, hi in text_chunks(texts):
            part, some = texts.slice(lo, hi - lo), spans.slice(lo, hi - lo)
            p = Parsed(part, window, anchor)
            words = p.words
            rows = np.repeat(np.arange(hi - lo), some.value_lengths().fill_null(0).to_numpy())
            flat = some.flatten()
            copied = pc.is_valid(flat.field(4)).to_numpy(zero_copy_only=False)
            places = np.stack([numbers(flat.field(i).cast(pa.int64())) for i in range(5)], 1)
            order = np.lexsort((places[:, 0], rows))
            rows, places, copied = rows[order], places[order], copied[order]
            pos, n = places[:, 0], places[:, 1]
            begin = np.concatenate((words.first[rows] + pos, p.starts[p.later]))
            end = np.concatenate((words.first[rows] + pos + n - 1, p.starts[p.later])) + window
            step = np.zeros(len(words) + 1, np.int64)
            np.add.at(step, begin, 1)
            np.add.at(step, end, -1)
            keep = np.cumsum(step[:-1]) == 0
            total = np.concatenate(([0], np.cumsum(keep)))[words.first]
            counts += words.counts().tolist()
            removed += (words.counts() - np.diff(total)).tolist()
            raw = words.data.tobytes()
            bounds = np.searchsorted(rows[copied], np.arange(hi - lo + 1))
            copies = places[copied]
            for r in range(hi - lo):
                mine = raw[words.offsets[r] : words.offsets[r + 1]].split()
                if removed[lo + r]:
                    mine = compress(mine, keep[words.first[r] : words.first[r + 1]].tolist())
                kept.append(b" ".join(mine))
                own = longest(copies[bounds[r] : bounds[r + 1]])
                made.append([{"start": a, "length": k - 1 + window, "source": None if s == LEAST else s, "source_start": at} for a, k, s, _, at in own.tolist()])
        kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "source", "source_start")]))
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(made, kind)], ["n_words", "n_removed", "kept", "factors"])

    joined = own.select("doc_id", "sub", "row").alias("d").join(spans.alias("s"), same_row("d", "s"), "left")
    return joined.select("d.doc_id", "d.row", cut(F.coalesce(F.col(f"d.row.`{text}`"), F.lit("")), F.col("s.spans")).alias("cut"))


def brute_force(rows: list[tuple[int, str | None]], window: int = WINDOW) -> dict[int, tuple[int, int, str]]:
    """doc_id: (n_words, n_removed, SHA-256 of what is kept), by the definition; for tests."""
    import re

    split = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in rows}
    seen: set[tuple[str, ...]] = set()
    out = {}
    for d in sorted(split):
        w = split[d]
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out
