"""Phrase collocation mining with merged count-min sketches.

Three passes over the texts, per language:

1. Each task counts its words and pairs of words into a count-min sketch: DEPTH rows of saturating one-byte counters.
   It sends the cells that it has counted in, and the sketches are merged cell by cell, in two rounds so that no task
   gets a cell of all tasks. A merged counter is never below the true count, so what stays below `least` in any row is
   rare for certain. Of the merged sketch a bit for each cell is left: whether it reached `least`.
2. The same for runs of three and four words, but only those whose pairs all survived: a run is no more frequent
   than its pairs. This pass also marks the words of surviving pairs, as no other word is part of a phrase.
3. The survivors alone are counted exactly, by their text, and those below `least` go. So nothing frequent is lost,
   and nothing that only shares its cells with others stays.

Then each phrase is scored by its weakest cut, and phrases that live mostly inside a longer one are subsumed.

The bits of both sketches are broadcast: (DEPTH + 1) * WIDTH / 8 bytes each, whatever the corpus. A corpus that fills
the sketch with counts of `least` has more survivors, whose exact counts then take more of the work, and calls for a
wider one; the result stays the same.

Defined results: null text is empty and has no words; a null language counts as `und`; very long texts are taken in
one piece of work each; ties end by phrase in byte order; repeated rows count each; an empty table gives an
empty table; other columns are not read and can't clash with the result's. Within a task phrases meet by 64-bit
hashes, between tasks by their text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.textops import Words, lower_ascii, mix, small_batches, text_buffers, text_chunks, window_hashes
from weftline.session import materialize, temporary

LEAST, LONGEST, TOP = 30, 4, 2000
DEPTH, WIDTH = 3, 1 << 24
#: Counters are merged by slices of so many cells, after a first merge within each of so many groups of tasks.
SLICE, GROUPS = 1 << 16, 4
#: A task sends its exact counts on when it holds so many phrases, as lists by this many buckets of hashes; where
#: buckets meet, lists are added up whenever they hold so many phrases.
HELD, BUCKETS = 1 << 19, 1 << 10
SUBSUMED, SCALE = 80, 2_000_000

_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True


class Pieces:
    """The words of some texts, lower-cased, with the piece that each lies in."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        data, offsets = text_buffers(texts)
        self.data = lower_ascii(data)
        ends = _ENDS[data]
        self.words = Words(self.data, offsets, ~(ends | (data == 32) | (data == 9)))
        self.hashes = self.words.hashes()
        rows = self.words.rows()
        self.piece = np.cumsum(ends)[self.words.start] + rows if len(rows) else rows
        coded = langs.fill_null("und").dictionary_encode()
        self.langs = coded.dictionary.to_pylist()
        self.lang = coded.indices.to_numpy()[rows]
        seeds = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.langs]
        self.seed = np.array(seeds, np.uint64)[self.lang] if seeds else np.zeros(0, np.uint64)

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all runs of k words within a piece, and the runs' hashes."""
        if len(self.hashes) < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        first = np.flatnonzero(self.piece[k - 1 :] == self.piece[: len(self.piece) - k + 1])
        hashes = window_hashes(self.hashes, k)[first] if k > 1 else self.hashes[first]
        return first, mix(hashes ^ self.seed[first])

    def phrase(self, first: int, k: int, raw: bytes) -> str:
        return b" ".join(raw[self.words.start[first] : self.words.end[first + k - 1]].split()).decode()


def cells(hashes: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The cell of each hash in each row of a sketch."""
    for row in range(DEPTH):
        yield (mix(hashes + np.uint64(row)) & np.uint64(width - 1)).astype(np.uint32)


@dataclass(frozen=True)
class Survivors:
    """For each row of a sketch one bit a cell: whether its merged counter reached the least count. The row after the last
    has the marked words."""

    width: int
    bits: list[np.ndarray]

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        alive = np.ones(len(hashes), bool)
        for bits, cell in zip(self.bits, cells(hashes, self.width)):
            alive &= is_set(bits, cell)
        return alive

    def marked(self, hashes: np.ndarray) -> np.ndarray:
        return is_set(self.bits[DEPTH], next(cells(hashes, self.width)))


def is_set(bits: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return (bits[cell >> np.uint32(3)] >> (cell & np.uint32(7)).astype(np.uint8)) & np.uint8(1) == 1


def good_pairs(pieces: Pieces, pairs: Survivors) -> np.ndarray:
    """For each word whether it and the next are a surviving pair."""
    first, hashes = pieces.runs(2)
    good = np.zeros(len(pieces.hashes), bool)
    good[first[pairs(hashes)]] = True
    return good


def surviving(pieces: Pieces, upto: int, good: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """k, first words and hashes of the runs of 1 or 2 words, or of 3 words and more whose pairs are all good."""
    if good is None:
        for k in (1, 2):
            yield k, *pieces.runs(k)
        return
    good = np.concatenate(([0], np.cumsum(good)))
    for k in range(3, upto + 1):
        first, hashes = pieces.runs(k)
        alive = good[first + k - 1] - good[first] == k - 1
        yield k, first[alive], hashes[alive]


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Pieces]:
    for batch in batches:
        langs, texts = batch.columns
        for lo, hi in text_chunks(texts):
            yield Pieces(langs.slice(lo, hi - lo), texts.slice(lo, hi - lo))


PART = "row int, slice int, cells binary, counts binary"
PART_NAMES = [x.split()[0] for x in PART.split(", ")]


def parts(row: int, at: int, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The cells of a slice that hold anything, and their counts."""
    cell = np.flatnonzero(counts)
    if len(cell):
        yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([at], pa.int32()), pa.array([cell.astype(np.uint16).tobytes()]), pa.array([counts[cell].tobytes()])], PART_NAMES)


def sketch(own: DataFrame, width: int, least: int, upto: int, pairs: Survivors | None) -> Survivors:
    """The survivors of a merged sketch of all runs of 1 and 2 words, or of longer ones given the pairs; then the words of
    surviving pairs are marked as well."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [np.zeros(width, np.uint8) for _ in range(DEPTH + 1)]
        for pieces in chunks(batches):
            good = None if pairs is None else good_pairs(pieces, pairs)
            for _, _, hashes in surviving(pieces, upto, good):
                for row, cell in zip(rows, cells(hashes, width)):
                    found, n = np.unique(cell, return_counts=True)
                    row[found] = np.minimum(row[found] + n, 255)
            if good is not None:
                of = good.copy()
                of[1:] |= good[:-1]
                first, hashes = pieces.runs(1)
                rows[DEPTH][next(cells(hashes[of[first]], width))] = 255
        for i, row in enumerate(rows):
            for at in range(0, width, SLICE):
                yield from parts(i, at // SLICE, row[at : at + SLICE])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by row and slice: adds up what they count, one slice at a time."""
        at, total = None, np.zeros(SLICE, np.uint8)
        for batch in batches:
            for row, part, cell, counts in zip(*(batch.column(name).to_pylist() for name in PART_NAMES)):
                if at != (row, part):
                    if at is not None:
                        yield from parts(*at, total)
                    at, total = (row, part), np.zeros(SLICE, np.uint8)
                cell = np.frombuffer(cell, np.uint16)
                total[cell] = np.minimum(total[cell] + np.frombuffer(counts, np.uint8).astype(np.uint16), 255)
        if at is not None:
            yield from parts(*at, total)

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in merge(batches):
            row, at = batch.column(0)[0].as_py(), batch.column(1)[0].as_py()
            cell, counts = np.frombuffer(batch.column(2)[0].as_py(), np.uint16), np.frombuffer(batch.column(3)[0].as_py(), np.uint8)
            on = np.zeros(SLICE, bool)
            on[cell[counts >= least]] = True
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([at], pa.int32()), pa.array([np.packbits(on, bitorder="little").tobytes()])], ["row", "slice", "bits"])

    made = own.mapInArrow(count, PART).withColumn("group", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    some = made.repartition("row", "slice", "group").sortWithinPartitions("row", "slice").mapInArrow(merge, PART)
    bits = [np.zeros(max(width, SLICE) // 8, np.uint8) for _ in range(DEPTH + 1)]
    # One bit a cell comes to the driver, whatever the corpus.
    for found in some.repartition("row", "slice").sortWithinPartitions("row", "slice").mapInArrow(reached, "row int, slice int, bits binary").collect():
        bits[found["row"]][found["slice"] * SLICE // 8 :][: SLICE // 8] = np.frombuffer(found["bits"], np.uint8)
    return Survivors(width, bits)


def exact(own: DataFrame, least: int, upto: int, pairs: Survivors, longer: Survivors) -> DataFrame:
    """lang, phrase, k, f of all phrases of 2 to `upto` words that occur `least` times and of their words, and rows with
    phrase null and the number of the language's words as f."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], dict[int, list]] = {}
        total: dict[str, int] = {}
        for pieces in chunks(batches):
            raw = pieces.data.tobytes()
            for lang, n in zip(pieces.langs, np.bincount(pieces.lang, minlength=len(pieces.langs)).tolist()):
                total[lang] = total.get(lang, 0) + n
            for good, alive in ((None, pairs), (good_pairs(pieces, pairs), longer)):
                for k, first, hashes in surviving(pieces, upto, good):
                    keep = alive(hashes) & longer.marked(hashes) if k == 1 else alive(hashes)
                    hashes, at, n = np.unique(hashes[keep], return_index=True, return_counts=True)
                    first = first[keep][at]
                    for lang, h, i, f in zip(pieces.lang[first].tolist(), hashes.tolist(), first.tolist(), n.tolist()):
                        own = held.setdefault((pieces.langs[lang], k), {})
                        seen = own.get(h)
                        if seen is None:
                            own[h] = [f, pieces.phrase(i, k, raw)]
                        else:
                            seen[0] += f
            if sum(map(len, held.values())) >= HELD:
                yield from in_buckets(held)
                held.clear()
        yield from in_buckets(held)
        words = [(lang, n) for lang, n in total.items() if n]
        if words:
            lang, n = zip(*words)
            yield bucket(0, lang, [None] * len(words), [0] * len(words), n)

    def bucket(at: int, *columns) -> pa.RecordBatch:
        lists = [pa.array([list(c)], pa.list_(kind)) for c, kind in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int64()))]
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), *lists], ["bucket", *NAMES])

    def in_buckets(held: dict[tuple[str, int], dict[int, list]]) -> Iterator[pa.RecordBatch]:
        rows = sorted((h * BUCKETS >> 64, lang, phrase, k, f) for (lang, k), found in held.items() for h, (f, phrase) in found.items())
        for at, some in groupby(rows, lambda r: r[0]):
            yield bucket(at, *list(zip(*some))[1:])

    def added(parts: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(parts).group_by(NAMES[:3]).aggregate([("f", "sum")]).rename_columns(NAMES)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by bucket: adds up one bucket at a time, and of it what has come so far, before it gets long."""
        at, parts, size = None, [], 0

        def done() -> list[pa.RecordBatch]:
            whole = added(parts)
            return whole.filter(pc.or_(pc.greater_equal(whole["f"], least), pc.is_null(whole["phrase"]))).combine_chunks().to_batches()

        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column(0)[i].as_py() != at:
                    if parts:
                        yield from done()
                    at, parts, size = batch.column(0)[i].as_py(), [], 0
                parts.append(pa.table([c.slice(i, 1).flatten() for c in batch.columns[1:]], NAMES))
                size += parts[-1].num_rows
                if size >= HELD:
                    parts = [added(parts)]
                    size = parts[0].num_rows // 2
        if parts:
            yield from done()

    lists = "bucket int, lang array<string>, phrase array<string>, k array<int>, f array<long>"
    return own.mapInArrow(run, lists).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(counted, "lang string, phrase string, k int, f long")


NAMES = ["lang", "phrase", "k", "f"]


def frequent(docs: DataFrame, least: int = LEAST, upto: int = LONGEST, text: str = "text", lang: str = "lang", width: int = WIDTH) -> DataFrame:
    """lang, phrase, k, f: exact counts of the phrases of 2 to `upto` words that occur `least` times or more and of the
    words in them, and one row a language with phrase null, k 0 and the number of its words. Words beyond these may
    be there by chance. width: cells in a row of a sketch, a power of two."""
    own = docs.select(F.col(lang).cast("string").alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    with small_batches(docs.sparkSession):
        pairs = sketch(own, width, least, upto, None)
        longer = sketch(own, width, least, upto, pairs)
        return materialize(exact(own, least, upto, pairs, longer), "frequent")


def scored(counts: DataFrame) -> DataFrame:
    """lang, phrase, k, a, l, r, score of all phrases of two words and more, by their weakest cut."""
    phrases = counts.filter("k >= 2").select("lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = phrases.select("lang", "phrase", "k", "a", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    head, tail = F.array_join(F.slice("w", 1, F.col("cut")), " "), F.array_join(F.slice("w", F.col("cut") + 1, F.col("k")), " ")
    part = lambda name, f: counts.filter("phrase IS NOT NULL").select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    both = cuts.select("lang", "phrase", "k", "a", "cut", head.alias("head"), tail.alias("tail")).join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"])
    score = F.expr(f"(CAST(a AS DECIMAL(20,0)) * CAST({SCALE} AS DECIMAL(8,0))) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    weakest = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("weakest")
    return both.groupBy("lang", "phrase", "k", "a").agg(weakest).select("lang", "phrase", "k", "a", "weakest.l", "weakest.r", "weakest.score")


def subsumed(counts: DataFrame, share: int = SUBSUMED) -> DataFrame:
    """lang, phrase of phrases that lie within a longer one which has `share` percent of their occurrences or more."""
    longer = counts.filter("k >= 3").select("lang", F.col("f").alias("whole"), F.split("phrase", " ").alias("w"), "k")
    sizes = longer.select("lang", "whole", "w", "k", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("n"))
    parts = sizes.select("lang", "whole", "w", "n", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("n") + 1)).alias("at"))
    largest = parts.groupBy("lang", F.array_join(F.slice("w", F.col("at"), F.col("n")), " ").alias("phrase")).agg(F.max("whole").alias("whole"))
    enough = F.expr(f"CAST(whole AS DECIMAL(20,0)) * 100 >= CAST(f AS DECIMAL(20,0)) * {share}")
    return counts.join(largest, ["lang", "phrase"]).filter(enough).select("lang", "phrase")


def collocations(docs: DataFrame, least: int = LEAST, upto: int = LONGEST, top: int = TOP, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of each language, by score, then by count, then by phrase."""
    with temporary(docs.sparkSession):
        counts = frequent(docs, least, upto, text, lang)
        kept = scored(counts).join(subsumed(counts), ["lang", "phrase"], "left_anti")
        # A language's phrases are ranked in shares first, so that no task gets all of them.
        order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
        share = F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order))
        best = kept.withColumn("rank", share).filter(F.col("rank") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
        total = counts.filter("phrase IS NULL").select("lang", F.col("f").alias("n"))
        done = best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
        return materialize(done, "collocations", keep=True)
