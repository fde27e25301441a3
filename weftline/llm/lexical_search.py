"""Ranked lexical search over a tiered index.

`build` cuts the documents into shards of bounded size and writes one row a shard: its terms, and for each
term its postings (document, impact) by falling impact, dealt over three tiers. A term's first tier holds the
eighth of its postings with the highest impact, the second those up to a half, the third the rest; beside each
of the upper tiers stands the residual bound of every term, the highest impact that its lower tiers hold.

`search` takes the items in blocks. The first tiers of all shards alone give every item lower bounds of
scores; the tenth of them is the item's threshold. Then each shard settles each item: a document's score is at
most what its known postings give plus the residual bounds of the item's other terms. Where no document of
the shard can reach the threshold, the item is proven there; where that proof is lacking, it falls through
to the next tier, in the last of which scores are exact. The best of each shard meet by item.

Scores are integers (see `impact` and `weight`). Terms meet by 64-bit hashes.

Defined results: null and empty texts have no terms, documents without terms count in neither N nor L, and items
without terms find nothing; very long texts are taken whole; equal scores go by ascending doc_id, null first;
each row of the documents is one of its own, repeated ones too; repeated rows of an item are one item, while
unlike texts under one id are ranked each on its own; empty tables give an empty table; other columns are
dropped, and column names of the caller can't clash with those of the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from weftline.llm.textops import Words, lower_ascii, small_batches, text_buffers, text_chunks
from weftline.session import materialize, temporary

BEST = 10
#: A shard's texts have so many bytes at most, or it is one text; its rows are those of an Arrow batch at most.
SHARD_BYTES = 2_000_000
#: Upper tiers hold a term's postings up to these shares.
SHARES = (1 / 8, 1 / 2)
TIERS = len(SHARES) + 1
#: Items are searched for in blocks of so many, or of so many bytes of text.
BLOCK_ITEMS, BLOCK_BYTES = 512, 2_000_000
#: So many shards are read at once.
SHARDS = 8
LEAST = np.iinfo(np.int64).min

_TERM = np.zeros(256, bool)
_TERM[0x30:0x3A] = _TERM[0x41:0x5B] = _TERM[0x61:0x7B] = _TERM[0x80:] = True


def terms(texts: pa.Array) -> Words:
    """The terms of texts: runs of letters and digits of ASCII and of all characters beyond it, A-Z lower-cased."""
    data, offsets = text_buffers(texts)
    return Words(lower_ascii(data), offsets, _TERM[data])


def impact(tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """A posting's part of the score before the term's weight, from 0 to 1,000,000."""
    m = 25 + 75 * n * docs // total
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


@dataclass(frozen=True)
class Query:
    """A block of items: terms (sorted hashes) of all, and for each item the places and numbers of its own."""

    terms: np.ndarray
    places: list[np.ndarray]
    times: list[np.ndarray]
    weights: np.ndarray | None = None

    @staticmethod
    def of(texts: list[str | None]) -> Query:
        found = terms(pa.array(texts, pa.string()))
        hashes = found.hashes()
        every, place = np.unique(hashes, return_inverse=True)
        own = [np.unique(place[a:b], return_counts=True) for a, b in zip(found.first[:-1], found.first[1:])]
        return Query(every, [p for p, _ in own], [n for _, n in own])


UPPER = [f"{name}_{i} binary" for i in range(TIERS - 1) for name in ("first", "rows", "impacts", "rest")]
SHARD = ", ".join(["ids binary, terms binary, counts binary", *UPPER, f"first_{TIERS - 1} binary, rows_{TIERS - 1} binary, impacts_{TIERS - 1} binary"])
SHARD_NAMES = [x.split()[0] for x in SHARD.split(", ")]


def shard(ids: np.ndarray, found: Words, docs: int, total: int) -> dict[str, np.ndarray]:
    """The postings of some texts by tier, as arrays under the names of SHARD."""
    hashes, rows, n = found.hashes(), found.rows(), found.counts()
    order = np.argsort(hashes, kind="stable")
    hashes, rows = hashes[order], rows[order]
    begin = np.flatnonzero(np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])))[: len(hashes)])
    tf = np.diff(np.append(begin, len(hashes)))
    hashes, rows = hashes[begin], rows[begin]
    impacts = impact(tf, n[rows], docs, total)
    new = np.concatenate(([True], hashes[1:] != hashes[:-1]))[: len(hashes)]
    term = np.cumsum(new) - 1
    order = np.lexsort((-impacts, term))
    rows, impacts = rows[order].astype(np.int32), impacts[order].astype(np.int32)
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(hashes)))
    rank = np.arange(len(rows)) - start[term]
    ends = [np.ceil(count * share).astype(np.int64) for share in SHARES]
    tier = sum((rank >= end[term]).astype(np.int8) for end in ends) if len(rows) else np.zeros(0, np.int8)
    out = {"ids": ids, "terms": hashes[start], "counts": count.astype(np.int32)}
    for i in range(TIERS):
        mine = tier == i
        first = np.zeros(len(start) + 1, np.int32)
        np.cumsum(np.bincount(term[mine], minlength=len(start)), out=first[1:])
        out |= {f"first_{i}": first, f"rows_{i}": rows[mine], f"impacts_{i}": impacts[mine]}
        if i < TIERS - 1:
            below = start + ends[i]
            out[f"rest_{i}"] = np.where(ends[i] < count, impacts[np.minimum(below, len(rows) - 1)], 0).astype(np.int32) if len(rows) else np.zeros(0, np.int32)
    return out


class Shard:
    """One row of the index, read back for a block of items."""

    KINDS = {"ids": np.int64, "terms": np.uint64}

    def __init__(self, row: dict[str, bytes], query: Query):
        part = {name: np.frombuffer(data, self.KINDS.get(name, np.int32)) for name, data in row.items()}
        self.ids, self.part = part["ids"], part
        own = part["terms"]
        place = np.searchsorted(own, query.terms)
        there = place < len(own)
        there[there] = own[place[there]] == query.terms[there]
        self.place = np.where(there, place, -1)
        self.query = query

    def bounds(self, item: int, tier: int) -> tuple[np.ndarray, np.ndarray, int]:
        """For every document what the tiers down to this one give it; what its other terms can still add; what they can
        add to a document that was not seen."""
        place = self.place[self.query.places[item]]
        gain = (self.query.times[item] * self.query.weights[self.query.places[item]])[place >= 0]
        place = place[place >= 0]
        last = tier == TIERS - 1
        rest = np.zeros(len(place), np.int64) if last else self.part[f"rest_{tier}"][place] * gain
        score, covered = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), np.int64)
        for i in range(tier + 1):
            first, rows, impacts = (self.part[f"{name}_{i}"] for name in ("first", "rows", "impacts"))
            lo, n = first[place], first[place + 1] - first[place]
            of = np.repeat(np.arange(len(place)), n)
            at = np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)
            np.add.at(score, rows[at], impacts[at] * gain[of])
            if not last:
                np.add.at(covered, rows[at], rest[of])
        unseen = int(rest.sum())
        return score, unseen - covered, unseen

    def settle(self, item: int, threshold: int, k: int) -> tuple[int, np.ndarray, np.ndarray]:
        """The tier that settled the item, and the documents of this shard that may be among its best, with their scores."""
        for tier in range(TIERS):
            score, more, _ = self.bounds(item, tier)
            able = score + more >= max(threshold, 1)
            if not able.any() or not more[able].any():
                break
        found = np.flatnonzero(able & (score > 0))
        order = np.lexsort((self.ids[found], -score[found]))[:k]
        return tier, found[order], score[found[order]]


@dataclass(frozen=True)
class Index:
    """table: one row a shard. docs and total: the documents with a term, and all their terms with repeats."""

    table: DataFrame
    docs: int
    total: int

    def weighed(self, query: Query) -> Query:
        """The query with its terms' weights. The counts of its own terms are collected, which the block bounds."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            df = np.zeros(len(query.terms), np.int64)
            for batch in batches:
                for row in batch.to_pylist():
                    own, counts = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["counts"], np.int32)
                    place = np.minimum(np.searchsorted(own, query.terms), max(len(own) - 1, 0))
                    if len(own):
                        df += np.where(own[place] == query.terms, counts[place], 0)
            some = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["place", "df"])

        counted = self.table.select("terms", "counts").mapInArrow(run, "place long, df long").groupBy("place").agg(F.sum("df").alias("df"))
        df = np.zeros(len(query.terms), np.int64)
        for row in counted.collect():
            df[row["place"]] = row["df"]
        return replace(query, weights=np.array([weight(self.docs, int(x)) for x in df], np.int64))

    def thresholds(self, query: Query, k: int) -> np.ndarray:
        """For each item the k-th best lower bound that the first tiers give, 0 if they see fewer documents."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = np.zeros((len(query.places), k), np.int64)
            for batch in batches:
                for row in batch.to_pylist():
                    own = Shard(row, query)
                    for item in range(len(best)):
                        score, _, _ = own.bounds(item, 0)
                        best[item] = np.partition(np.concatenate((best[item], score)), len(score))[-k:]
            item, at = np.nonzero(best)
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(best[item, at])], ["item", "bound"])

        first = self.table.select("ids", "terms", "first_0", "rows_0", "impacts_0", "rest_0")
        ranked = first.mapInArrow(run, "item long, bound long").withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"))))
        out = np.zeros(len(query.places), np.int64)
        for row in ranked.filter(F.col("place") == k).collect():
            out[row["item"]] = row["bound"]
        return out

    def settled(self, query: Query, thresholds: np.ndarray, k: int) -> DataFrame:
        """item, doc_id, score, tier: what each partition has of each item's best; tier is the one that settled it there."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: list[list[tuple[int, int, int]]] = [[] for _ in query.places]
            for batch in batches:
                for row in batch.to_pylist():
                    own = Shard(row, query)
                    for item, found in enumerate(best):
                        tier, at, scores = own.settle(item, int(thresholds[item]), k)
                        if len(at):
                            found += zip((-scores).tolist(), own.ids[at].tolist(), [tier] * len(at))
                            found.sort()
                            del found[k:]
            rows = [(item, doc, -score, tier) for item, found in enumerate(best) for score, doc, tier in found]
            item, doc, score, tier = zip(*rows) if rows else ([],) * 4
            doc = np.array(doc, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc, mask=doc == LEAST), pa.array(score, pa.int64()), pa.array(tier, pa.int32())], ["item", "doc_id", "score", "tier"])

        return self.table.mapInArrow(run, "item long, doc_id long, score long, tier int")

    def search(self, items: DataFrame, k: int = BEST, text: str = "text", key: str = "item_id") -> DataFrame:
        """item_id, rank, doc_id, score and tier: each item's k best documents, and the tier that settled them."""
        spark = items.sparkSession
        kind = items.schema[key].dataType.simpleString()
        blocks = []
        for ids, texts in item_blocks(items.select(F.col(key).alias("item_id"), F.col(text).alias("text")).distinct()):
            query = Query.of(texts)
            if not len(query.terms) or not self.docs:
                continue
            named = spark.createDataFrame([Row(item=i, item_id=x) for i, x in enumerate(ids)], f"item long, item_id {kind}")
            by_rank = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
            with small_batches(spark, SHARDS):
                query = self.weighed(query)
                found = self.settled(query, self.thresholds(query, k), k)
                ranked = found.withColumn("rank", F.row_number().over(by_rank)).filter(F.col("rank") <= k)
                block = ranked.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score", "tier")
                blocks.append(materialize(block, "ranked", keep=True))
        out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long, tier int")
        for block in blocks:
            out = out.unionByName(block)
        return out


def item_blocks(items: DataFrame) -> Iterator[tuple[list, list[str | None]]]:
    """Ids and texts of the items, a block at a time; the driver holds one block and one partition of the items."""
    ids, texts, size = [], [], 0
    for row in items.toLocalIterator():
        if ids and (len(ids) == BLOCK_ITEMS or size + len(row["text"] or "") > BLOCK_BYTES):
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row["item_id"])
        texts.append(row["text"])
        size += len(row["text"] or "")
    if ids:
        yield ids, texts


def build(docs: DataFrame, text: str = "text", key: str = "doc_id") -> Index:
    """The tiered index of all documents."""
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, total = 0, 0
        for batch in batches:
            for lo, hi in text_chunks(batch.column(0)):
                n = terms(batch.column(0).slice(lo, hi - lo)).counts()
                docs, total = docs + int((n > 0).sum()), total + int(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array([docs]), pa.array([total])], ["docs", "total"])

    with small_batches(docs.sparkSession):
        sums = own.select("text").mapInArrow(count, "docs long, total long").agg(F.sum("docs").alias("docs"), F.sum("total").alias("total")).first()
        docs_n, total = sums["docs"] or 0, sums["total"] or 0

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, hi in text_chunks(batch.column(1), SHARD_BYTES):
                    ids, texts = batch.slice(lo, hi - lo).columns
                    found = terms(texts)
                    if len(found):
                        made = shard((ids.fill_null(LEAST) if ids.null_count else ids).to_numpy().astype(np.int64), found, docs_n, total)
                        yield pa.RecordBatch.from_arrays([pa.array([made[name].tobytes()], pa.binary()) for name in SHARD_NAMES], SHARD_NAMES)

        return Index(materialize(own.mapInArrow(run, SHARD), "index"), docs_n, total)


def ranked(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """item_id, rank, doc_id, score, tier: the index is built, searched and deleted."""
    with temporary(docs.sparkSession):
        return build(docs).search(items, k)
