"""N-gram Jaccard join by grouped prefixes.

A document is its set of distinct K-word shingles; two link from a Jaccard similarity of
THRESHOLD percent. All sets are sorted by one order of the shingles, the frequent ones last. Sets
that link share a shingle among the first n - ceil(THRESHOLD% of n) + 1 of each, the prefixes.

1. Documents with equal sets are one class, classes with identical prefixes and sizes one group.
   Just groups take part in the prefix join, with one row for each shingle of the prefix.
2. In each bucket, the groups that share a shingle, every group meets the first of its size; in
   each group every class meets the group's first. Of a group's pairs the one met in most buckets is
   verified first, the others if that leaves them in different components. These pairs are few and
   join what is alike into components.
3. What a large bucket still holds in different components is compared by way of a pivot, the member that
   has the least of its own. A set is near the pivot from a similarity of 2 THRESHOLD - 100 percent. By the
   triangle inequality one that isn't can't link to one that links to the pivot. Two near ones share
   all of the pivot but what either has lost, and what both have gained: unless both link to the pivot,
   they link only if they share enough of what they have lost or gained. That is a prefix join on
   these differences, which edits in different places don't share.
4. All other pairs of a bucket's classes that no component joins as yet, and that have enough
   shingles from the shared one on, are verified as well.

A pair is verified by its sketches first, counts of shingles by parts of the hash space, which bound
what two sets can share, and then by the sets.

So no link between different components is missed, while a bucket of thousands of near copies
costs as many comparisons as it has members and not their square.

Defined results: null text counts as empty; a document without words is its own component and
links with nothing; one of fewer than K words has one shingle, all its words; very long
texts are taken whole; repeated rows and equal texts share a component; texts that share a doc_id
count as one document that links as any of them does and has the size of the largest; documents with null doc_id are told apart by their texts, link
like others and are left out of component ids, which are null where no linked document has a
doc_id; an empty table gives an empty table; other columns pass through, those named as the
results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.components import components
from weftline.llm.textops import Words, bounded, lower_ascii, mix, others, range_hash, signed, text_buffers, text_chunks, whole_windows, window_hashes
from weftline.session import materialize, temporary

K, THRESHOLD = 5, 75
#: Shingles in this many different texts of one chunk count as frequent; at most so many are told apart.
FREQUENT, FREQUENT_MOST = 4, 1 << 17
#: Up to so many ids (16 MB) are broadcast to fetch their texts; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Buckets of so many classes are compared by way of a pivot; in smaller ones all pairs are no more.
PIVOT_FROM = 16


def shingle_sets(texts: pa.Array, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, and the number of each row's."""
    data, offsets = text_buffers(texts)
    words = Words(lower_ascii(data), offsets)
    hashes = words.hashes()
    counts = words.counts()
    sizes = np.where(counts > 0, np.maximum(counts - k + 1, 1), 0)
    ends = np.cumsum(sizes)
    whole = np.empty(int(sizes.sum()), np.uint64)
    few = (counts > 0) & (counts < k)
    longer = np.repeat(~few, sizes)
    whole[longer] = window_hashes(hashes, k)[whole_windows(words.first, k)]
    whole[ends[few] - 1] = range_hash(hashes, words.first[:-1][few], words.first[1:][few])
    for a, b in zip((ends - sizes).tolist(), ends.tolist()):
        whole[a:b].sort()
    new = np.ones(len(whole), bool)
    new[1:] = whole[1:] != whole[:-1]
    new[(ends - sizes)[sizes > 0]] = True
    kept = np.concatenate(([0], np.cumsum(new)))
    return whole[new], kept[ends] - kept[ends - sizes]


def prefix_size(n, threshold: int):
    return n - (-(-threshold * n // 100)) + 1


def row_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def prefixes(tokens: np.ndarray, counts: np.ndarray, frequent: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows' prefixes, frequent shingles last, and the number of each row's."""
    chosen, place, sizes = placed_prefixes(tokens, counts, frequent, threshold)
    return chosen, sizes


def placed_prefixes(tokens: np.ndarray, counts: np.ndarray, frequent: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same with the place of each shingle in its row's order."""
    ends = np.cumsum(counts)
    rows = np.repeat(np.arange(len(counts)), counts)
    late = np.zeros(len(tokens), bool)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        late = frequent[at] == tokens
    n_rare = np.bincount(rows[~late], minlength=len(counts))
    before = np.cumsum(late) - late  # late ones before this
    place = np.arange(len(tokens)) - np.repeat(ends - counts, counts)
    late_before = before - np.repeat((np.concatenate(([0], np.cumsum(late))))[ends - counts], counts)
    rank = np.where(late, n_rare[rows] + late_before, place - late_before)
    sizes = np.where(counts > 0, prefix_size(counts, threshold), 0)
    use = rank < sizes[rows]
    return tokens[use], rank[use], sizes


def sketches(tokens: np.ndarray, counts: np.ndarray) -> pa.Array:
    """For each row how many of its shingles fall into each of 2^j cells of the hash space, one byte
    a cell, one to two shingles a cell on average."""
    bits = np.maximum(np.ceil(np.log2(np.maximum(counts, 1) / 2)), 3).astype(np.uint64)
    ends = np.cumsum(np.int64(1) << bits.astype(np.int64))
    begins = np.concatenate(([0], ends[:-1])).astype(np.int64) if len(ends) else ends
    cell = np.repeat(begins, counts) + (tokens >> np.repeat(np.uint64(64) - bits, counts)).astype(np.int64)
    filled = np.minimum(np.bincount(cell, minlength=int(ends[-1]) if len(ends) else 0), 255).astype(np.uint8)
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(filled.tobytes())])


def most_shared(x: bytes, y: bytes) -> int | None:
    """No two sets of these sketches share more; None if a cell is too full to tell."""
    a, b = np.frombuffer(x, np.uint8).astype(np.int64), np.frombuffer(y, np.uint8).astype(np.int64)
    if max(a.max(), b.max()) == 255:
        return None
    while len(a) > len(b):
        a = a.reshape(-1, 2).sum(1)
    while len(b) > len(a):
        b = b.reshape(-1, 2).sum(1)
    return int(np.minimum(a, b).sum())


def group_keys(prefix: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return mix(row_sums(mix(prefix), sizes) + mix(counts.astype(np.uint64)))


def frequent_shingles(docs: DataFrame, k: int = K) -> np.ndarray:
    """The most frequent shingles, at most FREQUENT_MOST: a bounded list that only steers the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            for lo, hi in text_chunks(texts):
                tokens, counts = shingle_sets(texts.slice(lo, hi - lo), k)
                # A text counts once however many copies of it there are.
                keys = row_sums(mix(tokens), counts)
                once = np.zeros(len(counts), bool)
                once[np.unique(keys, return_index=True)[1]] = True
                found, times = np.unique(tokens[np.repeat(once, counts)], return_counts=True)
                often = times >= FREQUENT
                yield pa.RecordBatch.from_arrays([pa.array(signed(found[often])), pa.array(times[often].astype(np.int64))], ["token", "times"])

    counted = docs.select("text").mapInArrow(run, "token long, times long").groupBy("token").agg(F.sum("times").alias("times"))
    top = counted.orderBy(F.desc("times"), "token").limit(FREQUENT_MOST).select("token").toArrow()
    return np.sort(top.column("token").to_numpy().view(np.uint64))


def signed_rows(docs: DataFrame, frequent: np.ndarray, threshold: int, k: int) -> DataFrame:
    """id, doc_id, n, two halves of the set's signature, group, sketch."""
    names = ["id", "doc_id", "n", "s1", "s2", "grp", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, numbers, texts = batch.columns
            for lo, hi in text_chunks(texts):
                tokens, counts = shingle_sets(texts.slice(lo, hi - lo), k)
                prefix, sizes = prefixes(tokens, counts, frequent, threshold)
                s1, s2 = row_sums(mix(tokens), counts), row_sums(mix(tokens + np.uint64(1)), counts)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), numbers.slice(lo, hi - lo), *[pa.array(signed(x)) for x in (counts.astype(np.int64), s1, s2, group_keys(prefix, sizes, counts))], sketches(tokens, counts)], names)

    return docs.select("id", "doc_id", "text").mapInArrow(run, "id long, doc_id long, n long, s1 long, s2 long, grp long, sketch binary")


def prefix_rows(docs: DataFrame, frequent: np.ndarray, threshold: int, k: int) -> DataFrame:
    """token, grp, n, pos: the prefix of each group, once for each batch of documents that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            seen: set[int] = set()
            for lo, hi in text_chunks(texts):
                tokens, counts = shingle_sets(texts.slice(lo, hi - lo), k)
                prefix, place, sizes = placed_prefixes(tokens, counts, frequent, threshold)
                groups = group_keys(prefix, sizes, counts)
                use = np.zeros(len(groups), bool)
                use[np.unique(groups, return_index=True)[1]] = True
                use &= np.array([g not in seen for g in groups.tolist()], bool) & (counts > 0)
                seen.update(groups[use].tolist())
                each = np.repeat(use, sizes)
                cols = signed(prefix[each]), signed(np.repeat(groups, sizes)[each]), np.repeat(counts, sizes)[each].astype(np.int32), place[each].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["token", "grp", "n", "pos"])

    return docs.select("text").mapInArrow(run, "token long, grp long, n int, pos int")


def buckets(rows: DataFrame, threshold: int) -> DataFrame:
    """token, grp, n, pos, with_grp, with_n, with_pos for all groups that share a token with others. A bucket's
    groups are dealt by size, in steps as wide as a link allows, and stand in an order of their own
    in each bucket. Every group is to meet the first of its step, and that one the first of the
    step before; null for the bucket's first."""
    names = ["token", "grp", "n", "pos", "with_grp", "with_n", "with_pos"]

    def made(rows_: list[np.ndarray]) -> pa.RecordBatch:
        other = [pa.array(w, mask=rows_[11]) for w in rows_[8:11]]
        return pa.RecordBatch.from_arrays([*map(pa.array, rows_[:4]), *other], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last row of a batch waits for the next one: (token, grp, n, pos, step), its step's first
        # (grp, n, pos), whom it is to meet (grp, n, pos), and whether it is its token's first.
        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows_ = [batch.column(i).to_numpy().astype(np.int64) for i in range(5)]
            if held is not None:
                rows_ = [np.concatenate((h, x)) for h, x in zip(held, rows_)]
            new = np.ones(len(rows_[0]), bool)
            new[1:] = (np.diff(rows_[0]) != 0) | (np.diff(rows_[1]) != 0)
            token, grp, n, pos, step = (x[new] for x in rows_)
            start, first = np.ones(len(token), bool), np.ones(len(token), bool)
            start[1:] = token[1:] != token[:-1]
            first[1:] = start[1:] | (step[1:] != step[:-1])
            begin = np.maximum.accumulate(np.where(first, np.arange(len(token)), 0))
            firsts = [x[begin] for x in (grp, n, pos)]
            if held is not None:
                firsts = [np.where(begin == 0, h, x) for h, x in zip(held[5:8], firsts)]
            met_ = [np.where(first, np.append(f[:1], f[:-1]), f) for f in firsts]
            if held is not None:
                for x, h in zip([*met_, start], held[8:]):
                    x[0] = h[0]
            rows_ = [token, grp, n, pos, step, *firsts, *met_, start]
            held = [x[-1:] for x in rows_]
            met = ~(start[:-1] & start[1:])
            if met.any():
                yield made([x[:-1][met] for x in rows_])
        if held is not None and not held[11][0]:
            yield made(held)

    step = F.floor(F.log("n") / F.lit(np.log(100 / threshold))).alias("step")
    dealt = rows.repartition("token").select("token", "grp", "n", "pos", step, F.xxhash64("token", "grp").alias("place"))
    ordered = dealt.sortWithinPartitions("token", "step", "place", "grp").select("token", "grp", "n", "pos", "step")
    return ordered.mapInArrow(run, ", ".join(f"{x} long" for x in names))


def in_reach(n: Column, pos: Column, m: Column, at: Column, threshold: int) -> Column:
    """Whether sets of n and m shingles may link, the first that they share standing at these
    places of theirs: all others that they share come after it in both."""
    return F.lit(100 + threshold) * F.least(n - pos, m - at) >= F.lit(threshold) * (n + m)


def compared(docs: DataFrame, classes: DataFrame, candidates: DataFrame, threshold: int, k: int) -> DataFrame:
    """a, b, ta, tb: the candidates and their sets, but for those whose sketches rule out a similarity of
    threshold percent. Just the texts of the others are turned into sets."""

    @F.arrow_udf("boolean")
    def may_link(n: pa.Array, m: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
        most = (most_shared(*pair) for pair in zip(x.to_pylist(), y.to_pylist()))
        sizes = (n.to_numpy() + m.to_numpy()).tolist()
        return pa.array([shared is None or (100 + threshold) * shared >= threshold * size for shared, size in zip(most, sizes)], pa.bool_())

    side = lambda name: classes.select(F.col("class").alias(name), F.col("n").alias(f"n_{name}"), F.col("sketch").alias(f"sketch_{name}"))
    possible = candidates.join(side("a"), "a").join(side("b"), "b").filter(may_link("n_a", "n_b", "sketch_a", "sketch_b"))
    pairs = materialize(possible.select("a", "b").distinct(), "pairs")
    ids = materialize(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "ids")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = batch.columns
            for lo, hi in text_chunks(texts):
                found, counts = shingle_sets(texts.slice(lo, hi - lo), k)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(signed(found)))
                yield pa.RecordBatch.from_arrays([names.slice(lo, hi - lo), lists], ["id", "tokens"])

    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    chosen = docs.select("id", "text").join(F.broadcast(ids) if few else ids, "id", "left_semi")
    sets = materialize(chosen.mapInArrow(tokens, "id long, tokens array<long>"), "tokens")
    left = sets.select(F.col("id").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("id").alias("b"), F.col("tokens").alias("tb"))
    return pairs.join(left, "a").join(right, "b")


def verified(docs: DataFrame, classes: DataFrame, candidates: DataFrame, threshold: int, k: int) -> DataFrame:
    """The (a, b) of candidates whose sets link, by their full intersection."""
    with temporary(docs.sparkSession):
        found = compared(docs, classes, candidates, threshold, k)
        sized = found.select("a", "b", (F.size("ta") + F.size("tb")).alias("n"), F.size(F.array_intersect("ta", "tb")).alias("shared"))
        return materialize(sized.filter((100 + threshold) * F.col("shared") >= threshold * F.col("n")).select("a", "b").distinct(), "links", keep=True)


def differences(docs: DataFrame, classes: DataFrame, candidates: DataFrame, threshold: int, k: int) -> DataFrame:
    """a, b, size, gained, lost for the candidates of at least that similarity: the size of b's set,
    and the shingles of a that b lacks and those of b that a lacks."""
    with temporary(docs.sparkSession):
        found = compared(docs, classes, candidates, threshold, k)
        sides = found.select("a", "b", F.size("ta").alias("n"), F.size("tb").alias("size"), F.array_except("ta", "tb").alias("gained"), F.array_except("tb", "ta").alias("lost"))
        enough = 100 * (F.col("size") - F.size("lost")) >= threshold * (F.col("n") + F.size("lost"))
        return materialize(sides.filter(enough).select("a", "b", F.col("size").cast("long"), "gained", "lost"), "differences", keep=True)


def apart(pairs: DataFrame, placed: DataFrame) -> DataFrame:
    """The (a, b) of pairs that lie in different components, once each."""
    label = lambda name: placed.select(F.col("class").alias(name), F.col("label").alias(f"of_{name}"))
    return pairs.join(label("a"), "a").join(label("b"), "b").filter("of_a <> of_b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def united(placed: DataFrame, links: DataFrame) -> DataFrame:
    """placed with the labels after links have joined components."""
    label = lambda name: placed.select(F.col("class").alias(name), F.col("label").alias(f"of_{name}"))
    edges = links.join(label("a"), "a").join(label("b"), "b").filter("of_a <> of_b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    edges = materialize(edges.distinct(), "joins")
    if edges.isEmpty():
        return placed
    new = components(edges).select(F.col("id").alias("label"), F.col("label").alias("__new"))
    return materialize(placed.join(new, "label", "left").select("class", "grp", "n", F.coalesce("__new", "label").alias("label")), "placed")


def row_id(text: Column, key: Column) -> Column:
    """The doc_id, or without one a number of the text's own, so that unlike texts stay apart."""
    return F.coalesce(key.cast("long"), F.xxhash64(F.lit("no doc_id"), F.coalesce(text, F.lit(""))))


def join_classes(docs: DataFrame, threshold: int = THRESHOLD, k: int = K, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(id, n, class) of every document with words, and of every class its component's first id, a
    doc_id if it has any, and smallest doc_id."""
    own = bounded(docs).select(row_id(F.col(text), F.col(key)).alias("id"), F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    frequent = frequent_shingles(own, k)
    rows = materialize(signed_rows(own, frequent, threshold, k), "sets")
    twice = not rows.groupBy("id").agg(F.min("s1").alias("lo"), F.max("s1").alias("hi")).filter("lo <> hi").isEmpty()
    shared = materialize(buckets(prefix_rows(own, frequent, threshold, k), threshold), "buckets")
    of_set = ["n", "s1", "s2"]
    classes = rows.filter("n > 0").groupBy(*of_set).agg(F.min("id").alias("class"), F.min("doc_id").alias("doc_id"), F.first("grp").alias("grp"), F.first("sketch").alias("sketch"))
    classes = materialize(classes, "classes")
    groups = materialize(classes.groupBy("grp").agg(F.min("class").alias("head"), F.count("*").alias("classes")), "groups")

    # Each group with its firsts; each class with its group's first.
    heads = groups.select("grp", "head")
    met = shared.filter(F.col("with_grp").isNotNull() & in_reach(F.col("n"), F.col("pos"), F.col("with_n"), F.col("with_pos"), threshold))
    met = met.groupBy("grp", "with_grp").agg(F.count("*").alias("times"))
    between = met.join(heads.withColumnRenamed("head", "a"), "grp").join(heads.select(F.col("grp").alias("with_grp"), F.col("head").alias("b")), "with_grp")
    between = materialize(between.filter("a <> b").select("a", "b", "times"), "met")
    inside = classes.join(groups.filter("classes > 1").select("grp", "head"), "grp").filter("class <> head").select(F.col("class").alias("a"), F.col("head").alias("b"))
    # A group meets the first that it meets in most buckets, and the others only where that joined nothing.
    likeliest = between.groupBy("a").agg(F.max_by("b", F.struct("times", -F.col("b"))).alias("b"))
    placed = materialize(classes.select("class", "grp", "n", F.col("class").alias("label")), "placed")
    placed = united(placed, verified(own, classes, likeliest.unionByName(inside), threshold, k))
    placed = united(placed, verified(own, classes, apart(between.select("a", "b"), placed), threshold, k))

    # Pairs in different components that share a bucket, by way of the bucket's pivot.
    whole = groups.filter("classes > 1").select(F.col("grp").alias("token"), "grp", F.lit(0).cast("long").alias("pos"))
    members = shared.select("token", "grp", "pos").unionByName(whole)
    mixed = materialize(in_mixed_buckets(members, placed), "mixed")
    # The fewer rare shingles come before its first shared one, the less of its own a set has.
    own_part = mixed.groupBy("class").agg(F.min("pos").alias("own"), (-F.count("*")).alias("less"))
    first = F.min_by(F.struct("class", "n"), F.struct("own", "less", "class")).alias("p")
    large = mixed.join(own_part, "class").groupBy("token").agg(first, F.count("*").alias("members")).filter(F.col("members") >= PIVOT_FROM)
    pivots = materialize(large.select("token", F.col("p.class").alias("pivot"), F.col("p.n").alias("m")), "pivots")
    near = max(2 * threshold - 100, 0)
    alike = 100 * F.least("n", "m") >= near * F.greatest("n", "m")
    beside = mixed.join(pivots, "token").filter((F.col("class") != F.col("pivot")) & alike)
    close = differences(own, classes, beside.select(F.col("class").alias("a"), F.col("pivot").alias("b")).distinct(), near, k)
    close = weighed(close.select(F.col("a").alias("class"), F.col("b").alias("pivot"), "size", "gained", "lost"), threshold)
    placed = united(placed, close.filter("weight <= slack").select(F.col("class").alias("a"), F.col("pivot").alias("b")))
    centred = materialize(weighed(recentred(close), threshold), "centred")
    least = centred.groupBy("pivot").agg(F.min(F.struct("weight", "class")).alias("least")).select("pivot", F.col("least.weight").alias("least"), F.col("least.class").alias("b"))
    centred = centred.join(least, "pivot")
    placed = united(placed, centred.filter("class <> b AND weight + least <= slack").select(F.col("class").alias("a"), "b"))
    placed = united(placed, verified(own, classes, changed_alike(centred, placed, threshold), threshold, k))

    # All others, found at the first shingle that they share. rank: 2 links to the pivot, 1 is near it, 0 isn't.
    rank = F.when(F.col("class") == F.col("pivot"), 2).when(F.col("weight").isNull(), 0).when(F.col("weight") <= F.col("slack"), 2).otherwise(1)
    ranked = in_mixed_buckets(members, placed).join(pivots.select("token", "pivot"), "token", "left").join(close.select("class", "pivot", "weight", "slack"), ["class", "pivot"], "left")
    left = materialize(ranked.select("token", "class", "n", "pos", "label", rank.alias("rank")), "ranked")
    right = left.select("token", F.col("class").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("at"), F.col("label").alias("other"), F.col("rank").alias("of_b"))
    open_ = (F.col("label") < F.col("other")) & (F.col("rank") + F.col("of_b") <= 1)
    crossing = left.join(right, "token").filter(open_ & in_reach(F.col("n"), F.col("pos"), F.col("nb"), F.col("at"), threshold))
    crossing = crossing.select(F.col("class").alias("a"), "b").distinct()
    placed = united(placed, verified(own, classes, crossing, threshold, k))

    members = rows.filter("n > 0").join(classes.select(*of_set, "class"), of_set).select("id", "n", "class")
    if twice:
        placed = united(placed, of_one_id(members))
    labels = placed.select("class", "label").distinct().join(classes.groupBy("class").agg(F.min("doc_id").alias("doc_id")), "class")
    smallest = labels.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return members, labels.join(smallest, "label").select("class", F.coalesce("component_id", "label").alias("first"), "component_id").distinct()


def in_mixed_buckets(members: DataFrame, placed: DataFrame) -> DataFrame:
    """token, class, n, pos, label of the buckets that hold more than one component."""
    found = members.join(placed, "grp").select("token", "class", "n", "pos", "label")
    mixed = found.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("token")
    return found.join(mixed, "token", "left_semi")


def weighed(close: DataFrame, threshold: int) -> DataFrame:
    """close plus weight and slack: two sets that share no change link if their weights' sum is within the slack."""
    weight = 100 * F.size("lost") + threshold * F.size("gained")
    return close.withColumns({"weight": weight.cast("long"), "slack": ((100 - threshold) * F.col("size")).cast("long")})


def recentred(close: DataFrame) -> DataFrame:
    """The pivot and what is near it by their changes against the shingles that most of them have, so that
    a pivot's own peculiarities aren't changes that all others share."""
    count = close.groupBy("pivot").agg((F.count("*") + 1).alias("members"))

    def most(column: str) -> DataFrame:
        each = close.select("pivot", F.explode(column).alias("shingle")).groupBy("pivot", "shingle").agg(F.count("*").alias("times"))
        return each.join(count, "pivot").filter("2 * times > members").groupBy("pivot").agg(F.collect_list("shingle").alias(f"most_{column}"))

    none = F.array().cast("array<long>")
    common = count.join(most("gained"), "pivot", "left").join(most("lost"), "pivot", "left").select("pivot", F.coalesce("most_gained", none).alias("g"), F.coalesce("most_lost", none).alias("l"))
    itself = close.groupBy("pivot").agg(F.first("size").alias("size")).select(F.col("pivot").alias("class"), "pivot", "size", none.alias("gained"), none.alias("lost"))
    rows = close.select("class", "pivot", "size", "gained", "lost").unionByName(itself).join(common, "pivot")
    swap = lambda own, mine, other, theirs: F.array_sort(F.array_union(F.array_except(own, mine), F.array_except(theirs, other)))
    return rows.select("class", "pivot", (F.col("size") + F.size("g") - F.size("l")).alias("size"), swap("gained", "g", "lost", "l").alias("gained"), swap("lost", "l", "gained", "g").alias("lost"))


def changed_alike(centred: DataFrame, placed: DataFrame, threshold: int) -> DataFrame:
    """The (a, b) near one pivot, in different components, that may share enough of their changes. Sets
    that have lost M and M' of the centre's C shingles, and gained E and E', share at least
    (100 (M + M') + t (E + E') - (100 - t) C) / (100 + t) changes if they link at t percent."""
    labelled = centred.join(placed.select("class", "label").distinct(), "class").withColumn("changes", F.concat("gained", "lost"))
    spare = F.greatest(F.lit(1), F.ceil((F.col("weight") + F.col("least") - F.col("slack")) / (100 + threshold))).cast("int")
    count = F.size("changes")
    prefix = F.slice("changes", 1, F.greatest(F.lit(0), count - spare + 1))
    rows = labelled.select("pivot", "class", "label", "weight", "slack", count.alias("count"), F.posexplode(prefix).alias("pos", "change"))
    other = rows.select("pivot", "change", *[F.col(c).alias(f"{c}_b") for c in ("class", "label", "weight", "count", "pos")])
    rest = F.least(F.col("count") - F.col("pos"), F.col("count_b") - F.col("pos_b"))
    enough = (100 + threshold) * rest >= F.col("weight") + F.col("weight_b") - F.col("slack")
    found = rows.join(other, ["pivot", "change"]).filter((F.col("label") < F.col("label_b")) & enough)
    return found.select(F.col("class").alias("a"), F.col("class_b").alias("b")).distinct()


def of_one_id(members: DataFrame) -> DataFrame:
    """The (a, b) of classes that hold texts of one document."""
    found = members.groupBy("id").agg(F.min("class").alias("b"), F.max("class").alias("top")).filter("b <> top")
    return materialize(members.join(found, "id").filter("class <> b").select(F.col("class").alias("a"), "b").distinct(), "same")


def placed_rows(docs: DataFrame, threshold: int, k: int, text: str, key: str) -> DataFrame:
    """row_id, n, first and component of every document with words, once each."""
    with temporary(docs.sparkSession):
        members, labels = join_classes(docs, threshold, k, text, key)
        return materialize(first_of(members, labels), "near", keep=True)


def first_of(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels, "class").groupBy(F.col("id").alias("row_id")).agg(F.max("n").alias("n"), F.min("first").alias("first"), F.min("component_id").alias("component"))


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, k: int = K, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs plus n_shingles and component_id, the smallest doc_id reachable by links."""
    rows = docs.select(row_id(F.col(text), F.col(key)).alias("row_id"), F.col(key).cast("long").alias("number"), F.struct("*").alias("row"))
    joined = rows.join(placed_rows(docs, threshold, k, text, key), "row_id", "left")
    own = F.when(F.col("n").isNull(), F.col("number")).otherwise(F.col("component"))
    return joined.select(*others(docs, "n_shingles", "component_id", prefix="row."), F.coalesce("n", F.lit(0)).alias("n_shingles"), own.alias("component_id"))


def keep_first(docs: DataFrame, threshold: int = THRESHOLD, k: int = K) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, or one of those without
    any if the component has none; of repeated rows that differ in other columns, the one with the
    least digest; columns unchanged."""
    rows = docs.select(row_id(F.col("text"), F.col("doc_id")).alias("row_id"), F.struct("*").alias("row"))
    gone = placed_rows(docs.select("doc_id", "text"), threshold, k, "text", "doc_id").filter("first <> row_id").select("row_id")
    kept = rows.join(gone, "row_id", "left_anti")
    # Rows that share an id are few as a rule: just they are grouped with their texts.
    repeated = materialize(rows.groupBy("row_id").count().filter("count > 1").select("row_id"), "repeated")
    once = kept.join(repeated, "row_id", "left_anti").select("row")
    again = kept.join(repeated, "row_id", "left_semi").groupBy("row.doc_id", "row.text").agg(F.min_by("row", F.sha2(F.to_json("row"), 256)).alias("row"))
    return once.unionByName(again.select("row")).select(*others(docs, prefix="row."))
