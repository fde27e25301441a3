"""Removal of repeated strings by prefix-free parsing and suffix sorting of the dictionary.

Every string of WINDOW bytes that also starts in a document with a smaller doc_id is to go.

1. Parsing. A trigger is a string of TRIGGER bytes whose rolling hash is the least of some window. (By a hash
   modulo p alone some windows would have no trigger; so each has one, which depends on its bytes only.) A phrase
   is a run of windows with the same trigger, from the run's first byte to its last window's end, so that each
   window lies in one phrase, and equal windows lie in phrases with equal triggers.
2. Dictionary. The parse, a hash and a place for each phrase of each document, is sorted by trigger and phrase. Of
   equal phrases the first document's is the dictionary's; in documents with a larger id all their windows go
   at once, whatever their number. Where a trigger has one phrase, no other window can be equal.
3. Order. Where a trigger has several phrases, the suffixes of the dictionary's phrases are sorted, each down to
   WINDOW bytes; a phrase goes on to its last window's end, beyond the next trigger, so the order of the parse
   decides nothing further. Equal neighbours in that order are the equal windows, and those of the smallest
   document stay. The order of a phrase holds for each place it stands at, so the text itself is never sorted.

A trigger whose phrases hold more than GROUP_BYTES is split: its phrases are cut into their windows, which meet by
their own hashes. Equal phrases, and equal windows of split triggers, meet within a task first, where all but the
smallest document's are settled, so that a passage of a third of all documents is a row a task of one key. Long
texts are parsed in overlapping slices. Phrases are equal by two 64-bit hashes, of trigger and phrase; suffixes are
compared as bytes.

Defined results: null and empty texts have no bytes; texts of fewer than WINDOW bytes keep all; very long texts are
taken whole; repeated rows, and unlike texts that share a doc_id, remove nothing from each other and lose what
smaller ids hold; a null doc_id is smaller than all; an empty table gives an empty table; other columns pass through,
those named as the results are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.substring import LEAST, Firsts, earliest, numbers, same_row, sliding, told_apart
from weftline.llm.textops import byte_values, mix, others, range_hash, signed, small_batches, text_buffers, text_chunks, whole_windows, window_hashes, with_text
from weftline.session import materialize

WINDOW, TRIGGER = 50, 16
#: Long texts are parsed in slices of so many windows.
SLICE = 1_000_000
#: Phrases of one trigger are sorted together up to so many bytes; suffixes are sorted for so many bytes at once.
GROUP_BYTES, SORT_BYTES = 1_000_000, 250_000
#: A task remembers so many and up to twice as many phrases that it saw repeated.
KNOWN = 1 << 16
LOW = 0xFFFFFFFF


def slices(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """data, offsets, doc_id, sub and first byte's place of texts, in chunks; long texts in slices that overlap by a window less a byte."""
    for batch in batches:
        ids, subs, texts = batch.columns
        for lo, hi in text_chunks(texts):
            data, offsets = text_buffers(texts.slice(lo, hi - lo))
            doc, sub = numbers(ids.slice(lo, hi - lo)), numbers(subs.slice(lo, hi - lo))
            if len(data) <= SLICE + window:
                yield data, offsets, doc, sub, np.zeros(hi - lo, np.int64)
                continue
            for i in range(hi - lo):
                whole = data[offsets[i] : offsets[i + 1]]
                for at in range(0, max(len(whole) - window + 1, 1), SLICE):
                    part = whole[at : at + SLICE + window - 1]
                    yield part, np.array([0, len(part)]), doc[i : i + 1], sub[i : i + 1], np.array([at])


class Known:
    """The smallest documents of the phrases that a task saw repeated."""

    def __init__(self) -> None:
        self.key, self.doc = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def settled(self, key: np.ndarray, doc: np.ndarray, sub: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Which rows have an equal in a smaller document among these or those remembered."""
        first = doc[earliest(key, doc, sub, place)]
        gone = doc > first
        if len(self.key):
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            gone |= (self.key[at] == key) & (self.doc[at] < doc)
        again = doc > first
        self.add(key[again], first[again])
        return gone

    def add(self, key: np.ndarray, doc: np.ndarray) -> None:
        if not len(key):
            return
        if len(self.key) + len(key) > 2 * KNOWN:  # the older ones are forgotten: they settle less, nothing else changes
            self.key, self.doc = self.key[:0], self.doc[:0]
        keys, of = np.unique(np.concatenate((key, self.key)), return_inverse=True)
        least = np.full(len(keys), np.iinfo(np.int64).max)
        np.minimum.at(least, of, np.concatenate((doc, self.doc)))
        self.key, self.doc = keys, least


#: at: place and number of windows, in one number. trigger and phrase are null where the phrase is settled.
PHRASE = "trigger long, phrase long, doc_id long, sub long, at long"
NAMES = [x.split()[0] for x in PHRASE.split(", ")]


def ids_of(doc: np.ndarray) -> pa.Array:
    return pa.array(doc, mask=doc == LEAST)


def parse(own: DataFrame, window: int = WINDOW, trigger: int = TRIGGER) -> DataFrame:
    """The phrases of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known()
        for data, offsets, doc, sub, base in slices(batches, window):
            start = whole_windows(offsets, window)
            if not len(start):
                continue
            values = byte_values(data)
            least = sliding(np.minimum, window_hashes(values, trigger), window - trigger + 1)[start]
            row = np.repeat(np.arange(len(doc)), np.maximum(np.diff(offsets) - window + 1, 0))
            new = np.ones(len(start), bool)
            new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
            begin = np.flatnonzero(new)
            n = np.diff(np.append(begin, len(start)))
            start, row, mark = start[begin], row[begin], least[begin]
            phrase = range_hash(values, start, start + n - 1 + window)
            doc, sub, place = doc[row], sub[row], base[row] + start - offsets[row]
            gone = known.settled(phrase ^ mix(mark), doc, sub, place)
            yield pa.RecordBatch.from_arrays([pa.array(signed(mark), mask=gone), pa.array(signed(phrase), mask=gone), ids_of(doc), pa.array(sub), pa.array(place << 32 | n)], NAMES)

    return own.mapInArrow(run, PHRASE)


MARK = "doc_id long, sub long, at long, trigger long"


def dictionary(parsed: DataFrame) -> DataFrame:
    """doc_id, sub, at, trigger: phrases that a smaller document holds, with trigger null, and the dictionary's phrases that
    share their triggers with others."""
    names = [x.split()[0] for x in MARK.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, triggers = Firsts(), Firsts()
        pending: list[pa.RecordBatch] = []  # the dictionary's places of the only phrase so far of the trigger that the stream stands at
        shared = False  # whether that trigger has several
        for batch in batches:
            settled = batch.filter(batch.column(0).is_null())
            if settled.num_rows:
                yield pa.RecordBatch.from_arrays([*settled.columns[2:], settled.column(0)], names)
            batch = batch.filter(batch.column(0).is_valid())
            if not batch.num_rows:
                continue
            trigger, phrase = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            doc = numbers(batch.column(2))
            same_trigger, _ = triggers.origins([trigger], [])
            same_phrase, (first,) = phrases.origins([trigger, phrase], [doc])
            gone = doc > first
            group = np.cumsum(~same_trigger)  # group 0 goes on from the batch before
            several = np.bincount(group, ~same_phrase) >= 2
            if same_trigger[0]:
                several[0] = shared or (~same_phrase[group == 0]).any()
                if several[0]:
                    yield from pending
            check = ~gone & several[group]
            keep = gone | check
            marks = pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(trigger, mask=gone)], names)
            if keep.any():
                yield marks.filter(pa.array(keep))
            shared = bool(several[-1])
            if shared:
                pending = []
            else:
                held = marks.filter(pa.array(~gone & (group == group[-1])))
                pending = [*pending, held] if group[-1] == 0 else [held]

    # Settled phrases go anywhere, the others to their trigger.
    spread = F.coalesce("trigger", F.xxhash64("doc_id", "sub", "at"))
    return parsed.repartition(spread).sortWithinPartitions("trigger", "phrase", "doc_id", "sub", "at").mapInArrow(run, MARK)


#: places: all that the content stands at in the document. key and content are null where the content is settled.
SUFFIX = "key long, doc_id long, sub long, places array<long>, content binary"


def dictionary_texts(own: DataFrame, marks: DataFrame, window: int) -> DataFrame:
    """The dictionary's phrases with shared triggers: whole under their triggers, or cut into windows, under hashes of
    these, where the trigger's phrases are too many."""
    names = [x.split()[0] for x in SUFFIX.split(", ")]
    checks = marks.filter(F.col("trigger").isNotNull())
    sizes = checks.groupBy("trigger").agg(F.sum(F.col("at").bitwiseAND(LOW) + (window - 1)).alias("size"))
    split = checks.join(sizes, "trigger").select("doc_id", "sub", "at", "trigger", (F.col("size") > GROUP_BYTES).alias("split"))
    places = split.groupBy("doc_id", "sub").agg(F.collect_list(F.struct("at", "trigger", "split")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known()
        for batch in batches:
            row, trigger, place, contents = [], [], [], []
            parts: list[tuple[int, int, np.ndarray]] = []  # row, place and bytes of phrases to cut into windows
            size = 0
            for i in range(batch.num_rows):
                raw = np.frombuffer(batch.column(2)[i].as_buffer(), np.uint8)
                flat = batch.column(3).slice(i, 1).flatten()
                for at, of, cut in zip(*(flat.field(k).to_pylist() for k in range(3))):
                    p, n = at >> 32, at & LOW
                    if not cut:
                        row.append(i)
                        trigger.append(of)
                        place.append(at)
                        contents.append(raw[p : p + n + window - 1].tobytes())
                        continue
                    for lo in range(p, p + n, SORT_BYTES):
                        parts.append((i, lo, raw[lo : min(lo + SORT_BYTES, p + n) + window - 1]))
                        size += len(parts[-1][2])
                        if size >= SORT_BYTES:
                            yield from windows(batch, parts, known)
                            parts, size = [], 0
            if parts:
                yield from windows(batch, parts, known)
            if row:
                of = pa.array(row)
                lists = pa.ListArray.from_arrays(np.arange(len(row) + 1, dtype=np.int32), np.array(place))
                yield pa.RecordBatch.from_arrays([pa.array(trigger), batch.column(0).take(of), batch.column(1).take(of), lists, pa.array(contents, pa.binary())], names)

    def windows(batch: pa.RecordBatch, parts: list[tuple[int, int, np.ndarray]], known: Known) -> Iterator[pa.RecordBatch]:
        """A row for each distinct window of each document that is not settled, and one for each document's settled ones."""
        data = np.concatenate([part for _, _, part in parts])
        offsets = np.concatenate(([0], np.cumsum([len(part) for _, _, part in parts])))
        start = whole_windows(offsets, window)
        part = np.searchsorted(offsets, start, "right") - 1
        row, place = np.array([i for i, _, _ in parts])[part], np.array([p for _, p, _ in parts])[part] + start - offsets[part]
        hashes = window_hashes(byte_values(data), window)[start]
        order = np.lexsort((place, row, hashes))
        hashes, row, place, start = hashes[order], row[order], place[order], start[order]
        begin = np.flatnonzero(np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1]))))
        of = pa.array(row[begin])
        ids, subs = batch.column(0).take(of), batch.column(1).take(of)
        gone = known.settled(hashes[begin], numbers(ids), numbers(subs), place[begin])
        many = np.diff(np.append(begin, len(order)))
        settled, rest = np.repeat(gone, many), pa.array(np.flatnonzero(~gone))
        if settled.any():
            of_row, at = row[settled], place[settled]
            back = np.lexsort((at, of_row))
            of_row, at = of_row[back], at[back]
            new = np.ones(len(at), bool)
            new[1:] = (of_row[1:] != of_row[:-1]) | (at[1:] != at[:-1] + 1)
            first = np.flatnonzero(new)
            of_row, at = of_row[first], at[first] << 32 | np.diff(np.append(first, len(at)))
            docs = np.flatnonzero(np.concatenate(([True], of_row[1:] != of_row[:-1])))
            lists = pa.ListArray.from_arrays(np.append(docs, len(at)).astype(np.int32), at)
            of = pa.array(of_row[docs])
            yield pa.RecordBatch.from_arrays([pa.nulls(len(docs), pa.int64()), batch.column(0).take(of), batch.column(1).take(of), lists, pa.nulls(len(docs), pa.binary())], names)
        if len(rest):
            lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(many[~gone]))).astype(np.int32), place[~settled] << 32 | 1)
            contents = pa.array([data[i : i + window].tobytes() for i in start[begin][~gone].tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(signed(hashes[begin][~gone])), ids.take(rest), subs.take(rest), lists, contents], names)

    texts = own.alias("d").join(places.alias("p"), same_row("d", "p")).select("d.doc_id", "d.sub", "d.text", "p.places")
    return texts.mapInArrow(run, SUFFIX)


def suffix_order(contents: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The suffix array of some phrases down to `window` bytes: phrase and offset of each suffix in order, whether it
    equals the one before, and the number of suffixes of each phrase."""
    data = np.frombuffer(b"".join(contents), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(c) for c in contents])))
    start = whole_windows(offsets, window)
    n = np.maximum(np.diff(offsets) - window + 1, 0)
    row = np.repeat(np.arange(len(contents)), n)
    suffixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, window)[start]).view(f"S{window}").ravel()
    order = np.argsort(suffixes, kind="stable")
    ranked = suffixes[order]
    same = np.zeros(len(order), bool)
    same[1:] = ranked[1:] == ranked[:-1]
    return row[order], (start - offsets[row])[order], same, n


def repeated(found: DataFrame, window: int) -> DataFrame:
    """doc_id, sub, at of the windows of the dictionary's phrases that a smaller document holds. at: those of a content at
    all its places, so that a document that repeats itself has a row for each content and not for each place."""
    names = ["doc_id", "sub", "at"]

    def decided(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        doc = numbers(rows["doc_id"].combine_chunks())
        row, offset, same, n = suffix_order(rows["content"].to_pylist(), window)
        begin = np.flatnonzero(~same)
        least = np.repeat(np.minimum.reduceat(doc[row], begin), np.diff(np.append(begin, len(row))))
        gone = np.flatnonzero(doc[row] > least)
        # Back in the order of the phrases, where windows that go follow each other.
        back = gone[np.lexsort((offset[gone], row[gone]))]
        row, offset = row[back], offset[back]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (offset[1:] != offset[:-1] + 1)
        begin = np.flatnonzero(new)
        count = np.diff(np.append(begin, len(row)))
        row, offset = row[begin], offset[begin]
        places = rows["places"].combine_chunks()
        many = places.value_lengths().to_numpy()
        ends = np.cumsum(many)
        of = np.repeat(np.arange(len(row)), many[row])
        at = places.flatten().to_numpy()[np.arange(len(of)) + np.repeat((ends - many)[row] - (np.cumsum(many[row]) - many[row]), many[row])]
        new = np.ones(len(of), bool)
        new[1:] = row[of[1:]] != row[of[:-1]]
        begin = np.flatnonzero(new)
        taken = pa.array(row[of[begin]])
        lists = pa.ListArray.from_arrays(np.append(begin, len(of)).astype(np.int32), (at >> 32) + offset[of] << 32 | count[of])
        return pa.RecordBatch.from_arrays([rows["doc_id"].combine_chunks().take(taken), rows["sub"].combine_chunks().take(taken), lists], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            settled = batch.filter(batch.column(0).is_null())
            if settled.num_rows:
                yield pa.RecordBatch.from_arrays(settled.columns[1:4], names)
            batch = batch.filter(batch.column(0).is_valid())
            if not batch.num_rows:
                continue
            # Whole groups are sorted; the last may go on in the next batch.
            key = batch.column(0).to_numpy()
            sizes = np.cumsum(pc.binary_length(batch.column(4)).to_numpy())
            begin = np.flatnonzero(np.concatenate(([not held or held[-1].column(0)[-1].as_py() != key[0]], key[1:] != key[:-1])))
            done = 0
            for at in begin.tolist():
                before = size + int(sizes[at - 1] - (sizes[done - 1] if done else 0) if at > done else 0)
                if before >= SORT_BYTES:
                    if at > done:
                        held.append(batch.slice(done, at - done))
                    yield decided(held)
                    held, size, done = [], 0, at
            if done < batch.num_rows:
                held.append(batch.slice(done))
                size += int(sizes[-1] - (sizes[done - 1] if done else 0))
        if held:
            yield decided(held)

    spread = F.coalesce("key", F.xxhash64("doc_id", "sub", F.element_at("places", 1)))
    return found.repartition(spread).sortWithinPartitions("key", "doc_id", "sub").mapInArrow(run, "doc_id long, sub long, at array<long>")


def united(at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that some windows cover."""
    at = np.sort(at)
    start, end = at >> 32, np.maximum.accumulate((at >> 32) + (at & LOW) - 1 + window)
    new = np.ones(len(at), bool)
    new[1:] = start[1:] > end[:-1]
    begin = np.flatnonzero(new)
    return start[begin], end[np.append(begin[1:], len(at)) - 1]


def deduplicate(docs: DataFrame, window: int = WINDOW, trigger: int = TRIGGER, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs plus n_bytes, n_removed, n_spans (maximal runs of removed bytes) and kept (the other bytes, which need not be
    whole characters)."""
    done = _cut(docs, window, trigger, text, key)
    results = ("n_bytes", "n_removed", "n_spans", "kept")
    return done.select(*others(docs, *results, prefix="row."), *[f"cut.{c}" for c in results])


def shortened(docs: DataFrame) -> DataFrame:
    """docs with what is left as text, where anything went; bytes of characters cut in two go as well."""
    whole = F.expr("try_validate_utf8(CAST(cut.kept AS STRING))")
    new = F.when(F.col("cut.n_removed") > 0, F.coalesce(whole, F.call_function("make_valid_utf8", F.col("cut.kept").cast("string")))).otherwise(F.col("row.text"))
    return with_text(_cut(docs, WINDOW, TRIGGER, "text", "doc_id"), new, docs, prefix="row.")


def _cut(docs: DataFrame, window: int, trigger: int, text: str, key: str) -> DataFrame:
    """doc_id, the row of docs and cut, a struct of n_bytes, n_removed, n_spans and kept."""
    own = told_apart(docs, text, key)
    texts = own.select("doc_id", "sub", "text")
    with small_batches(docs.sparkSession):
        marks = materialize(dictionary(parse(texts, window, trigger)), "marks", large=True)
        late = materialize(repeated(dictionary_texts(texts, marks, window), window), "repeated", large=True)
    spans = marks.filter(F.col("trigger").isNull()).select("doc_id", "sub", F.array("at").alias("at")).unionByName(late)
    spans = spans.groupBy("doc_id", "sub").agg(F.flatten(F.collect_list("at")).alias("spans"))

    @F.arrow_udf("struct<n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept:binary>")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        sizes, removed, runs, kept = [], [], [], []
        for i in range(len(texts)):
            raw = texts[i].as_buffer().to_pybytes() if texts[i].is_valid else b""
            at = spans[i].values.to_numpy() if spans[i].is_valid else np.zeros(0, np.int64)
            sizes.append(len(raw))
            if len(at):
                start, end = united(at, window)
                removed.append(int((end - start).sum()))
                runs.append(len(start))
                raw = b"".join(raw[a:b] for a, b in zip([0, *end.tolist()], [*start.tolist(), len(raw)]))
            else:
                removed.append(0)
                runs.append(0)
            kept.append(raw)
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (sizes, removed, runs)] + [pa.array(kept, pa.binary())], ["n_bytes", "n_removed", "n_spans", "kept"])

    joined = own.select("doc_id", "sub", "row").alias("d").join(spans.alias("s"), same_row("d", "s"), "left")
    return joined.select("d.doc_id", "d.row", cut(F.coalesce(F.col(f"d.row.`{text}`"), F.lit("")), F.col("s.spans")).alias("cut"))


def brute_force(rows: list[tuple[int, str | None]], window: int = WINDOW) -> dict[int, tuple[int, int, int, str]]:
    """doc_id: (n_bytes, n_removed, n_spans, SHA-256 of what is kept), by the definition; for tests."""
    texts = [(d, (t or "").encode()) for d, t in rows]
    first: dict[bytes, int] = {}
    for d, raw in texts:
        for i in range(len(raw) - window + 1):
            w = raw[i : i + window]
            first[w] = min(d, first.get(w, d))
    out = {}
    for d, raw in texts:
        gone = bytearray(len(raw))
        for i in range(len(raw) - window + 1):
            if first[raw[i : i + window]] < d:
                gone[i : i + window] = b"\1" * window
        runs = sum(1 for i in range(len(raw)) if gone[i] and not (i and gone[i - 1]))
        out[d] = (len(raw), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest())
    return out
