"""Media columns: Matroska files as binary columns, and their packets as tables.

A file here is an EBML header and one Segment of Info, Tracks, Clusters and Cues. Frames of
FRAME_BYTES 8-bit PCM samples travel in SimpleBlocks, several to a block by fixed-size or EBML
lacing. The reader is general: element ids and sizes of any width, unknown sizes for Segment and
Cluster, SimpleBlock and BlockGroup, no / Xiph / EBML / fixed lacing.

Defined results: null text is stored as empty text; an empty payload is still one 64-byte frame; very long
texts are one file of many clusters; equal texts give equal files, and repeated rows a file each; a null or
malformed file has no packets, and features() names it "malformed"; an empty table gives an empty table.
store_texts() drops other columns; features() passes them through, those named as its results are replaced.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.textops import others

#: Fixed values of the format.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = frozenset((SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS))

FRAME_BYTES, FRAMES_A_BLOCK, BLOCKS_A_CLUSTER, SAMPLE_RATE = 1024, 8, 4, 8000
PAD = 64


def vint(value: int, width: int = 0) -> bytes:
    """A size as a variable-length integer, in `width` bytes or as few as hold it."""
    width = width or next(w for w in range(1, 9) if value < (1 << (7 * w)) - 1)
    return (value | 1 << (7 * width)).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes]) -> tuple[int, bytes]:
    """Lacing flag bits and the block's body after its header."""
    if len(frames) == 1:
        return 0x00, frames[0]
    sizes = [len(x) for x in frames]
    if len(set(sizes)) == 1:
        return 0x04, bytes([len(frames) - 1]) + b"".join(frames)
    head = bytes([len(frames) - 1]) + vint(sizes[0])
    for a, b in zip(sizes, sizes[1:-1]):
        step = b - a
        width = next(w for w in range(1, 9) if abs(step) < (1 << (7 * w - 1)) - 1)
        head += vint(step + (1 << (7 * width - 1)) - 1, width)
    return 0x06, head + b"".join(frames)


def write(payload: bytes, frame_bytes: int = FRAME_BYTES) -> bytes:
    """The payload as one 8-bit mono PCM track at SAMPLE_RATE, timestamps in milliseconds."""
    frames = [payload[i : i + frame_bytes] for i in range(0, len(payload), frame_bytes)]
    info = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + element(MUXING_APP, b"weftline") + element(WRITING_APP, b"weftline"))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, np.array(SAMPLE_RATE, ">f8").tobytes()) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
    track = element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio)
    parts = [info, element(TRACKS, track)]
    at = sum(map(len, parts))
    cues = []
    a_cluster = FRAMES_A_BLOCK * BLOCKS_A_CLUSTER
    for c in range(0, len(frames), a_cluster):
        began = c * frame_bytes * 1000 // SAMPLE_RATE
        body = [number(TIMESTAMP, began)]
        for b in range(c, min(c + a_cluster, len(frames)), FRAMES_A_BLOCK):
            flags, laced = lace(frames[b : min(b + FRAMES_A_BLOCK, c + a_cluster)])
            since = b * frame_bytes * 1000 // SAMPLE_RATE - began
            body.append(element(SIMPLE_BLOCK, vint(1) + since.to_bytes(2, "big", signed=True) + bytes([0x80 | flags]) + laced))
        cues.append(element(CUE_POINT, number(CUE_TIME, began) + element(CUE_TRACK_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER_POSITION, at))))
        parts.append(element(CLUSTER, b"".join(body)))
        at += len(parts[-1])
    parts.append(element(CUES, b"".join(cues)))
    head = element(EBML, number(EBML_VERSION, 1) + number(EBML_READ_VERSION, 1) + number(EBML_MAX_ID, 4) + number(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + number(DOC_TYPE_VERSION, 4) + number(DOC_TYPE_READ_VERSION, 2))
    return head + element(SEGMENT, b"".join(parts))


def read_vint(data: bytes, at: int, keep_marker: bool) -> tuple[int, int, bool]:
    """Value, width and whether all value bits are set (an unknown size)."""
    first = data[at]
    if not first:
        raise ValueError("integer of more than 8 bytes")
    width = 9 - first.bit_length()
    if at + width > len(data):
        raise ValueError("truncated integer")
    value = int.from_bytes(data[at : at + width], "big")
    bare = value & ((1 << (7 * width)) - 1)
    return (value if keep_marker else bare), width, bare == (1 << (7 * width)) - 1


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, start of element, start of body, end of body) of all elements, parents before children."""
    ends = [end]
    while at < end:
        while len(ends) > 1 and at >= ends[-1]:
            ends.pop()
        ident, w, _ = read_vint(data, at, True)
        size, s, unknown = read_vint(data, at + w, False)
        body = at + w + s
        stop = ends[-1] if unknown else body + size
        if stop > len(data):
            raise ValueError("element beyond the end")
        yield ident, at, body, stop
        if ident in MASTERS:
            if not unknown:
                ends.append(stop)
            at = body
        else:
            at = stop


def uint(data: bytes, body: int, stop: int) -> int:
    return int.from_bytes(data[body:stop], "big")


@dataclass
class Packet:
    track: int
    timestamp: int
    offset: int
    size: int
    cluster: int
    block: int
    keyframe: bool


def block_frames(data: bytes, at: int, stop: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """Track, relative timestamp, flags and (offset, size) of each frame of a (Simple)Block."""
    track, w, _ = read_vint(data, at, False)
    since = int.from_bytes(data[at + w : at + w + 2], "big", signed=True)
    flags = data[at + w + 2]
    at += w + 3
    kind = flags & 0x06
    if not kind:
        return track, since, flags, [(at, stop - at)]
    n = data[at] + 1
    at += 1
    sizes: list[int] = []
    if kind == 0x04:
        sizes = [(stop - at) // n] * (n - 1)
    elif kind == 0x02:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    else:
        for i in range(n - 1):
            value, w, _ = read_vint(data, at, False)
            sizes.append(value if not i else sizes[-1] + value - (1 << (7 * w - 1)) + 1)
            at += w
    sizes.append(stop - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced sizes exceed the block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return track, since, flags, out


def parse(data: bytes) -> tuple[list[Packet], list[tuple[int, int]], dict[int, str], int]:
    """Packets in file order, cues (time, cluster offset in the file), track codecs, timestamp scale.
    The frames of a laced block share its timestamp."""
    packets: list[Packet] = []
    cues: list[tuple[int, int]] = []
    codecs: dict[int, str] = {}
    scale, cluster, block, base, began, track, cue_time = 1_000_000, -1, -1, 0, 0, 0, 0
    for ident, at, body, stop in elements(data, 0, len(data)):
        if ident == SEGMENT:
            base = body
        elif ident == TIMESTAMP_SCALE:
            scale = uint(data, body, stop)
        elif ident == TRACK_NUMBER:
            track = uint(data, body, stop)
        elif ident == CODEC_ID:
            codecs[track] = data[body:stop].decode("ascii", "replace")
        elif ident == CLUSTER:
            cluster += 1
        elif ident == TIMESTAMP:
            began = uint(data, body, stop)
        elif ident in (SIMPLE_BLOCK, BLOCK):
            block += 1
            number_, since, flags, frames = block_frames(data, body, stop)
            key = bool(flags & 0x80) or ident == BLOCK
            packets += [Packet(number_, began + since, o, n, cluster, block, key) for o, n in frames]
        elif ident == REFERENCE_BLOCK and packets:
            for p in reversed(packets):
                if p.block != block:
                    break
                p.keyframe = False
        elif ident == CUE_TIME:
            cue_time = uint(data, body, stop)
        elif ident == CUE_CLUSTER_POSITION:
            cues.append((cue_time, base + uint(data, body, stop)))
    return packets, cues, codecs, scale


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8")
    return len(raw), raw + bytes(PAD * max(1, -(-len(raw) // PAD)) - len(raw))


def store_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes and media: the text, zero-padded to a positive multiple of 64, as a Matroska file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                made = [payload_of(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([write(p) for _, p in made], pa.binary())], ["key", "n_bytes", "media"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"key {kind}, n_bytes long, media binary").withColumnRenamed("key", key)


def packet_table(files: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """One row a packet: key, packet, track, codec, timestamp_ns, cluster, block, offset, size, keyframe, cued."""
    kind = files.schema[key].dataType.simpleString()
    schema = f"key {kind}, packet int, track int, codec string, timestamp_ns long, cluster int, block int, offset long, size long, keyframe boolean, cued boolean"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in zip(batch.column(0), batch.column(1)):
                try:
                    packets, cues, codecs, scale = parse(data.as_py() or b"")
                except (ValueError, IndexError):
                    continue
                times = {t for t, _ in cues}
                for i in range(0, len(packets), 10_000):
                    part = packets[i : i + 10_000]
                    cols = [pa.array([k.as_py()] * len(part), batch.column(0).type), pa.array(range(i, i + len(part)), pa.int32())]
                    cols += [pa.array([p.track for p in part], pa.int32()), pa.array([codecs.get(p.track) for p in part], pa.string()), pa.array([p.timestamp * scale for p in part], pa.int64())]
                    cols += [pa.array([getattr(p, c) for p in part], t) for c, t in (("cluster", pa.int32()), ("block", pa.int32()), ("offset", pa.int64()), ("size", pa.int64()), ("keyframe", pa.bool_()))]
                    cols.append(pa.array([p.timestamp in times for p in part], pa.bool_()))
                    yield pa.RecordBatch.from_arrays(cols, names)

    return files.select(key, media).mapInArrow(run, schema).withColumnRenamed("key", key)


def features(files: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """key and other columns of files, with what is read back from each file: payload digest and
    length, CRC-32 of its last 64 bytes, digest and length of the file, and a feature string of
    packets, clusters, cues, duration and the samples' mean, RMS and zero crossings."""
    out = "struct<payload_bytes:bigint,payload_sha256:string,tail_crc32:bigint,feature:string>"

    @F.pandas_udf(out)
    def read_back(column):
        import pandas as pd

        rows = []
        for data in column:
            try:
                packets, cues, codecs, scale = parse(data or b"")
            except (ValueError, IndexError):
                packets, cues, codecs, scale = [], [], {}, 0
            if not packets:
                rows.append((None, None, None, "malformed"))
                continue
            payload = b"".join(data[p.offset : p.offset + p.size] for p in packets)
            wave = np.frombuffer(payload, np.uint8).astype(np.float64) - 128.0
            crossings = int(np.count_nonzero(np.diff(np.signbit(wave))))
            clusters = packets[-1].cluster + 1
            good = sum(data[o : o + 4] == CLUSTER.to_bytes(4, "big") for _, o in cues)
            tail = f"mean={wave.mean():.4f};rms={np.sqrt((wave * wave).mean()):.4f};zc={crossings}"
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), f"codec={codecs.get(packets[0].track)};packets={len(packets)};clusters={clusters};cues={good};ms={len(payload) * 1000 // SAMPLE_RATE};{tail}"))
        return pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "feature"])

    read = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    got = files.select(read_back(F.col(media)).alias("found"), F.length(media).cast("long").alias("media_bytes"), F.sha2(F.col(media), 256).alias("media_sha256"), F.struct("*").alias("row"))
    return got.select(*others(files, media, *read, prefix="row."), *[x if x.startswith("media") else f"found.{x}" for x in read])
