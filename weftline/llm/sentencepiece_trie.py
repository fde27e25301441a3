"""SentencePiece encoding and decoding by a Viterbi pass shared over common prefixes.

A text is normalised (dummy prefix, spaces as the mark U+2581) and falls apart into marked words,
over whose ends no piece of the model reaches. The distinct words of a batch are sorted, which
makes the list a trie read depth-first: going from one word to the next, the forward scores of
their common prefix stay, and just the rest is computed. Pieces that end at a place are found by
walking a trie of reversed pieces.

UNIGRAM is Viterbi: the best sum of piece scores. A model published as BPE has merge ranks in place
of scores, which don't add up; there a piece's score follows from its rank by Zipf's law, without any
training (`rank_score`, whole numbers, so that sums have no rounding; of equal sums the one with
the longest last piece is taken). BPE is the model's own merge rule by the same traversal: a piece
may end a prefix if it and the last piece before it are a pair that merging leaves as it is, and
just one such piece exists.

Defined results: null text has null ids, empty text has none; characters without a piece become
byte pieces, or the unknown id in models without them; very long texts are encoded whole, word by
word; repeated rows get equal ids; an empty table gives an empty table; other columns pass through,
those named as the results are replaced. Decoding is the inverse but for U+2581 itself, which the
format can't tell from a space.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.textops import bounded, text_chunks

MARK = "▁"
MODEL = "piece_bpe_32k.model"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Ranks become scores of this many units for each factor e in probability.
RANK_UNITS = 1024
UNKNOWN_PENALTY = 10
#: Bounds of what a task keeps: bytes of text a trie is built from, encoded words, known pairs.
CHUNK, KEPT_WORDS, KEPT_PAIRS = 3_000_000, 600_000, 500_000
#: Rows that are decoded at once.
ROWS = 200


def rank_score(rank: int) -> int:
    """Zipf's law: the piece of rank r is about r times as rare as the first."""
    return -round(RANK_UNITS * log(1 + rank))


def rank_scores(ids: dict[str, int], scores: dict[str, float]) -> dict[str, int]:
    """Scores from the order of merging, best first."""
    ordered = sorted(ids, key=lambda p: (-scores[p], ids[p]))
    return {p: rank_score(rank) for rank, p in enumerate(ordered, 1)}


@dataclass
class Pieces:
    """A model's vocabulary: id and score of each piece, and the bytes that each id stands for."""

    kind: int
    ids: dict[str, int]
    scores: dict[str, float]
    unknown_score: float
    as_bytes: list[bytes]
    byte_ids: list[int]
    unknown: int
    longest: int
    split: re.Pattern
    dummy_prefix: bool
    fits: dict[int, bool] = field(default_factory=dict)
    tails: dict = field(default_factory=dict)
    known: dict[str, bytes] = field(default_factory=dict)

    def __post_init__(self) -> None:
        # Nodes of the trie of reversed pieces: [children, score and id of the piece that is read there].
        for piece, i in self.ids.items():
            kids, node = self.tails, None
            for c in reversed(piece):
                node = kids.setdefault(c, [{}, None, -1])
                kids = node[0]
            node[1:] = self.scores[piece], i
        lengths = np.array([len(x) for x in self.as_bytes], np.int64)
        self.byte_places = lengths, np.cumsum(lengths) - lengths
        self.all_bytes = np.frombuffer(b"".join(self.as_bytes), np.uint8)

    @classmethod
    def load(cls, path: str, kind: int | None = None) -> "Pieces":
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.normalizer_spec.name != "identity" or model.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models with the identity normaliser are read")
        ids, scores, as_bytes, byte_ids, unknown = {}, {}, [], [0] * 256, 0
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                byte_ids[int(p.piece[3:5], 16)] = i
                as_bytes.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type in (NORMAL, USER):
                ids[p.piece], scores[p.piece] = i, p.score
                as_bytes.append(p.piece.replace(MARK, " ").encode())
            else:
                unknown = i if p.type == UNKNOWN else unknown
                as_bytes.append(" ⁇ ".encode() if p.type == UNKNOWN else b"")
        if any(MARK in p.lstrip(MARK) for p in ids):
            raise ValueError("a piece reaches over the end of a word")
        # White space that no piece holds stands alone; all else that belongs together stays together.
        held = set("".join(ids))
        alone = "".join(c for c in "\t\n\r\x0b\x0c" if c not in held)
        split = re.compile(f"{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+|[{alone}]" if alone else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        published = model.trainer_spec.model_type
        kind, unit = kind or published, 1
        if kind == UNIGRAM and published != UNIGRAM:
            scores, unit = rank_scores(ids, scores), RANK_UNITS
        return cls(kind, ids, scores, min(scores.values()) - unit * UNKNOWN_PENALTY, as_bytes, byte_ids if model.trainer_spec.byte_fallback else [], unknown, max(map(len, ids)), split, model.normalizer_spec.add_dummy_prefix)

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        return self.split.findall((MARK if self.dummy_prefix else "") + text.replace(" ", MARK))

    def merged(self, text: str) -> list[str]:
        """BPE by its definition, for short strings: join the best-scored adjacent pair, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def pair_stays(self, left: str, right: str) -> bool:
        """Whether merging leaves the two pieces as they are; left may be empty."""
        return self.merged(left + right) == ([left, right] if left else [right])

    def _known(self, key: int, left: str, right: str) -> bool:
        if len(self.fits) > KEPT_PAIRS:
            self.fits.clear()
        known = self.fits[key] = self.pair_stays(left, right)
        return known

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """ids (int32, packed) of each distinct word; the forward pass runs over the words in sorted order."""
        forward = self._unigram_states if self.kind == UNIGRAM else self._bpe_states
        out: dict[str, bytes] = {}
        before = ""
        states: tuple[list, list, list] = [0], [0], [-1]  # score, length and id of the last piece, for each prefix
        for word in sorted(words):
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            for x in states:
                del x[shared + 1 :]
            forward(word, *states)
            out[word] = array("i", self._ids(word, *states[1:])).tobytes()
            before = word
        return out

    def _unigram_states(self, word: str, scores: list, sizes: list, ids: list) -> None:
        """The best sum for each prefix, over the pieces that end it or a lone unknown character."""
        first, unknown = self.tails.get, self.unknown_score
        for end in range(len(scores) - 1, len(word)):
            best, size, found = scores[end] + unknown, 1, -1
            node, i = first(word[end]), end
            while node is not None:
                kids, score, piece = node
                if score is not None:
                    total = scores[i] + score
                    if total >= best:
                        best, size, found = total, end - i + 1, piece
                if not i:
                    break
                i -= 1
                node = kids.get(word[i])
            scores.append(best)
            sizes.append(size)
            ids.append(found)

    def _bpe_states(self, word: str, scores: list, sizes: list, ids: list) -> None:
        """A character without a piece is one of its own (id -1), and joins nothing."""
        fits = self.fits
        for end in range(len(sizes), len(word) + 1):
            i = end - 1
            node = self.tails.get(word[i])
            size, found = 1, -1
            while node is not None:
                kids, score, piece = node
                if score is not None:
                    left = ids[i] if i else -1
                    if left < 0:
                        known = self._known(-1 - piece, "", word[i:end])
                        if i:
                            size, found = end - i, piece
                    else:
                        known = fits.get(left << 20 | piece)
                        if known is None:
                            known = self._known(left << 20 | piece, word[i - sizes[i] : i], word[i:end])
                    if known:
                        size, found = end - i, piece
                        break
                if not i:
                    break
                i -= 1
                node = kids.get(word[i])
            scores.append(0)
            sizes.append(size)
            ids.append(found)

    def _ids(self, word: str, sizes: list, ids: list) -> list[int]:
        out: list[int] = []
        end = len(word)
        while end:
            if ids[end] >= 0:
                out.append(ids[end])
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in reversed(word[end - sizes[end] : end].encode())]
            else:
                out.append(self.unknown)
            end -= sizes[end]
        out.reverse()
        return out

    def decode(self, ids: list[int]) -> str:
        text = b"".join([self.as_bytes[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text

    def decode_rows(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of rows of ids that end at those places."""
        lengths, starts = self.byte_places
        size = lengths[ids]
        stop = np.cumsum(size)
        at = np.arange(stop[-1] if len(stop) else 0) + np.repeat(starts[ids] - (stop - size), size)
        raw = self.all_bytes[at].tobytes()
        out, begin = [], 0
        for end in np.concatenate(([0], stop))[ends].tolist():
            skip = self.dummy_prefix and raw[begin : begin + 1] == b" "
            out.append(raw[begin + skip : end].decode("utf-8", "replace"))
            begin = end
        return out


@lru_cache(maxsize=4)
def pieces(name: str, kind: int | None = None) -> Pieces:
    import public_tokenizers

    return Pieces.load(public_tokenizers.path(name), kind)


def encode(docs: DataFrame, text: str = "text", name: str = "ids", model: str = MODEL, kind: int | None = UNIGRAM) -> DataFrame:
    """docs plus ids, by Viterbi or, with kind None, by the rule the model was published with. A task builds a trie of the words that it doesn't know yet from every CHUNK of
    text; no words travel between tasks."""

    @F.arrow_udf("array<int>")
    def encoded(texts: pa.Array) -> pa.Array:
        own = pieces(model, kind)
        packed: list[bytes] = []
        for lo, hi in text_chunks(texts, CHUNK):
            words = [[] if t is None else own.words(t) for t in texts.slice(lo, hi - lo).to_pylist()]
            if len(own.known) > KEPT_WORDS:
                own.known.clear()
            table = own.known
            table |= own.encode_words(set().union(*words).difference(table))
            packed += [b"".join(map(table.__getitem__, ws)) for ws in words]
        offsets = np.cumsum([0, *map(len, packed)]) // 4
        values = pa.array(np.frombuffer(b"".join(packed), np.int32))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=texts.is_null() if texts.null_count else None)

    return bounded(docs).withColumn(name, encoded(F.col(text)))


def decode(docs: DataFrame, ids: str = "ids", name: str = "decoded", model: str = MODEL) -> DataFrame:
    """docs plus the text of the ids."""

    @F.arrow_udf("string")
    def decoded(column: pa.Array) -> pa.Array:
        own = pieces(model, UNIGRAM)  # ids mean the same whatever rule chose them
        ids_, ends = column.flatten().to_numpy(), np.cumsum(column.value_lengths().fill_null(0).to_numpy()).astype(np.int64)
        texts, done = [], 0
        for lo in range(0, len(ends), ROWS):  # a bounded number of rows, or a single long one, at once
            part = ends[lo : lo + ROWS]
            texts += own.decode_rows(ids_[done : part[-1]], part - done)
            done = part[-1]
        return pa.array([t if ok else None for t, ok in zip(texts, column.is_valid().to_pylist())], pa.string())

    return bounded(docs).withColumn(name, decoded(F.col(ids)))
