"""Personal data: fixed patterns, and a linear-chain conditional random field over word-shape features.

The patterns find the base spans. The CRF is trained on the driver from a small labelled table
(`labelled_examples`, or one of the caller's) and adds what patterns can't state: secrets, names,
street addresses, numbers of documents, national phone numbers, addresses with (at) or [dot]. Its
features are a word's cues (a salutation before it, a street word near it, a number or the same word beside
it), its shape, its pattern of character classes, its first and last three bytes, the word itself, and the
shapes and words beside it. A name without a salutation and an address without a street word are held back. Values that the labelled table has fewer than
LEAST times are one unknown value. Words whose score for "other" exceeds every other label's by more
than the transitions can ever make good must be "other" on the best path, so Viterbi runs, in
numpy batches, just over the stretches between them, with the same result.

What the CRF finds stands as it is, but for checksums: a card must pass Luhn, an address of the
internet has four parts up to 255. Spans that overlap a base span fall away.

Defined results: null text counts as empty and has no spans; ties between labels go to the first
in LABELS; very long texts are one sequence each, searched whole; repeated rows are searched one by
one; an empty table gives an empty table; other columns pass through, those named as the results of
`find` are replaced there.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.textops import Words, bounded, byte_values, lower_ascii, mix, others, powers, text_buffers, text_chunks

#: The kinds of the patterns, and those that just the CRF finds.
KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("secret", "name", "address", "id")
LABELS = ("other", *KINDS, *MORE_KINDS)
ORDER = {kind: i for i, kind in enumerate(LABELS)}

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[::-2])) + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """As EMAIL.finditer, from one @ to the next: a match's local part is all its characters before the @."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns by start, then kind in the order of LABELS."""
    found = [("email", a, b) for a, b in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        for m in PHONE.finditer(text) if "+" in text else ():
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                found.append(("phone", *m.span()))
    return ordered(found)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], ORDER[s[0]], s[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# Features of words

_CLASS = np.full(256, 64, np.uint16)
_CLASS[128:] = 1
_CLASS[[*range(65, 91), *range(97, 123)]] = 1
_CLASS[48:58] = 2
_CLASS[ord("@")] = 4
_CLASS[ord(".")] = 8
_CLASS[ord("+")] = 16
_CLASS[[ord(c) for c in "()-/[]"]] = 32
N_SHAPES = 128 * 5 * 4
_DIGITS = np.digitize(np.arange(256), [1, 4, 7, 12])
_LENGTHS = np.digitize(np.arange(256), [3, 6, 12])
#: For patterns: small and capital letters, digits, quotes, closing marks, and every other byte by itself.
_RUN = np.arange(256, dtype=np.uint8)
_RUN[128:] = ord("a")
_RUN[97:123], _RUN[65:91], _RUN[48:58] = ord("a"), ord("A"), ord("9")
_RUN[[ord(c) for c in "\"'`"]] = ord("'")
_RUN[[ord(c) for c in ".,;:!?#$%&*|"]] = ord(".")
_LETTER = (_CLASS == 1) | (_CLASS == 2)
#: Values that the labelled table has less often count as unknown.
LEAST = 4
#: What a word's score for another label must exceed the one for "other" by: rather missed than wrongly found.
CAUTION = 0.5
KNOWN = ("word", "head", "tail", "pattern")
#: Words that come before a name, and words and ends of words in an address.
SALUTATIONS = ("mr", "mrs", "ms", "dr", "dear", "herr", "frau", "señor", "señora", "madame", "monsieur", "prof")
STREETS, STREET_ENDS = ("street", "road", "avenue", "lane", "drive", "rue", "calle"), ("straße", "strasse")
#: Bits of the cue feature: a salutation one or two words before, a street word at most two words off, a number beside, the same word beside.
SALUTED, STREET, NUMBERED, REPEATED = 1, 2, 4, 8
#: What a name without a salutation and an address without a street word are held back by.
UNCUED = 12.0
#: (feature, how many words before this one)
SLOTS = (("cue", 0), ("shape", 0), ("word", 0), ("head", 0), ("tail", 0), ("pattern", 0), ("runs", 0), ("shape", 1), ("pattern", 1), ("word", 1), ("word", 2), ("shape", -1), ("word", -1))


def described(words: Words, cued: bool = True) -> dict[str, np.ndarray]:
    """The features of every word; those of KNOWN are 64-bit hashes. Cues can be left out."""
    if not len(words):
        return {n: np.zeros(0, np.uint64 if n in KNOWN else np.int64) for n in ("cue", "shape", "runs", *KNOWN)}
    data, inside = words.data[words.start[0] :], words._inside[words.start[0] :]
    at, lengths = words.start - words.start[0], words.end - words.start
    kinds = np.where(inside, _CLASS[data], 0)
    classes = np.bitwise_or.reduceat(kinds, at).astype(np.int64)
    digits = np.minimum(np.add.reduceat((kinds == 2).astype(np.int64), at), 255)
    shape = (classes * 5 + _DIGITS[digits]) * 4 + _LENGTHS[np.minimum(lengths, 255)]
    # Only the bytes inside words from here on: `of` is a byte's word, `place` its place there.
    raw = data[inside]
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(raw)) - np.repeat(first, lengths)
    low = byte_values(lower_ascii(raw))
    value = low * powers(int(place.max()) + 1)[place]
    summed = lambda x, use: mix(np.add.reduceat(np.where(use, x, np.uint64(0)), first))
    back = np.repeat(lengths, lengths) - 1 - place
    run = _RUN[raw]
    large = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97))  # capital letters of two bytes
    run[large] = run[large + 1] = ord("A")
    change = np.ones(len(raw), bool)
    change[1:] = run[1:] != run[:-1]
    change[first] = True
    before = np.cumsum(change)
    rank = before - np.repeat(before[first], lengths)
    word, tail = summed(value, _LETTER[raw]), summed(low * powers(3)[np.minimum(back, 2)], back < 3)
    return {
        "cue": cues(words, word, tail, classes == 2) if cued else shape,
        "shape": shape,
        "runs": np.minimum(np.add.reduceat(change.astype(np.int64), first), 15),
        "word": word,
        "head": summed(value, place < 3),
        "tail": tail,
        "pattern": summed(byte_values(run) * powers(int(rank.max()) + 1)[rank], change),
    }


@lru_cache(maxsize=1)
def cue_words() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of salutations, of street words and of the ends of these."""
    hashed = lambda texts, what: described(Words(*text_buffers(pa.array([" ".join(texts)]))), cued=False)[what]
    return hashed(SALUTATIONS, "word"), hashed(STREETS, "word"), hashed(STREET_ENDS, "tail")


def cues(words: Words, word: np.ndarray, tail: np.ndarray, number: np.ndarray) -> np.ndarray:
    """For each word which of the cues it has."""
    greets, streets, ends = cue_words()
    at = lambda x, *places: np.logical_or.reduce([shifted(x, words.first, by, False) for by in places])
    saluted = at(np.isin(word, greets), 1, 2)
    street = at(np.isin(word, streets) | np.isin(tail, ends), -2, -1, 0, 1, 2)
    same = (shifted(word, words.first, 1, 0) == word) | (shifted(word, words.first, -1, 0) == word)
    return saluted * SALUTED + street * STREET + at(number, -1, 1) * NUMBERED + same * REPEATED


def shifted(x: np.ndarray, first: np.ndarray, by: int, outside: int) -> np.ndarray:
    """The value of the word `by` places before (after, if negative) in the same row."""
    if not by:
        return x
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    other = np.arange(len(x)) - by
    inside = (other >= first[row]) & (other < first[row + 1])
    return np.where(inside, x[np.clip(other, 0, max(len(x) - 1, 0))], outside) if len(x) else x


# The labelled table

def labelled_examples(n: int = 2000, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """Invented (text, spans): prose, numbers that are nothing personal, and personal data in many forms."""
    rng = np.random.default_rng(seed)
    letters = "aeioulnrstmdhwgcbaeionéóöñ"
    pick = lambda options: options[int(rng.integers(0, len(options)))]

    def word(lo: int = 1, hi: int = 10) -> str:
        return "".join(letters[i] for i in rng.integers(0, len(letters), rng.integers(lo, hi)))

    ended = [True]

    def prose() -> str:
        """A word; one after a full stop begins with a capital letter."""
        w = word(8, 24) if rng.random() < 0.05 else pick(["at", "to", "of", "the", "and", "de", "la", "der", "dr", "as"]) if rng.random() < 0.15 else word()
        w = w.capitalize() if ended[0] or rng.random() < 0.08 else w.upper() if rng.random() < 0.03 else w
        mark = pick([".", ".", ",", ";", ":"]) if rng.random() < 0.18 else ""
        ended[0] = mark == "."
        return w + mark

    def digits(k: int) -> str:
        return "".join(map(str, rng.integers(0, 10, k)))

    def drawn(alphabet: str, k: int) -> str:
        return "".join(alphabet[i] for i in rng.integers(0, len(alphabet), k))

    def email() -> tuple[str, str, str]:
        word = lambda lo, hi: drawn("aeioulnrstmd", int(rng.integers(lo, hi)))
        name, host = word(3, 8) + pick(["", ".", "_"]) + digits(int(rng.integers(0, 3))) + "x", word(3, 8)
        return "", pick([f"{name}@{host}.example.com", f"{name}@{host}.org", f"{name}(at){host}.com", f"{name}[at]{host}[dot]net", f"{name} (at) {host} (dot) com"]), ""

    def phone() -> tuple[str, str, str]:
        a, b, c = digits(3), digits(3), digits(4)
        return pick(["", "", "call ", "phone: ", "Tel. "]), pick([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+49 {a} {b}{c}", f"+{digits(2)}-{a}-{b}-{c}"]), ""

    def card() -> tuple[str, str, str]:
        q = [digits(4) for _ in range(4)]
        return "", pick(["".join(q), " ".join(q), "-".join(q), ".".join(q), "/".join(q)]), ""

    def ip() -> tuple[str, str, str]:
        return "", ".".join(str(x) for x in rng.integers(0, 256, 4)), ""

    def secret() -> tuple[str, str, str]:
        base62 = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
        value = pick([drawn("0123456789abcdef", pick([32, 40, 40, 64])), drawn("0123456789ABCDEF", 40), drawn(base62, int(rng.integers(20, 45))), "-".join(drawn("0123456789abcdef", k) for k in (8, 4, 4, 4, 12))])
        key = pick(["token", "token", "api_key", "secret", "password", "apikey", "access_token", "client_secret", "auth"])
        quote = pick(['"', '"', "'", ""])
        return pick([f"{key} = {quote}", f"{key} = {quote}", f"{key}: {quote}", f"{key} {quote}", "Bearer "]), value, quote

    def name() -> tuple[str, str, str]:
        own = " ".join(word(3, 9).capitalize() for _ in range(int(rng.integers(1, 3))))
        return pick(["Mr. ", "Mrs. ", "Ms. ", "Dr. ", "Dear ", "Herr ", "Frau ", "Señor ", "Madame ", "Prof. "]), own, pick(["", ",", "."])

    def address() -> tuple[str, str, str]:
        own, number = word(4, 9).capitalize(), digits(int(rng.integers(1, 4)))
        return "", pick([f"{number} {own} {pick(['Street', 'Road', 'Avenue', 'Lane', 'Drive'])}", f"{own}straße {number}", f"{number} rue {own}", f"Calle {own} {number}"]), ""

    def identity() -> tuple[str, str, str]:
        iban = pick(["DE", "FR", "ES", "GB"]) + digits(2)
        return pick([("SSN ", f"{digits(3)}-{digits(2)}-{digits(4)}", ""), ("passport no. ", drawn("CFGHJK", 1) + digits(8), ""), ("", f"{iban} {digits(4)} {digits(4)} {digits(4)} {digits(4)} {digits(2)}", ""), ("IBAN ", iban + digits(18), "")])

    def plain() -> str:
        return pick([
            digits(int(rng.integers(1, 6))), f"{digits(2)}.{digits(2)}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(1)}", f"({word()})", f"{word(2, 5)}-{word(2, 5)}/{digits(2)}",
            f"version {digits(1)}.{digits(1)}.", f"Licensed under the {word(4, 8).capitalize()} License, Version 2.0.", f"under CC BY-NC {digits(1)}.0.", f"https://{word(3, 7)}.org/{word(2, 6)}", f"{digits(2)}:{digits(2)}", f"${digits(2)}.{digits(2)}",
            f"the token {prose()}", f"a password {prose()}", f"Dear {word(3, 8)}", f"the street {prose()}", f"({digits(3)})", f"{word(2, 5).upper()}-{digits(4)}", f"{prose()} | {prose()} |", f"{word()} = {word()}", f'"{word()}"', f"{word(3, 8).capitalize()} {word(3, 8).capitalize()}", f"in {digits(4)}",
            " ".join([word(2, 9).capitalize() + pick(["", "", ".", ","])] * int(rng.integers(2, 14))), f"Dear {word(2, 5)} {word(3, 8)}", f"{digits(2)} {word(4, 8).capitalize()} {word(4, 8).capitalize()}", f"{digits(2)} {word(3, 8).capitalize()}", f"{word(2, 6)} {word(2, 3)}. {word(3, 8).capitalize()} {word()}", f"{word(1, 3).capitalize()}. {word(3, 9).capitalize()}", f"{word(3, 7)}.{word(1, 4).capitalize()}. {prose()}",
        ])

    made = {"email": email, "phone": phone, "card": card, "ip": ip, "secret": secret, "name": name, "address": address, "id": identity}
    kinds = list(made)
    rows = []
    for i in range(n):
        parts: list[tuple[str, str, str, str | None]] = [("", prose(), "", None) for _ in range(rng.integers(2, 14))]
        put = lambda *x: parts.insert(int(rng.integers(0, len(parts) + 1)), x)
        for _ in range(int(rng.integers(0, 3))):
            put("", plain(), "", None)
        if i % 3:
            put(*made[kinds[i % 8]](), kinds[i % 8])
        # Some texts have a mark after every part, some are in capitals.
        ending = pick(["###", "$$$", "%%%", "&&&", "***", "!!", " |"]) if rng.random() < 0.15 else ""
        text, spans = "", []
        for before, part, after, kind in parts:
            text += (" " if text else "") + before
            if kind:
                spans.append((kind, len(text), len(text) + len(part)))
            text += part + after + ending
        rows.append((text.upper() if rng.random() < 0.08 and "ß" not in text else text, spans))
    return rows


@dataclass
class Crf:
    """known: for each of KNOWN the sorted hashes that have a place of their own, 1 and up; weights: for
    each of SLOTS (value, label); step: (label, next label)."""

    known: dict[str, np.ndarray]
    weights: list[np.ndarray]
    step: np.ndarray

    def ids(self, words: Words) -> list[np.ndarray]:
        """The value of every slot for every word. The last row of a slot stands for no word there."""
        found = described(words)
        for name in KNOWN:
            known, h = self.known[name], found[name]
            at = np.minimum(np.searchsorted(known, h), len(known) - 1) if len(known) else np.zeros(len(h), np.int64)
            found[name] = np.where(known[at] == h, at + 1, 0) if len(known) else at
        return [shifted(found[name], words.first, by, len(w) - 1) for (name, by), w in zip(SLOTS, self.weights)]

    def scored(self, slots: list[np.ndarray]) -> np.ndarray:
        total = np.zeros((len(slots[0]), len(LABELS)), np.float32)
        for ids, w in zip(slots, self.weights):
            total += w[ids]
        return total

    def scores(self, words: Words) -> np.ndarray:
        return self.scored(self.ids(words))


def train(examples: list[tuple[str, list[Span]]], rounds: int = 100, rate: float = 0.2, l2: float = 1e-4) -> Crf:
    """Maximum conditional likelihood by Adam; forward-backward over all examples as one padded batch."""
    words = Words(*text_buffers(pa.array([t for t, _ in examples], pa.string())))
    row, place = words.rows(), np.arange(len(words)) - np.repeat(words.first[:-1], words.counts())
    label = np.zeros(len(words), np.int64)
    starts, ends = code_points(words)
    for r, (_, spans) in enumerate(examples):
        own = slice(words.first[r], words.first[r + 1])
        for kind, a, b in spans:
            label[own][(starts[own] < b) & (ends[own] > a)] = ORDER[kind]
    known = {}
    found = described(words)
    for name in KNOWN:
        values, times = np.unique(found[name], return_counts=True)
        known[name] = values[times >= LEAST]
    k = len(LABELS)
    size = {"cue": 16, "shape": N_SHAPES, "runs": 16} | {name: len(v) + 1 for name, v in known.items()}
    model = Crf(known, [np.zeros((size[name] + 1, k), np.float32) for name, _ in SLOTS], np.zeros((k, k), np.float32))
    slots = model.ids(words)
    n, longest = len(examples), int(words.counts().max())
    mask = np.zeros((n, longest), bool)
    mask[row, place] = True
    gold = np.zeros((n, longest), np.int64)
    gold[row, place] = label
    one_hot = np.eye(k)
    params = [*model.weights, model.step]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    seen_step = np.zeros((k, k))
    pairs = mask[:, 1:]
    np.add.at(seen_step, (gold[:, :-1][pairs], gold[:, 1:][pairs]), 1)
    for t in range(1, rounds + 1):
        emit = np.zeros((n, longest, k))
        emit[row, place] = model.scored(slots)
        likely, step = np.exp(emit - emit.max(2, keepdims=True)), np.exp(model.step.astype(np.float64))
        forward, scale = np.empty_like(likely), np.ones((n, longest, 1))
        forward[:, 0] = likely[:, 0] / likely[:, 0].sum(1, keepdims=True)
        for i in range(1, longest):
            new = forward[:, i - 1] @ step * likely[:, i]
            scale[:, i] = np.where(mask[:, i, None], new.sum(1, keepdims=True), 1.0)
            forward[:, i] = np.where(mask[:, i, None], new / scale[:, i], forward[:, i - 1])
        backward, expected_step = np.ones_like(likely), np.zeros((k, k))
        for i in range(longest - 1, 0, -1):
            ahead = np.where(mask[:, i, None], likely[:, i] * backward[:, i] / scale[:, i], 0.0)
            backward[:, i - 1] = np.where(mask[:, i, None], ahead @ step.T, 1.0)
            expected_step += step * (forward[:, i - 1].T @ ahead)
        marginal = (forward * backward)[row, place]
        gap = one_hot[label] - marginal
        grads = []
        for ids, p in zip(slots, model.weights):
            g = np.stack([np.bincount(ids, gap[:, j], len(p)) for j in range(k)], 1)
            grads.append(g / n - l2 * p)
        grads.append((seen_step - expected_step) / n - l2 * model.step)
        for j, (p, g) in enumerate(zip(params, grads)):
            m[j], v[j] = 0.9 * m[j] + 0.1 * g, 0.999 * v[j] + 0.001 * g * g
            p += (rate * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    cue, shape = (model.weights[SLOTS.index((name, 0))] for name in ("cue", "shape"))
    have = np.arange(len(cue))
    cue[have & SALUTED == 0, ORDER["name"]] -= UNCUED
    cue[have & STREET == 0, ORDER["address"]] -= UNCUED
    shape[:, 0] += CAUTION
    # A shape never seen in training is "other": nothing speaks for personal data.
    shape[~np.isin(np.arange(N_SHAPES + 1), slots[SLOTS.index(("shape", 0))])] = np.where(np.arange(k) == 0, 12.0, 0.0)
    return model


@lru_cache(maxsize=1)
def default_model() -> Crf:
    return train(labelled_examples())


def viterbi(scores: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Best labels of a (sequences, length, labels) batch."""
    best, back = scores[:, 0], []
    for i in range(1, scores.shape[1]):
        via = best[:, :, None] + step
        back.append(via.argmax(1))
        best = via.max(1) + scores[:, i]
    out = [best.argmax(1)]
    for pointers in reversed(back):
        out.append(np.take_along_axis(pointers, out[-1][:, None], 1)[:, 0])
    return np.stack(out[::-1], 1)


def decode(model: Crf, words: Words) -> np.ndarray:
    """The best label of each word; rows are sequences."""
    labels, first = np.zeros(len(words), np.int64), words.first
    if not len(words):
        return labels
    scores = model.scores(words)
    step = model.step
    # What putting another label than "other" in one place can gain by its two transitions.
    gain = np.maximum((step - step[:, :1]).max(0), 0) + np.maximum((step - step[:1]).max(1), 0)
    sure = (scores[:, :1] - scores > gain)[:, 1:].all(1)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    open_ = np.flatnonzero(~sure)
    if not len(open_):
        return labels
    # Stretches of open words, each with the sure word on either side as a fixed "other".
    new = np.ones(len(open_), bool)
    new[1:] = (np.diff(open_) > 1) | (np.diff(row[open_]) > 0)
    begin, end = open_[new], open_[np.append(new[1:], True)] + 1
    has_left, has_right = begin > first[row[begin]], end < first[row[begin] + 1]
    lengths = end - begin
    for n in np.unique(lengths):
        for chunk in np.array_split(np.flatnonzero(lengths == n), -(-int((lengths == n).sum()) * int(n) // 100_000) or 1):
            at = begin[chunk][:, None] + np.arange(n)
            batch = scores[at].copy()
            batch[:, 0] += np.where(has_left[chunk, None], step[0], 0.0)
            batch[:, -1] += np.where(has_right[chunk, None], step[:, 0], 0.0)
            labels[at] = viterbi(batch, step)
    return labels


EDGE = ".,;:!?\"'`<>{}#$%&*|"


def passes(kind: str, value: str) -> bool:
    """Checksums and ranges, which no model of shapes can see."""
    if kind == "card":
        digits = re.sub(r"[^0-9]", "", value)
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "ip":
        parts = value.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) < 4 and int(p) <= 255 for p in parts)
    return True


def code_points(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word in code points of its row."""
    lead = np.concatenate(([0], np.cumsum((words.data & 0xC0) != 0x80)))
    begin = np.repeat(lead[words.offsets[:-1]], words.counts())
    return lead[words.start] - begin, lead[words.end] - begin


def crf_spans(text: str, starts: np.ndarray, ends: np.ndarray, labels: np.ndarray, taken: list[Span]) -> list[Span]:
    """Runs of one label as spans (code points), trimmed; those that overlap `taken` (by start) or fail their checksum fall away."""
    out = []
    begins = [x for _, x, _ in taken]
    reach = list(accumulate((y for _, _, y in taken), max))  # how far the spans up to each go
    change = np.flatnonzero(np.diff(labels, prepend=-1))
    for i, j in zip(change.tolist(), [*change[1:].tolist(), len(labels)]):
        if not labels[i]:
            continue
        a, b = int(starts[i]), int(ends[j - 1])
        while a < b and text[a] in EDGE:
            a += 1
        while a < b and text[b - 1] in EDGE:
            b -= 1
        kind = LABELS[labels[i]]
        before = bisect_left(begins, b)
        if a < b and passes(kind, text[a:b]) and not (before and reach[before - 1] > a):
            out.append((kind, a, b))
    return out


def spans_of(texts: pa.Array, model: Crf) -> Iterator[tuple[str, list[Span], list[Span]]]:
    """(text, base spans, all spans) of each row."""
    for lo, hi in text_chunks(texts):
        words = Words(*text_buffers(texts.slice(lo, hi - lo)))
        labels = decode(model, words)
        begin, end = code_points(words)
        hit = np.zeros(hi - lo, bool)
        hit[words.rows()[labels > 0]] = True
        for r, own in enumerate(texts.slice(lo, hi - lo).to_pylist()):
            own = own or ""
            base = base_spans(own)
            at = slice(words.first[r], words.first[r + 1])
            more = crf_spans(own, begin[at], end[at], labels[at], base) if hit[r] else []
            yield own, base, ordered(base + more)


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find(docs: DataFrame, model: Crf | None = None, text: str = "text") -> DataFrame:
    """docs plus base and spans: arrays of (kind, start, end) in code points, end exclusive."""
    model = model or default_model()
    spans = "array<struct<kind:string,start:bigint,end:bigint>>"

    @F.arrow_udf(f"struct<base:{spans},spans:{spans}>")
    def search(texts: pa.Array) -> pa.Array:
        listed = lambda found: [{"kind": k, "start": a, "end": b} for k, a, b in found]
        base, every = [], []
        for _, own, more in spans_of(texts, model):
            base.append(listed(own))
            every.append(listed(more))
        return pa.StructArray.from_arrays([pa.array(base, SPANS), pa.array(every, SPANS)], ["base", "spans"])

    own = [search(F.col(text)).alias("found"), F.struct("*").alias("row")]
    return bounded(docs).select(*own).select(*others(docs, "base", "spans", prefix="row."), "found.base", "found.spans")


def replaced(text: str, spans: list[Span]) -> str:
    """Every span's characters replaced by [KIND]; overlapping spans become one, of the first's kind."""
    parts, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(parts) + text[at:]


def mask(docs: DataFrame, model: Crf | None = None, text: str = "text") -> DataFrame:
    """docs with personal data in the text replaced by [KIND]; null texts stay null."""
    model = model or default_model()

    @F.arrow_udf("string")
    def masked(texts: pa.Array) -> pa.Array:
        out = [replaced(own, spans) for own, _, spans in spans_of(texts, model)]
        return pa.array([x if ok else None for x, ok in zip(out, texts.is_valid().to_pylist())], pa.string())

    return bounded(docs).select(*[masked(F.col(text)).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
