"""Toxicity: logistic regression over hashed words, regularised by counterfactuals.

Features of a text are the presence of its lower-cased words and of their first bytes, as
many as each of PREFIXES says.
Identity terms are words that stand in for each other: a seed of groups (IDENTITY_GROUPS), and pairs
learned from the labelled texts (`interchangeable`): words that are about as frequent in both labels and
occur in like contexts. Where a labelled text mentions such a term, a copy with the term swapped for
another of its group is made, and the squared change of the score between the two is penalised: a
mention alone can then not move the score, which keeps neutral mentions from being flagged.

The classifier is fitted on the driver on at most `max_rows` labelled rows, those with the
smallest hashes of their ids; scoring covers every text.

Defined results: null and empty texts have no features and get the score of the intercept; very long texts
are scored whole, in chunks; ties of words go by the alphabet; repeated rows get equal scores; without
labelled rows every score is 0; an empty table gives an empty table; other columns pass through, one
named as the result is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.textops import Words, bounded, lower_ascii, mix, others, text_buffers, text_chunks
from weftline.session import materialize

BITS, PREFIXES = 18, (4, 6)
MAX_ROWS = 12_000
#: Learned pairs: words in this share of the labelled rows, as frequent in one label as in the other but for
#: this factor, whose contexts have this cosine; so many words are tried, each by so many frequent neighbours.
SHARE, BALANCE, ALIKE, TRIED, NEIGHBOURS = (0.01, 0.4), 1.5, 0.6, 300, 300

#: Terms of one group stand in for each other in counterfactuals.
IDENTITY_GROUPS: tuple[tuple[str, ...], ...] = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual", "queer", "heterosexual", "transgender", "cisgender"),
    ("women", "men"),
    ("woman", "man"),
    ("female", "male"),
    ("immigrants", "refugees", "foreigners", "locals"),
    ("disabled", "deaf", "blind", "autistic"),
    ("old", "young", "elderly"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
)


def feature_ids(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs, sorted by row then feature."""
    data, offsets = text_buffers(texts)
    letters = (data >= 128) | ((data >= 65) & (data <= 90)) | ((data >= 97) & (data <= 122))
    words = Words(np.where(letters, lower_ascii(data), 32).astype(np.uint8), offsets)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = words.rows().astype(np.uint64)
    kinds = [words.hashes(), *[mix(words.hashes(n) + np.uint64(n)) for n in PREFIXES]]
    both = np.unique(np.concatenate([row << np.uint64(BITS) | h >> np.uint64(64 - BITS) for h in kinds])).astype(np.int64)
    return both >> BITS, both & ((1 << BITS) - 1)


Groups = tuple[tuple[str, ...], ...]


def swapped(text: str, groups: Groups = IDENTITY_GROUPS) -> str | None:
    """text with each identity term replaced by another of its group; None if it has none. The text
    itself picks which."""
    place = {t: (g, i) for g in groups for i, t in enumerate(g)}
    turn, hit = crc32(text.encode()), False

    def other(m: re.Match) -> str:
        nonlocal hit
        found = place.get(m[0].lower())
        if not found:
            return m[0]
        hit = True
        group, i = found
        return group[(i + 1 + turn % (len(group) - 1)) % len(group)]

    out = re.sub(r"[^\W\d_]+", other, text)
    return out if hit else None


def interchangeable(texts: DataFrame) -> Groups:
    """Pairs of words of the labelled texts (toxic, text) that may stand in for each other, the most alike
    first; a word is in one pair at most. Counting is Spark's; what comes to the driver is bounded by
    TRIED and NEIGHBOURS."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))
    rows = texts.select("toxic", words.alias("words"))
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not toxic or toxic == n:
        return ()
    held = rows.select("toxic", F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("df"), F.sum("toxic").alias("bad"))
    bad, good = F.col("bad") * (n - toxic), (F.col("df") - F.col("bad")) * toxic
    fit = held.filter((F.col("df") >= max(5.0, SHARE[0] * n)) & (F.col("df") <= SHARE[1] * n) & (bad <= BALANCE * good) & (good <= BALANCE * bad))
    tried = fit.orderBy(F.desc("df"), "word").limit(TRIED).select("word")
    near = held.orderBy(F.desc("df"), "word").limit(NEIGHBOURS).select(F.col("word").alias("near"))
    places = F.transform("words", lambda w, i: F.struct(w.alias("word"), F.get("words", i - 1).alias("before"), F.get("words", i + 1).alias("after")))
    each = rows.select(F.explode(places).alias("p")).select("p.*").join(F.broadcast(tried), "word")
    sides = each.select("word", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("before").alias("near")), F.struct(F.lit(1).alias("side"), F.col("after").alias("near")))).alias("c"))
    counts = sides.select("word", "c.side", "c.near").join(F.broadcast(near), "near").groupBy("word", "side", "near").count().toPandas()
    if counts.empty:
        return ()
    names = sorted(counts["word"].unique())
    context = sorted(set(zip(counts["side"], counts["near"])))
    at, column = {w: i for i, w in enumerate(names)}, {c: i for i, c in enumerate(context)}
    matrix = np.zeros((len(names), len(context)))
    for word, side, other, k in counts[["word", "side", "near", "count"]].itertuples(index=False):
        matrix[at[word], column[side, other]] = np.sqrt(k)
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    like = np.triu(matrix @ matrix.T, 1)
    pairs, used = [], set()
    for i, j in sorted(zip(*np.nonzero(like >= ALIKE)), key=lambda x: (-like[x], x)):
        if i not in used and j not in used:
            used |= {i, j}
            pairs.append((names[i], names[j]))
    return tuple(pairs)


@dataclass
class Model:
    """pairs: labelled texts that had a counterfactual; change: the mean change of the score's logit between the two."""

    weights: np.ndarray
    intercept: float
    groups: Groups = ()
    pairs: int = 0
    change: float = 0.0

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Probability of toxic for each text."""
        out = np.empty(len(texts))
        for lo, hi in text_chunks(texts):
            row, feature = feature_ids(texts.slice(lo, hi - lo))
            out[lo:hi] = np.bincount(row, self.weights[feature], hi - lo)
        return 1 / (1 + np.exp(-np.clip(out + self.intercept, -500, 500)))


@dataclass
class Examples:
    """Labelled rows: label, and the flat features of all rows with the number of each row's; the
    same of those that the row's counterfactual loses and gains."""

    label: np.ndarray
    features: tuple[np.ndarray, np.ndarray]
    lost: tuple[np.ndarray, np.ndarray]
    gained: tuple[np.ndarray, np.ndarray]

    @classmethod
    def of(cls, rows: list[tuple[np.ndarray, int, np.ndarray, np.ndarray]]) -> "Examples":
        """From (features, label, lost, gained) of each row."""
        flat = [(np.concatenate([r[i] for r in rows]).astype(np.int32), np.array([len(r[i]) for r in rows])) for i in (0, 2, 3)]
        return cls(np.array([r[1] for r in rows], np.float64), *flat)


def row_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values)))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def fit(rows: Examples, rounds: int = 100, rate: float = 0.1, l2: float = 1e-3, fairness: float = 1.0, least: int = 3, most_weight: float = 6.0, block: int = 1000) -> Model:
    """Adam on mean log loss + l2 |w|^2 + fairness * mean squared score change. Features of fewer
    than `least` rows keep the weight 0; toxic rows, the rarer ones, count up to `most_weight`
    times. Gradients are summed over blocks of rows, which bounds the memory beside the features'."""
    n_features, y = 1 << BITS, rows.label
    if not len(y):
        return Model(np.zeros(n_features), -800.0)
    feature, counts = rows.features
    weight = np.where(y > 0, min(most_weight, max(1.0, (len(y) - y.sum()) / max(1.0, y.sum()))), 1.0)
    used = np.bincount(feature, minlength=n_features) >= least
    for flat, _ in (rows.lost, rows.gained):
        used |= np.bincount(flat, minlength=n_features) > 0
    place = np.where(used, np.cumsum(used), 0).astype(np.int32)  # 0: a feature without a weight
    n = int(used.sum()) + 1
    ends = np.cumsum(counts)
    changed = [(place[flat], c, sign) for (flat, c), sign in ((rows.lost, 1.0), (rows.gained, -1.0))]
    n_pairs = max(1, int(np.count_nonzero(rows.lost[1] + rows.gained[1])))
    w, b = np.zeros(n), 0.0
    m, v, mb, vb = np.zeros(n), np.zeros(n), 0.0, 0.0
    for t in range(1, rounds + 1):
        g, gb = 2 * l2 * w, 0.0
        for lo in range(0, len(y), block):
            hi = min(lo + block, len(y))
            f = place[feature[ends[lo] - counts[lo] : ends[hi - 1]]]
            z = row_sums(w[f], counts[lo:hi]) + b
            gap = weight[lo:hi] * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y[lo:hi])
            g += np.bincount(f, np.repeat(gap, counts[lo:hi]), n) / len(y)
            gb += gap.sum() / len(y)
        delta = sum(sign * row_sums(w[f], c) for f, c, sign in changed)
        for f, c, sign in changed:
            g += 2 * fairness * np.bincount(f, sign * np.repeat(delta, c), n) / n_pairs
        g[0] = 0.0
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    delta = sum(sign * row_sums(w[f], c) for f, c, sign in changed)
    pairs = int(np.count_nonzero(rows.lost[1] + rows.gained[1]))
    return Model(w[place], float(b), pairs=pairs, change=float(np.abs(delta).sum() / n_pairs))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, **how) -> Model:
    """A model from labelled rows outside the held-out fold. The ids of at most max_rows of them,
    a table of bounded size, are broadcast to pick their texts."""
    chosen = labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")
    texts = materialize(texts, "labelled")
    groups = IDENTITY_GROUPS + interchangeable(texts)
    names = ["digest", "toxic", "features", "lost", "gained"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                own = part.column(2).to_pylist()
                other = [swapped(t, groups) for t in own]
                sets = []
                for column in (part.column(2), pa.array([o or "" for o in other], pa.string())):
                    row, feature = feature_ids(column)
                    sets.append(np.split(feature, np.searchsorted(row, np.arange(1, len(own)))))
                lost = [np.setdiff1d(a, b) if o is not None else a[:0] for a, b, o in zip(*sets, other)]
                gained = [np.setdiff1d(b, a) if o is not None else a[:0] for a, b, o in zip(*sets, other)]
                made = [pa.array([x.astype(np.int32).tobytes() for x in col], pa.binary()) for col in (sets[0], lost, gained)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], names)

    got = texts.select(F.sha2("text", 256).alias("digest"), "toxic", "text").mapInArrow(run, "digest string, toxic int, features binary, lost binary, gained binary")
    rows = got.toArrow().sort_by([("digest", "ascending"), ("toxic", "ascending")])

    def flat(name: str) -> tuple[np.ndarray, np.ndarray]:
        column = rows.column(name)
        parts = [np.frombuffer(x.as_buffer(), np.int32) for c in column.chunks for x in c]
        return np.concatenate([np.zeros(0, np.int32), *parts]), np.array([len(x) for x in parts], np.int64)

    model = fit(Examples(rows.column("toxic").to_numpy().astype(np.float64), flat("features"), flat("lost"), flat("gained")), **how)
    return replace(model, groups=groups)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """docs plus the probability of toxic."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores(texts), pa.float64())

    return bounded(docs).select(*others(docs, name), scored(F.coalesce(F.col(text), F.lit(""))).alias(name))
