"""Collocations, prefix-free dedup and lexical search against SQL, brute force and odd inputs."""

import math
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from weftline.llm import collocations, lexical_search, prefix_free, queries

SCHEMA = "doc_id long, text string, lang string"


def sql(folder: str, query: str) -> list[tuple]:
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return sorted(con.execute(query).fetchall())


@pytest.mark.parametrize("name", ["op11_collocations", "op13_lexical_search"])
@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, name, folder):
    found = queries.QUERIES[name](spark, f"/root/testdata/{folder}")
    want = sql(f"/root/testdata/{folder}", queries.ORACLES[name])
    assert want and sorted(map(tuple, found.collect())) == want


# Collocations


def prose(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    words = ["New", "york", "city", "a", "der", "état", "x1", "#tag", " ", "한글", "\x1cz"]
    mark = [" ", "  ", "\t", ". ", "\n", ", ", "\r\n", "\v", ";"]
    texts = ["".join(rng.choice(words) + rng.choices(mark, [20, 3, 2, 2, 1, 1, 1, 1, 1])[0] for _ in range(rng.randint(0, 120))) for _ in range(n)]
    return [(i, t, rng.choice(["en", "de", None, "und", ""])) for i, t in enumerate(texts)] + [(n, None, "en"), (n, "", None), (0, texts[0], "en"), (n + 1, "new york " * 200, "en")]


def mined(rows: list[tuple], least: int, top: int) -> list[tuple]:
    """The definition, in plain Python."""
    f: Counter = Counter()
    for _, text, lang in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            for k in range(1, 5):
                f.update((lang if lang is not None else "und", tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    total = Counter()
    for (lang, p), a in f.items():
        total[lang] += a * (len(p) == 1)
    good = {x: a for x, a in f.items() if a >= least and len(x[1]) > 1}
    inside = lambda p, q: len(p) < len(q) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
    out = []
    for (lang, p), a in good.items():
        if any(la == lang and inside(p, q) and 100 * b >= 80 * a for (la, q), b in good.items()):
            continue
        cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        out.append((lang, -score, -a, " ".join(p).encode(), left, right, total[lang]))
    ranked, rank = [], Counter()
    for lang, score, a, p, left, right, n in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            ranked.append((lang, rank[lang], p.decode(), -a, left, right, n, -score))
    return sorted(ranked)


@pytest.mark.parametrize("top", [5, 2000])
def test_collocations_equal_the_definition(spark, top):
    rows = prose(3, 160)
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"phrase": F.lit(1), "f": F.lit("x"), "k": F.lit(2)}).repartition(6)
    want = mined(rows, 12, top)
    assert len({r[0] for r in want}) >= 3
    assert sorted(map(tuple, collocations.collocations(docs, 12, top=top).collect())) == want


def test_full_sketch_loses_nothing(spark, monkeypatch):
    """Eight cells: all counters are full and every phrase survives, the exact counts decide."""
    docs = spark.createDataFrame(prose(4, 60), SCHEMA)
    found = lambda width: {tuple(r) for r in collocations.frequent(docs, 8, width=width).collect()}
    want, full = found(1 << 20), found(8)
    # Words that no phrase holds may come along, no phrase may.
    assert want <= full and {r for r in full if r[2] != 1} == {r for r in want if r[2] != 1}
    monkeypatch.setattr(collocations, "HELD", 3)
    assert found(1 << 20) == want


def test_sketch_drops_rare_runs(spark):
    """Of many distinct pairs just the frequent ones, and few by chance, survive the sketch."""
    rows = [(i, f"a{i} b{i} c{i}. big deal", "en") for i in range(5000)]
    own = spark.createDataFrame(rows, SCHEMA).select("lang", "text")
    alive = collocations.sketch(own, 1 << 16, 30, 4, None)
    pieces = collocations.Pieces(*(own.limit(2000).toArrow().combine_chunks().column(i).combine_chunks() for i in (0, 1)))
    first, hashes = pieces.runs(2)
    kept = {pieces.phrase(i, 2, pieces.data.tobytes()) for i in first[alive(hashes)].tolist()}
    assert "big deal" in kept and len(kept) < 20


def test_large_counts_are_exact(spark):
    counts = spark.createDataFrame([("en", "a", 1, 6 * 10**15), ("en", "b", 1, 7 * 10**15), ("en", "a b", 2, 5 * 10**15)], "lang string, phrase string, k int, f long")
    row = collocations.scored(counts).first()
    assert row.score == 2_000_000 * 5 * 10**15 // (13 * 10**15)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).collect() == []


# Prefix-free dedup


def copies(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    prose = lambda n: "".join(rng.choice("abcdé ñ한") for _ in range(n))
    base, line = prose(400), "a line that very many of the documents hold, " * 2
    texts = [None, "", "short", base, base, base[:200] + "X" + base[201:], prose(90) + line + prose(70), line, "a" * 500, "b" + "a" * 700, "ab" * 400, prose(49), prose(50)]
    texts += [prose(rng.randint(0, 80)) + line + prose(rng.randint(0, 60)) for _ in range(30)]
    texts += [base[i : i + 49 + i % 3] for i in range(0, 300, 7)] + [base + base, prose(6000) + base[100:180]]
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


def cut(docs) -> dict:
    return {r[0]: tuple(r[1:]) for r in prefix_free.deduplicate(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()}


@pytest.mark.parametrize("group,piece", [(prefix_free.GROUP_BYTES, prefix_free.SLICE), (300, 500), (0, 70)])
def test_prefix_free_equals_brute_force(spark, monkeypatch, group, piece):
    """With whole groups, with split triggers, and with long texts in slices."""
    monkeypatch.setattr(prefix_free, "GROUP_BYTES", group)
    monkeypatch.setattr(prefix_free, "SLICE", piece)
    rows = copies(group)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = prefix_free.brute_force(rows)
    assert sum(x[1] for x in want.values()) > 1000
    assert cut(docs) == want


def test_prefix_free_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    found = queries.op12_prefix_free_dedup(spark, folder)
    assert {r[0]: tuple(r[1:]) for r in found.collect()} == prefix_free.brute_force(rows)


def test_prefix_free_odd_rows(spark):
    text = "".join(random.Random(9).choice("abcdefgh ") for _ in range(120))
    rows = [(None, text, 1), (1, text, 2), (1, text, 2), (2, text[:80] + "other", 3), (2, text[40:], 4), (2, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int").withColumns({"sub": F.lit(1), "at": F.lit(1), "trigger": F.lit("x"), "row": F.lit(0), "places": F.lit(2), "cut": F.lit(0)})
    found = prefix_free.deduplicate(docs)
    assert {"sub", "at", "trigger", "row", "places", "cut", "kept"} <= set(found.columns)
    removed = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in found.collect())
    assert removed == [("1", 120, 120), ("1", 120, 120), ("2", 0, 0), ("2", 80, 80), ("2", 85, 80), ("None", 120, 0)]
    assert prefix_free.deduplicate(docs.limit(0)).collect() == []
    short = prefix_free.shortened(docs.select("doc_id", "text", F.length("text").cast("long").alias("n_chars"))).collect()
    assert sorted((str(r.doc_id), r.text, r.n_chars) for r in short if r.doc_id == 2 and r.text is not None) == [("2", "", 0), ("2", "other", 5)]


def test_suffix_order():
    contents = [b"banana", b"ananas", b"nanab"]
    row, offset, same, n = prefix_free.suffix_order(contents, 3)
    suffixes = [contents[r][o : o + 3] for r, o in zip(row, offset)]
    assert suffixes == sorted(c[i : i + 3] for c in contents for i in range(len(c) - 2))
    assert same.tolist() == [i > 0 and suffixes[i] == suffixes[i - 1] for i in range(len(suffixes))] and n.tolist() == [4, 4, 3]


# Lexical search


def searched(docs: list[tuple], items: list[tuple], k: int = 10) -> list[tuple]:
    """The definition, in plain Python."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    held = [(d, Counter(split(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    total, df = sum(c.total() for _, c in held), Counter(w for _, c in held for w in c)
    out = []
    for item, text in {(i, t): None for i, t in items}:
        scores = []
        for d, c in held:
            m = 25 + 75 * c.total() * len(held) // total
            score = sum(math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m)) for w in split(text) if c[w])
            if score > 0:
                scores.append((-score, -1 if d is None else d, d))
        out += [(item, rank, d, -s) for rank, (s, _, d) in enumerate(sorted(scores, key=lambda x: x[:2])[:k], 1)]
    return sorted(out, key=str)


def collection(seed: int, n: int) -> tuple[list[tuple], list[tuple]]:
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.6)) % 900}" for _ in range(3000)] + ["Über", "straße", "한글", "x_y", "a-b"]
    make = lambda k: rng.choice([" ", ", ", "_", "\x00"]).join(rng.choices(vocabulary, k=k))
    docs = [(i, make(rng.choice([0, 1, 5, 60, 300]))) for i in range(n)] + [(None, make(30)), (n, None), (3, make(8)), (3, make(8))]
    items = [(i, make(rng.randint(1, 25))) for i in range(25)] + [(50, None), (51, "nowhere"), (0, make(4)), (None, make(3))]
    return docs + docs[:2], items + items[:2]


@pytest.mark.parametrize("rows,shares", [(1000, (1 / 8, 1 / 2)), (7, (1 / 50, 1 / 3)), (1, (0.4, 0.6))])
def test_lexical_search_equals_the_definition(spark, monkeypatch, rows, shares):
    """Shards of many documents, of a few and of one; small upper tiers leave proof to the bounds."""
    monkeypatch.setattr(lexical_search, "SHARES", shares)
    monkeypatch.setattr(lexical_search, "SHARD_BYTES", 400 * rows)
    docs, items = collection(rows, 150)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit(1), "ids": F.lit(2)}).repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("x"))
    found = lexical_search.ranked(d, i)
    assert sorted((tuple(r)[:4] for r in found.collect()), key=str) == searched(docs, items)
    assert lexical_search.ranked(d.limit(0), i).collect() == [] and lexical_search.ranked(d, i.limit(0)).collect() == []


def test_proof_settles_in_upper_tiers(spark):
    """Items with a clear best leave most shards at the first tier, with the same result as without any tier."""
    rng = random.Random(8)
    rows = [(n, " ".join([f"rare{n % 40}"] * (30 if n < 80 else 1) + rng.choices(["the", "of", "and"], k=60))) for n in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    query = lexical_search.Query.of([f"rare{n}" for n in range(20, 40)])
    index = lexical_search.build(docs)
    query = index.weighed(query)
    bounds = index.thresholds(query, 2)
    assert (bounds > 0).all()
    tiers = [lexical_search.Shard(r.asDict(), query).settle(i, int(b), 2)[0] for r in index.table.collect() for i, b in enumerate(bounds)]
    assert set(tiers) == {0}


def test_items_in_blocks(spark, monkeypatch):
    docs, items = collection(5, 80)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(lexical_search, "BLOCK_ITEMS", 7)
    assert sorted((tuple(r)[:4] for r in lexical_search.ranked(d, i).collect()), key=str) == searched(docs, items)
