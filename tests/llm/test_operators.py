"""The operators on Spark: contract digests against plain Python, and odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from weftline.llm.components import components
from weftline.llm import chat, html_consensus, jaccard, matroska, packing, pii, quality, queries, sentencepiece_trie, substring, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for their own columns.
CLASHES = "n_words n_removed kept base spans n_shingles component_id score label id grp token n a b class part item media words base_failed n_symbols ids decoded row row_id host path cut found number sub places".split()


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def odd_texts() -> list[tuple]:
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(1, 8))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    base, passage = prose(160), prose(40)
    near = base.split()
    near[80] = "changed"
    texts = [None, "", " \n\t ", "one", "two words", "é à 한글 😀 " * 8, base, base, base.upper(), " ".join(near)]
    texts += [f"{prose(70)} {passage} {prose(60)}" for _ in range(4)] + [prose(12_000), "same line\n" * 60, "x " * 300]
    texts += [f"{prose(55)} mail me a.b@example.org or +1 (212) 555-0199, 10.0.0.1, 4111 1111 1111 1111", "#" * 50 + prose(51)]
    return [(i, t, "en", "src0", None if t is None else len(t)) for i, t in enumerate(texts)] + [(6, base, "en", "src1", len(base))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_texts(), SCHEMA)


@pytest.fixture(scope="module")
def model(spark, small):
    read = lambda name: spark.read.parquet(f"{small}/{name}.parquet")
    return toxicity.train(read("documents"), read("labels"), rounds=20)


def rows_of(spark, small) -> list[tuple]:
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{small}/documents.parquet").collect()]


def shingle_set(text: str) -> frozenset:
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def linked(rows: list[tuple]) -> dict:
    """doc_id: (set size, component) by comparing all that share a shingle."""
    sets, holders = {d: shingle_set(t or "") for d, t in rows}, defaultdict(list)
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d in sorted(sets):
        shared = Counter(e for s in sets[d] for e in holders[s])
        for s in sets[d]:
            holders[s].append(d)
        for e, n in shared.items():
            if 100 * n >= 75 * (len(sets[d]) + len(sets[e]) - n):
                x, y = root(d), root(e)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in sets}


def test_media_digests(spark, small):
    want = {}
    for d, text in rows_of(spark, small):
        raw = text.encode()
        padded = raw + bytes(64 * max(1, -(-len(raw) // 64)) - len(raw))
        want[d] = (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    got = queries.op1_matroska(spark, small).collect()
    assert {r.doc_id: (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got} == want
    assert all(r.media_bytes > r.payload_bytes and r.feature.startswith("codec=A_PCM") for r in got)
    stored = {r.doc_id: r.media for r in matroska.store_texts(spark.read.parquet(f"{small}/documents.parquet")).collect()}
    assert all(r.media_bytes == len(stored[r.doc_id]) and r.media_sha256 == hashlib.sha256(stored[r.doc_id]).hexdigest() for r in got)


def test_packet_table_holds_the_payload(spark, docs):
    files = matroska.store_texts(docs.filter("doc_id = 14"))
    data = files.first().media
    packets = matroska.packet_table(files).orderBy("packet").collect()
    payload = b"".join(data[p.offset : p.offset + p.size] for p in packets)
    assert payload == matroska.payload_of(odd_texts()[14][1])[1]
    assert [p.timestamp_ns for p in packets] == sorted(p.timestamp_ns for p in packets)


def test_chat_digests(spark, small):
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{small}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns[r.conv_id].append((r.role, r.text or ""))
    turns[-7] = [("user", queries.TRICKY), ("assistant", queries.TRICKY)]
    got = {r.conv_id: r for r in queries.op2_chat_formatting(spark, small).collect()}
    assert set(got) == set(turns)
    for key, own in turns.items():
        loss = "".join(t for role, t in own if role == "assistant")
        assert (got[key].n_turns, got[key].turns_sha256) == (len(own), sha("".join(f"{a}\n{t}\n" for a, t in own)))
        assert (got[key].loss_chars, got[key].loss_sha256) == (len(loss), sha(loss))
        control = lambda s, more="": re.sub(r"\\|###|</turn>" + more, lambda m: "\\" + m[0], s)
        assert got[key].formatted_chars == sum(len(f"### {control(role, '|:')}: {control(t)}</turn>\n") for role, t in own)


def test_jaccard_equals_brute_force(spark, small, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op3_ngram_jaccard(spark, small).collect()}
    assert got == linked(rows_of(spark, small))
    odd = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    assert odd == linked([(d, t) for d, t, *_ in odd_texts()])


def near_copies(n: int, most: int, seed: int = 8, length: int = 120) -> list[tuple]:
    """One text with up to `most` words changed in each row, some of the changes shared."""
    rng = random.Random(seed)
    base = [str(rng.randrange(10**6)) for _ in range(length)]
    rows = []
    for i in range(n):
        own = list(base)
        for _ in range(rng.randint(0, most)):
            own[rng.randrange(length)] = f"w{rng.choice([i, i % 7])}"
        rows.append((i, " ".join(own)))
    return rows


@pytest.mark.parametrize("most", [2, 9])
def test_jaccard_joins_a_large_group_of_near_copies(spark, monkeypatch, most):
    monkeypatch.setattr(jaccard, "PIVOT_FROM", 4)
    rows = near_copies(300, most)
    seen = []
    verified = jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda own, classes, candidates, *x: seen.append(candidates.count()) or verified(own, classes, candidates, *x))
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == linked(rows)
    assert sum(seen) < 12 * len(rows)  # far from all pairs


def test_jaccard_without_pivots_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PIVOT_FROM", 10**9)
    rows = near_copies(120, 9, 5)
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == linked(rows)


def test_jaccard_texts_of_one_id_are_one_document(spark):
    prose = lambda seed: " ".join(f"w{random.Random(seed).randrange(10**6)}{i}" for i in range(60))
    rows = [(5, prose(1)), (5, prose(2) + " more"), (3, prose(1)), (4, prose(2) + " more"), (9, "few")]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(5, 3), (3, 3), (4, 3), (9, 9)}
    assert {r.n_shingles for r in got if r.doc_id == 5} == {57}


def test_components_of_a_long_chain(spark):
    edges = spark.range(1, 3000).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    found = components(edges)
    assert found.count() == 3000 and found.select("label").distinct().collect() == [(0,)]


def test_jaccard_keeps_null_ids_apart(spark):
    rng = random.Random(11)
    prose = lambda: [f"w{rng.randrange(10**6)}" for _ in range(100)]
    numbered, clean, alone = prose(), prose(), prose()
    near = [*alone[:50], "changed", *alone[51:]]
    rows = [(7, numbered), (None, numbered), (None, clean), (None, alone), (None, near), (None, [])]
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    found = {(r.doc_id, r.text): (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    assert found == {(d, " ".join(w)): (max(len(w) - 4, 0), 7 if w is numbered else None) for d, w in rows}
    kept = [(r.doc_id, r.text) for r in jaccard.keep_first(docs).collect()]
    assert len(kept) == 4 and {(7, " ".join(numbered)), (None, " ".join(clean)), (None, "")} < set(kept)
    assert sum(t in (" ".join(alone), " ".join(near)) for _, t in kept) == 1


def test_cascade_verdict_does_not_depend_on_order(spark, docs):
    m = quality.measured()
    names = [r.name for r in quality.RULES]
    found = quality.split_once(docs, "text").select(quality.cascade(names, m).alias("x"), quality.cascade(names[::-1], m).alias("y")).collect()
    assert all(r.x == r.y for r in found)
    kept = sorted((r.doc_id, r.text) for r in quality.keep_good(docs).collect())
    assert kept == sorted((r.doc_id, r.text) for r in quality.judge(docs).filter("kept").collect())


def test_quality_equals_its_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{small}/documents.parquet')")
    got = queries.op4_quality_rules(spark, small)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLES['op4_quality_rules']})").fetchall()
    assert sorted(tuple(map(int, r)) for r in got.collect()) == sorted(tuple(map(int, r)) for r in want)


def test_order_is_greedy_by_rejections_of_the_rest_and_measured_cost(docs, monkeypatch):
    monkeypatch.setattr(quality, "timed", lambda sample: {n: 10.0 if n == "n_words" else 1.0 for n in quality.MEASURES})
    order = quality.order_rules(docs)
    assert {n for n, _, _ in order} == {r.name for r in quality.RULES}
    costs = {n: cost for n, _, cost in order}
    assert costs[order[0][0]] >= 1.0 and sum(cost >= 10.0 for cost in costs.values()) == 1  # n_words is paid for once
    monkeypatch.setattr(quality, "timed", lambda sample: {n: 1000.0 if n == "n_lines" else 0.001 for n in quality.MEASURES})
    late = [n for n, _, _ in quality.order_rules(docs)]
    assert late.index("few_words") < min(late.index(n) for n in ("dup_lines", "bullet_lines", "open_lines"))


def test_measures_are_timed(docs):
    assert set(quality.timed(quality.split_once(docs, "text"))) == set(quality.MEASURES)


def test_a_rejected_row_is_not_measured_further(spark, docs, monkeypatch):
    """A measure that raises is never taken for rows that an earlier rule rejects."""
    broken = quality.Rule("broken", ("bad",), lambda m: m["bad"] > 0)
    measures = {"n_words": quality.MEASURES["n_words"], "bad": lambda text, words: F.raise_error(F.lit("taken")).cast("long")}
    m = {n: make(F.col("text"), F.col("words")) for n, make in measures.items()}
    few = quality.split_once(docs.filter("length(text) < 40"), "text")
    rules = (quality.RULES[0], broken)
    assert few.select(quality.cascade(["few_words", "broken"], m, rules).alias("k")).filter("k").count() == 0
    with pytest.raises(Exception, match="taken"):
        few.select(quality.cascade(["broken", "few_words"], m, rules).alias("k")).collect()


def test_sentencepiece_equals_the_library(spark, docs):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(sentencepiece_trie.MODEL))
    back = sentencepiece_trie.decode(sentencepiece_trie.encode(docs, kind=None)).collect()
    assert all(r.ids is None if r.text is None else r.ids == library.encode(r.text) for r in back)
    assert all(r.decoded == r.text for r in back)


def test_sentencepiece_query_is_the_best_segmentation(spark, small):
    """Every text's ids by the query's own hash, against a Viterbi pass over each word alone."""
    own = sentencepiece_trie.pieces(sentencepiece_trie.MODEL, sentencepiece_trie.UNIGRAM)

    @lru_cache(None)
    def ids(word):
        best = [(0, 0, ())]
        for end in range(1, len(word) + 1):
            ways = [(best[s][0] + own.scores[word[s:end]], end - s, (*best[s][2], own.ids[word[s:end]])) for s in range(end) if word[s:end] in own.ids]
            if word[end - 1] not in own.ids:
                ways.append((best[-1][0] + own.unknown_score, 1, (*best[-1][2], *[own.byte_ids[b] for b in word[end - 1].encode()])))
            best.append(max(ways))
        return best[-1][2]

    rows = rows_of(spark, small)
    want = spark.createDataFrame([(d, [i for w in own.words(t) for i in ids(w)], sha(t)) for d, t in rows], "doc_id long, ids array<int>, sha string")
    want = {r.doc_id: (r.n, r.h, r.sha) for r in want.select("doc_id", F.size("ids").alias("n"), F.xxhash64("ids").alias("h"), "sha").collect()}
    got = queries.op5_sentencepiece(spark, small).collect()
    assert {r.doc_id: (r.n_ids, r.ids_hash, r.decoded_sha256) for r in got} == want and all(r.round_trip for r in got)


def test_toxicity_on_the_held_out_fold(spark, small):
    folder = small.replace("sf0.001", "sf0.01")
    found = queries.op6_toxicity(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = found.join(labels, "doc_id").filter("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    scores, toxic = np.array([r.score for r in rows]), np.array([r.toxic for r in rows])
    auc = (scores[toxic == 1][:, None] > scores[toxic == 0]).mean()
    assert auc > 0.9 and ((scores >= 0.5) == toxic).mean() > 0.9


def test_toxicity_scores_are_those_of_the_weights(spark, model, docs):
    """A plain recomputation: the distinct words and beginnings of a text, their weights summed."""
    found = {(r.doc_id, r.text): r.score for r in toxicity.score(docs, model).collect()}
    for d, t, *_ in odd_texts():
        features = np.unique(toxicity.feature_ids(pa.array([t or ""]))[1])
        z = model.weights[features].sum() + model.intercept
        assert found[d, t] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_toxicity_learns_identity_terms_from_the_tables(spark, small):
    folder = small.replace("sf0.001", "sf0.01")
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    fair, plain = (toxicity.train(read("documents"), read("labels"), fairness=f, rounds=40) for f in (1.0, 0.0))
    assert len(fair.groups) > len(toxicity.IDENTITY_GROUPS) and fair.pairs > 50
    assert fair.change < 0.7 * plain.change


def test_interchangeable_words_are_those_of_like_contexts(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        who, what = rng.choice(["reds", "blues", "we all", "some men", "you two"]), "idiot" if i % 3 == 0 else "friend"
        rows.append((int(i % 3 == 0), " ".join(rng.choices("ka lo mi".split(), k=4)) + f" the {who} were a {what} then " + " ".join(rng.choices("su ta".split(), k=3))))
    groups = toxicity.interchangeable(spark.createDataFrame(rows, "toxic int, text string"))
    assert ("blues", "reds") in groups and not any("idiot" in g for g in groups)


def test_substring_equals_brute_force(spark, small, docs):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op7_substring_dedup(spark, small).collect()}
    assert got == substring.brute_force(rows_of(spark, small))
    odd = {r.doc_id: (r.n_words, r.n_removed, sha(r.kept)) for r in substring.deduplicate(docs).collect()}
    assert odd == substring.brute_force([(d, t) for d, t, *_ in odd_texts()])


def test_factors_are_copies_from_earlier(spark, small):
    """Every factor's words are those at its source, which lies earlier, and no factor can be extended at its source's block."""
    words = {d: WORD.findall(t) for d, t in rows_of(spark, small)}
    found = substring.parse(spark.read.parquet(f"{small}/documents.parquet")).collect()
    assert len(found) > 20 and max(f.length for f in found) > 60
    for f in found:
        assert f.length >= substring.WINDOW and (f.source, f.source_start) < (f.doc_id, f.start)
        assert words[f.doc_id][f.start : f.start + f.length] == words[f.source][f.source_start : f.source_start + f.length]


def test_substring_with_unlike_texts_of_one_id(spark):
    prose = lambda seed, n: " ".join(f"w{x}" for x in random.Random(seed).choices(range(10**6), k=n))
    shared = prose(1, 40)
    rows = [(1, shared + " " + prose(2, 30)), (1, prose(3, 500)), (2, prose(4, 10) + " " + shared), (None, prose(5, 30)), (None, prose(6, 30) + " " + prose(5, 30))]
    got = substring.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 5 and {(r.doc_id, r.n_words, r.n_removed) for r in got if r.doc_id} == {(1, 70, 0), (1, 500, 0), (2, 50, 40)}
    assert sum(r.n_removed for r in got if r.doc_id is None) == 30


def test_a_hot_passage_is_settled_in_its_chunk(spark):
    rng = random.Random(4)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(60))
    rows = [(i, f"{' '.join(f'w{rng.randrange(10**6)}' for _ in range(25))} {passage} {' '.join(f'w{rng.randrange(10**6)}' for _ in range(25))}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    found = substring.blocks(docs.withColumn("sub", F.lit(0).cast("long")).select("doc_id", "sub", "text"), 20, 8)
    inside = found.groupBy("anchor", "block").agg(F.count("*").alias("n"), F.count_if(~F.col("settled")).alias("open")).filter("n > 100")
    assert inside.count() > 0 and inside.agg(F.max("open")).first()[0] <= 4
    got = {r.doc_id: (r.n_words, r.n_removed, sha(r.kept)) for r in substring.deduplicate(docs).collect()}
    assert got == substring.brute_force(rows)


def test_html_extraction_of_articles(spark, small):
    """Every page of the table against the library's own tree of tags."""
    from test_numpy_parts import plain_article

    rows = {r.page_id: r for r in queries.op8_html_consensus(spark, small).collect()}
    pages = spark.read.parquet(f"{small}/pages.parquet").collect()
    assert len(rows) == len(pages) and all(r.n_chars == len(r.text) for r in rows.values())
    assert all(rows[p.page_id].text == plain_article(p.html) for p in pages)
    page = "<html><body><nav>menu</nav><div class='post-1'><p>First &amp; long   text, with words.</p><p>Second text.</p></div><div class='comments'>no</div><footer>end</footer></body></html>"
    one = html_consensus.extract(spark.createDataFrame([(1, "http://a.example/x", page), (2, None, None)], "page_id long, url string, html string"))
    assert {r.page_id: r.text for r in one.collect()} == {1: "First & long text, with words.\nSecond text.", 2: ""}


def check_packing(pieces, texts: dict) -> None:
    by_doc, by_bin, exact = defaultdict(list), defaultdict(list), packing.tokenizer("byte_bpe_50k.json")
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_bin[p.sequence_id].append(p)
    for d, text in texts.items():
        ids = np.append(exact.encode(text, add_special_tokens=False).ids, 0).astype("<u4")
        own = sorted(by_doc[d], key=lambda p: p.piece)
        assert [p.start for p in own] == [0, *np.cumsum([p.length for p in own])[:-1].tolist()] and sum(p.length for p in own) == len(ids)
        assert all(zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in own)
        assert len(own) == -(-len(ids) // packing.CAPACITY)
    for own in by_bin.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [0, *np.cumsum([p.length for p in own])[:-1].tolist()] and sum(p.length for p in own) <= packing.CAPACITY


def test_packing(spark, small):
    pieces = queries.op9_best_fit_packing(spark, small).collect()
    check_packing(pieces, dict(rows_of(spark, small)))
    bound = packing.lower_bound(np.array([p.length for p in pieces]))
    assert bound <= len({p.sequence_id for p in pieces}) <= bound * 1.01 + 1
    assert all(p.bound <= p.bins for p in pieces)


def test_the_faster_encoder_is_the_tokenizer(spark, small):
    exact = packing.tokenizer("byte_bpe_50k.json")
    texts = [t for _, t in rows_of(spark, small.replace("sf0.001", "sf0.01"))]
    assert len(texts) == 1000
    for text, want in zip(texts, exact.encode_batch(texts, add_special_tokens=False)):
        assert packing.token_ids(text).tolist() == want.ids


def test_packing_exchanges_between_partitions(spark):
    rng = np.random.default_rng(3)
    rows = [(i, 0, 0, int(n), 0) for i, n in enumerate(rng.integers(300, 900, 900))]
    items = spark.createDataFrame(rows, packing.PIECES)
    count = lambda rounds: packing.pack(items, items_a_partition=60, rounds=rounds).select("sequence_id").distinct().count()
    assert count(None) <= count(3) < count(1)


EMAIL, IP = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD, PHONE = r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"


def contract_spans(text: str) -> list[tuple]:
    """The base spans by their definition."""

    def luhn(digits):
        doubled = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(digits))]
        return sum(x // 10 + x % 10 for x in doubled) % 10 == 0

    found = [("email", *m.span()) for m in re.finditer(EMAIL, text)]
    found += [("ip", *m.span()) for m in re.finditer(IP, text) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found += [("card", *m.span()) for m in re.finditer(CARD, text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found += [("phone", *m.span()) for m in re.finditer(PHONE, text) if 9 <= len(digits(m)) <= 15]
    return sorted(found, key=lambda s: (s[1], ("email", "ip", "card", "phone").index(s[0])))


def test_pii(spark, small):
    folder = small.replace("sf0.001", "sf0.01")
    texts = dict(rows_of(spark, folder))
    rows = {r.doc_id: r for r in queries.op10_pii(spark, folder).collect()}
    assert set(rows) == set(texts)
    secrets = added = 0
    for d, text in texts.items():
        base = contract_spans(text)
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        counts = [sum(k == kind for k, _, _ in base) for kind in ("email", "ip", "card", "phone")]
        assert [rows[d].n_email, rows[d].n_ip, rows[d].n_card, rows[d].n_phone] == counts and rows[d].base_sha256 == sha(listed)
        found = [x for x in rows[d].spans.split(",") if x]
        assert set(listed.split(",")) - {""} <= set(found)
        planted = {f"secret:{m.start(1)}:{m.end(1)}" for m in re.finditer(r'token = "([0-9a-f]{40})"', text, re.I)}
        assert planted <= set(found)  # the random field finds every one
        secrets, added = secrets + len(planted), added + len(found) - len(base)
    assert secrets > 5 and added <= secrets + 5  # and next to nothing else


def test_masking_leaves_no_base_span(spark, docs):
    masked = pii.mask(docs).filter("text like '%mail me%'").first().text
    assert pii.base_spans(masked) == [] and "[EMAIL]" in masked and "[CARD]" in masked


def test_pipeline_equals_its_stages_by_hand(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = [(r.doc_id, r.text) for r in quality.judge(docs).filter("kept").collect()]
    components = linked(kept)
    kept = [(d, t) for d, t in kept if components[d][1] == d]
    cut, left = substring.brute_force(kept), {}
    for r in substring.deduplicate(spark.createDataFrame(kept, "doc_id long, text string")).collect():
        assert cut[r.doc_id] == (r.n_words, r.n_removed, sha(r.kept))
        left[r.doc_id] = r.kept if r.n_removed else r.text
    masked = pii.mask(spark.createDataFrame(list(left.items()), "doc_id long, text string"))
    check_packing(corpus_pipeline.run(spark, small).collect(), {r.doc_id: r.text for r in masked.collect()})


OPERATORS = {
    "matroska": lambda df, m: matroska.features(matroska.store_texts(df)),
    "jaccard": lambda df, m: jaccard.near_duplicates(df),
    "jaccard_first": lambda df, m: jaccard.keep_first(df),
    "quality": lambda df, m: quality.judge(df),
    "quality_good": lambda df, m: quality.keep_good(df),
    "sentencepiece": lambda df, m: sentencepiece_trie.decode(sentencepiece_trie.encode(df)),
    "toxicity": lambda df, m: toxicity.score(df, m),
    "substring": lambda df, m: substring.deduplicate(df),
    "html": lambda df, m: html_consensus.extract(df.withColumn("url", F.lit("http://h.example/")), html="text", name="main"),
    "packing": lambda df, m: packing.pack(packing.pieces(df)),
    "pii": lambda df, m: pii.find(df),
    "pii_mask": lambda df, m: pii.mask(df),
}
STAGES = {f"stage_{n}": (lambda df, m, f=f: f(df.sparkSession, df, "")) for n, f in corpus_pipeline.STAGES}


@pytest.mark.parametrize("name", [*OPERATORS, *STAGES])
def test_odd_inputs(spark, docs, model, name, tmp_path):
    run = (OPERATORS | STAGES)[name]
    empty = run(docs.limit(0), model)
    assert empty.count() == 0
    clashing = docs.select("*", *[F.lit("own").alias(c) for c in CLASHES])
    found = run(clashing, model)
    found.write.parquet(str(tmp_path / "out"))  # names of columns are unique
    nulls = docs.limit(3).select(*[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes])
    run(nulls, model).collect()
    whole = name not in ("packing", "stage_best-fit packing", "jaccard_first", "quality_good", "stage_quality rules", "stage_n-gram Jaccard join")
    assert not whole or found.count() == docs.count()


def test_chat_odd_inputs(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert chat.digests(chat.format_conversations(spark.createDataFrame([], schema))).count() == 0
    rows = [(1, 0, None, None), (None, None, None, None), (2, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "assistant", "z" * 300_000)]
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(spark.createDataFrame(rows, schema).withColumn("piece", F.lit(1)))).collect()}
    assert got[2].n_turns == 3 and got[2].loss_chars == 300_000 and set(got) == {None, 1, 2}


def test_all_ten_are_registered():
    names = __spark_entry__.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names
