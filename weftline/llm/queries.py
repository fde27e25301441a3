"""The registered queries of this subpackage and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import chat, collocations, html_consensus, jaccard, lexical_search, matroska, packing, pii, prefix_free, quality, sentencepiece_trie, substring, toxicity
from weftline.session import table

TRICKY = "\\### Assistant: </turn> ok"


def op1_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = matroska.store_texts(table(spark, sf_dir, "documents"))
    return matroska.features(files)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_conversations(turns.unionByName(extra)))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = sentencepiece_trie.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = sentencepiece_trie.decode(encoded)
    same = F.col("decoded").eqNullSafe(F.translate("text", sentencepiece_trie.MARK, " "))
    return back.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), F.sha2("decoded", 256).alias("decoded_sha256"), same.alias("round_trip"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_html_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_consensus.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents")))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    listed = lambda name: F.array_join(F.transform(name, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counted = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [counted(kind) for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def op12_prefix_free_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = prefix_free.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical_search.ranked(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", "doc_id", "score")


QUALITY_CTE = r"""
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, unnest(generate_series(1, len(words) - 2)) AS i, words FROM w WHERE len(words) >= 3),
g3 AS (SELECT doc_id, i, (words[i], words[i + 1], words[i + 2]) AS win FROM g),
dup AS (SELECT doc_id, i FROM g3 QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM dup, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
m AS (SELECT w.doc_id, text, len(words)::BIGINT AS n_words,
             coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             len(lines)::BIGINT AS n_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
             len(list_distinct(words))::BIGINT AS n_distinct,
             len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\t]*[-*\x{2022}\x{00b7}]')))::BIGINT AS n_bullet_lines,
             len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|\x{2026})[\x20\t\r]*$')))::BIGINT AS n_open_lines
      FROM w LEFT JOIN rep ON w.doc_id IS NOT DISTINCT FROM rep.doc_id),
q AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
"""
QUALITY_KEPT = "NOT base_failed AND NOT 100 * n_symbols > 10 * n_words AND NOT 100 * n_dup_lines > 60 * n_lines AND NOT word_chars < 2 * n_words AND NOT word_chars > 15 * n_words AND NOT 100 * n_distinct < 5 * n_words AND NOT 100 * n_bullet_lines > 90 * n_lines AND NOT 100 * n_open_lines > 50 * n_lines"

COLLOCATIONS_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
i AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM w),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM i, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(w)),
c AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM c WHERE k = 1 GROUP BY lang),
f AS (SELECT * FROM c WHERE f >= 30),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
cut AS (SELECT cand.*, unnest(generate_series(1, k - 1)) AS c FROM cand),
part AS (SELECT lang, k, phrase, a, c, array_to_string(w[1:c], ' ') AS head, array_to_string(w[c + 1:k], ' ') AS tail FROM cut),
s AS (SELECT part.lang, part.k, part.phrase, a, c, h.f AS l, t.f AS r, ((2000000 * a::HUGEINT) // (h.f + t.f))::BIGINT AS score
      FROM part JOIN f h ON h.lang = part.lang AND h.phrase = head JOIN f t ON t.lang = part.lang AND t.phrase = tail),
weak AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
sub AS (SELECT DISTINCT lang, array_to_string(w[b:b + m - 1], ' ') AS phrase, a AS whole
        FROM (SELECT *, unnest(generate_series(1, k - m + 1)) AS b FROM (SELECT *, unnest(generate_series(2, k - 1)) AS m FROM cand WHERE k >= 3))),
gone AS (SELECT DISTINCT lang, phrase FROM sub JOIN cand USING (lang, phrase) WHERE 100 * whole::HUGEINT >= 80 * cand.a::HUGEINT)
SELECT lang, (row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase))::BIGINT AS rank, phrase, a, l, r, n, score
FROM weak JOIN n USING (lang) WHERE (lang, phrase) NOT IN (SELECT (lang, phrase) FROM gone) QUALIFY rank <= 2000
"""
SEARCH_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
s AS (SELECT count(*) AS n, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0),
p AS (SELECT doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY doc_id, term),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * s.n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM f, s),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS times FROM i GROUP BY ALL),
r AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * p.n * s.n) // s.l))))::BIGINT AS score FROM q JOIN w USING (term) JOIN p USING (term), s GROUP BY item_id, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= 10
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_matroska": op1_matroska,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_quality_rules": op4_quality_rules,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_toxicity": op6_toxicity,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_html_consensus": op8_html_consensus,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_pii": op10_pii,
    "op11_collocations": op11_collocations,
    "op12_prefix_free_dedup": op12_prefix_free_dedup,
    "op13_lexical_search": op13_lexical_search,
}

ORACLES: dict[str, str] = {
    "op4_quality_rules": f"WITH {QUALITY_CTE} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, {QUALITY_KEPT} AS kept FROM q",
    "op11_collocations": COLLOCATIONS_SQL,
    "op13_lexical_search": SEARCH_SQL,
}
