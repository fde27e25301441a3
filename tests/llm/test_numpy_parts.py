"""Parts that need no Spark: formats, hashes, models and packing against plain versions."""

import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from weftline.llm import chat, html_consensus, jaccard, matroska, packing, pii, sentencepiece_trie, substring, textops, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = ["", None, "a", "  A b\tc\nd e f ", "é à 한 글 " * 9, "x " * 300, "same words here and now " * 20, "same words here and now " * 20, "\n\n", "one two three four"]


def test_words_as_by_regex():
    w = textops.Words(*textops.text_buffers(pa.array(TEXTS, pa.string())))
    raw = w.data.tobytes()
    found = [[raw[a:b].decode() for a, b in zip(w.start[x:y], w.end[x:y])] for x, y in zip(w.first, w.first[1:])]
    assert found == [WORD.findall(t or "") for t in TEXTS]


def test_window_hashes_depend_on_words_only():
    a = textops.Words(*textops.text_buffers(pa.array(["x y z p q r", "p q  r"]))).hashes()
    h = textops.window_hashes(a, 3)
    assert h[3] == h[6] and len(set(h.tolist())) == 6
    assert textops.range_hash(a, np.array([3, 6]), np.array([6, 9])).tolist()[0] == textops.range_hash(a, np.array([6]), np.array([9]))[0]


def test_sliding_minimum():
    x = np.array(random.Random(2).choices(range(50), k=60))
    for k in (1, 2, 3, 13, 16):
        assert substring.sliding(np.minimum, x, k).tolist() == [x[i : i + k].min() for i in range(len(x) - k + 1)]


@pytest.mark.parametrize("n", [64, 128, 1024, 1088, 64 * 129, 64 * 9001])
def test_matroska_round_trip(n):
    payload = os.urandom(n)
    data = matroska.write(payload)
    packets, cues, codecs, scale = matroska.parse(data)
    assert b"".join(data[p.offset : p.offset + p.size] for p in packets) == payload
    assert scale == 1_000_000 and set(codecs.values()) == {"A_PCM/INT/LIT"}
    assert all(data[at : at + 4] == matroska.CLUSTER.to_bytes(4, "big") for _, at in cues)
    assert [p.timestamp for p in packets] == sorted(p.timestamp for p in packets)


def test_matroska_lacings_and_unknown_sizes():
    frames = [b"a" * 300, b"b" * 5, b"c" * 700]
    head = matroska.vint(1) + b"\x00\x07"
    xiph = head + b"\x82" + bytes([2, 255, 45, 5]) + b"".join(frames)
    flags, body = matroska.lace(frames)
    ebml = head + bytes([0x80 | flags]) + body
    group = matroska.element(matroska.BLOCK_GROUP, matroska.element(matroska.BLOCK, xiph) + matroska.number(matroska.REFERENCE_BLOCK, 1))
    cluster = matroska.number(matroska.TIMESTAMP, 100) + matroska.element(matroska.SIMPLE_BLOCK, ebml) + group
    unknown = matroska.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + cluster
    data = matroska.element(matroska.EBML, b"") + matroska.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + unknown
    packets = matroska.parse(data)[0]
    assert [data[p.offset : p.offset + p.size] for p in packets] == frames * 2
    assert {p.timestamp for p in packets} == {107} and [p.keyframe for p in packets] == [True] * 3 + [False] * 3
    with pytest.raises((ValueError, IndexError)):
        matroska.parse(data[:-400])


def test_chat_escapes_are_reversible():
    rng = random.Random(5)
    parts = ["\\", "###", "</turn>", "#", "<", "\n", "a", ": ", "### Assistant: "]
    for _ in range(500):
        role, text = ("".join(rng.choices(parts, k=rng.randrange(8))) for _ in range(2))
        assert chat.read_piece(chat.turn_template([(role, text)])) == (role, text)


def test_chat_spans_of_long_conversations_are_those_of_whole_renderings():
    turns = [("user" if i % 2 else "assistant", f"text {i} ### </turn>") for i in range(300)]
    found = list(chat.locate(turns, block=16))
    whole = chat.turn_template(turns)
    assert "".join(f[0] for f in found) == whole and found[-1][2] == len(whole)
    for (role, text), (_, _, _, lo, hi, rewrites) in zip(turns, found):
        assert not rewrites and (lo is None) == (role == "user")
        if lo is not None:
            assert chat.unescape(whole[lo:hi]) == text


def test_chat_detects_rewritten_history():
    def last_only(turns):
        return "".join(f"<{r}>{t if i == len(turns) - 1 else '...'}" for i, (r, t) in enumerate(turns))

    assert [x[-1] for x in chat.locate([("user", "abc"), ("assistant", "def"), ("user", "g")], last_only)] == [False, True, True]


def test_chat_detects_rewriting_beyond_a_block():
    def numbered(turns):
        last = max((i for i, (role, _) in enumerate(turns) if role == "user"), default=-1)
        return "".join(f"{i}:{text}{'?' if i < last and role == 'assistant' else '!'}\n" for i, (role, text) in enumerate(turns))

    turns = [(("user", "assistant")[i % 2], f"t{i}") for i in range(2 * chat.BLOCK + 9)]
    whole = ""
    for i, (piece, start, end, lo, hi, rewrites) in enumerate(chat.locate(turns, numbered)):
        before, whole = whole, numbered(turns[: i + 1])
        assert rewrites == (not whole.startswith(before)) == (i > 0 and i % 2 == 0)
        assert whole[start:end] == piece and end == len(whole)
        assert lo is None or whole[lo:hi] == turns[i][1]


def test_chat_loss_is_null_without_the_role():
    assert [x[3] for x in chat.locate([("user", "a"), ("system", "b")])] == [None, None]


def plain_sets(texts):
    out = []
    for t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def test_shingle_sets():
    texts = [*TEXTS, "B c", "b C", "one two three four five"]
    tokens, counts = jaccard.shingle_sets(pa.array(texts, pa.string()))
    want = plain_sets(texts)
    assert counts.tolist() == [len(s) for s in want]
    sets = np.split(tokens, np.cumsum(counts)[:-1])
    for i, a in enumerate(want):
        for j, b in enumerate(want):
            assert len(np.intersect1d(sets[i], sets[j])) == len(a & b)


def test_prefixes_put_frequent_shingles_last():
    tokens = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 20], np.uint64)
    prefix, sizes = jaccard.prefixes(tokens, np.array([8, 0, 2]), np.array([1, 2, 10], np.uint64), 75)
    assert sizes.tolist() == [3, 0, 1] and prefix.tolist() == [3, 4, 5, 20]


def test_longest_factors():
    places = np.array([(0, 5, 1, 0, 10), (5, 3, 1, 0, 15), (8, 2, 1, 0, 30), (12, 1, 1, 0, 34), (13, 2, 2, 0, 35)])
    assert substring.longest(places).tolist() == [[0, 8, 1, 0, 10], [8, 2, 1, 0, 30], [12, 1, 1, 0, 34], [13, 2, 2, 0, 35]]
    assert len(substring.longest(places[:0])) == 0


def test_earliest_rows_of_a_key():
    key, doc = np.array([7, 9, 7, 7], np.uint64), np.array([3, 1, 2, 2])
    assert substring.earliest(key, doc, np.zeros(4, np.int64), np.array([0, 0, 5, 4])).tolist() == [3, 1, 3, 3]


def test_substring_parse_marks_repeats_within_a_document():
    text = " ".join(f"w{i}" for i in range(25))
    p = substring.Parsed(pa.array([text + " z " + text]), 20, 8)
    assert p.later.sum() == 6


def test_patterns_find_the_same_by_steps():
    rng = random.Random(3)
    for _ in range(2000):
        s = "".join(rng.choices("ab1.@-+ %é", k=30))
        assert list(pii.emails(s)) == [m.span() for m in pii.EMAIL.finditer(s)]


def test_base_spans():
    text = "x@y.com 1.2.3.4 1.2.3.256 4111 1111 1111 1111 4111111111111112 +1 (555) 123-4567 +1-2"
    found = [(k, text[a:b]) for k, a, b in pii.base_spans(text)]
    assert found == [("email", "x@y.com"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (555) 123-4567")] or ("email", "x@y.com") in found
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


@pytest.fixture(scope="module")
def model():
    return pii.train(pii.labelled_examples())


def words_of(texts):
    return textops.Words(*textops.text_buffers(pa.array(texts, pa.string())))


def test_crf_pruned_decoding_equals_viterbi_over_all(model):
    w = words_of([t for t, _ in pii.labelled_examples(200, 5)] + ["", "1 2 3 4 5 6 7 8 9", "(555) 123-4567"])
    scores = model.scores(w)
    full = [x for a, b in zip(w.first, w.first[1:]) if b > a for x in pii.viterbi(scores[None, a:b], model.step)[0].tolist()]
    assert pii.decode(model, w).tolist() == full


def test_crf_on_held_out_sentences(model):
    hit, miss, wrong = Counter(), Counter(), Counter()
    for text, spans in pii.labelled_examples(600, 77):
        found = set(next(pii.spans_of(pa.array([text]), model))[2])
        for s in spans:
            (hit if s in found else miss)[s[0]] += 1
        for s in found - set(spans):
            wrong[s[0]] += 1
    # Random cards fail their checksum and are rightly not found.
    share = lambda kind: hit[kind] / (hit[kind] + miss[kind])
    assert min(share(k) for k in ("secret", "id", "ip", "email")) > 0.9 and share("phone") > 0.75 and share("address") > 0.6 and share("name") > 0.4
    assert all(wrong[k] <= 0.1 * (hit[k] + miss[k]) for k in ("secret", "id", "email", "address", "name"))


def test_crf_finds_secrets_in_any_coat(model):
    value = "3fdf5a35c7b8d733c0b5c7d364eda8ac88d929d1"
    for text in (f'la que token = "{value}" de', f'TOKEN = "{value.upper()}"!! OF!!', f'the&&& token = "{value}"### el%%%', f"é ü api_key: {value} and"):
        own, base, every = next(pii.spans_of(pa.array([text]), model))
        assert base == [] and [(k, own[a:b].lower()) for k, a, b in every] == [("secret", value)]
    clean = "The token was read. A password is a word. Version 2.0 of RFC-2119, in 2024; see (page 12). En la casa. De la."
    assert next(pii.spans_of(pa.array([clean]), model))[2] == []


def plain_viterbi_score(model, word):
    scores = model.scores
    best = [0.0] + [None] * len(word)
    for end in range(1, len(word) + 1):
        best[end] = max(best[s] + (scores.get(word[s:end], model.unknown_score if end - s == 1 else None)) for s in range(end) if scores.get(word[s:end]) is not None or end - s == 1)
    return best[-1]


def short_texts(n=500):
    rng = random.Random(4)
    return ["", " ", "   a  b", "Hello  world\nfoo\t\n", *["".join(rng.choices("aeiothnsrl  ▁.1é한\n\t🙂ABC", k=rng.randrange(60))) for _ in range(n)]]


def library(kind):
    """The library with the model as published, or with our scores and Viterbi."""
    import public_tokenizers
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(public_tokenizers.path(sentencepiece_trie.MODEL), "rb") as f:
        proto.ParseFromString(f.read())
    own = sentencepiece_trie.pieces(sentencepiece_trie.MODEL, kind)
    if kind == sentencepiece_trie.UNIGRAM:
        proto.trainer_spec.model_type = kind
        for p in proto.pieces:
            if p.piece in own.scores and p.type in (sentencepiece_trie.NORMAL, sentencepiece_trie.USER):
                p.score = own.scores[p.piece] / sentencepiece_trie.RANK_UNITS
    return own, sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())


@pytest.mark.parametrize("kind", [sentencepiece_trie.UNIGRAM, None])
def test_sentencepiece_equals_the_library(kind):
    own, lib = library(kind)
    for t in short_texts():
        table = own.encode_words(set(own.words(t)))
        got = np.frombuffer(b"".join(table[w] for w in own.words(t)), np.int32).tolist()
        assert got == lib.encode(t), t
        assert own.decode(got) == lib.decode(got) == t.replace("▁", " ")


def test_sentencepiece_shares_the_scores_of_common_prefixes():
    """The sorted traversal computes each distinct prefix once, and gives what every word gives alone."""
    own = sentencepiece_trie.pieces(sentencepiece_trie.MODEL, sentencepiece_trie.UNIGRAM)
    words = {"▁" + "".join(random.Random(i).choices("therain", k=i % 12 + 1)) for i in range(300)}
    together = own.encode_words(words)
    assert all(own.encode_words([w])[w] == ids for w, ids in together.items())
    made = 0

    class Counted(sentencepiece_trie.Pieces):
        def _unigram_states(self, word, scores, sizes, ids):
            nonlocal made
            before = len(scores)
            super()._unigram_states(word, scores, sizes, ids)
            made += len(scores) - before

    counted = Counted(**{k: getattr(own, k) for k in own.__dataclass_fields__})
    assert counted.encode_words(words) == together
    assert made == len({w[:k] for w in words for k in range(1, len(w) + 1)})


def test_sentencepiece_unigram_finds_the_best_sum():
    own = sentencepiece_trie.pieces(sentencepiece_trie.MODEL, sentencepiece_trie.UNIGRAM)
    rng = random.Random(6)
    words = {"▁" + "".join(rng.choices("therainsomé", k=rng.randrange(1, 12))) for _ in range(60)}
    names = {i: p for p, i in own.ids.items()}
    for word, packed in own.encode_words(words).items():
        ids = np.frombuffer(packed, np.int32).tolist()
        if all(i in names for i in ids):
            assert "".join(names[i] for i in ids) == word
            assert sum(own.scores.get(names[i], own.unknown_score) for i in ids) == plain_viterbi_score(own, word)


def test_toxicity_swaps_identity_terms():
    out = toxicity.swapped("the Muslim man", (("muslim", "sikh"), ("man", "woman")))
    assert out == "the sikh woman" == toxicity.swapped("the Muslim man", (("muslim", "sikh"), ("man", "woman")))
    assert toxicity.swapped("no term") is None


def test_counterfactuals_cut_false_positives():
    rng = random.Random(8)
    plain = "the a of day work tree song river paper".split()
    rows = []
    for i in range(400):
        words = rng.choices(plain, k=8)
        toxic = i % 2
        if toxic:
            words[0] = rng.choice(["idiot", "scum"])
        # In the training rows one group is mentioned mostly by toxic texts.
        if rng.random() < (0.9 if toxic else 0.05):
            words[1] = "muslim"
        elif rng.random() < 0.3:
            words[1] = "christian"
        rows.append((" ".join(words), toxic))

    def learn(fairness):
        sets = lambda t: np.unique(toxicity.feature_ids(pa.array([t]))[1])
        made = []
        for t, y in rows:
            other = toxicity.swapped(t)
            a, b = sets(t), sets(other or t)
            made.append((a, y, np.setdiff1d(a, b), np.setdiff1d(b, a)))
        return toxicity.fit(toxicity.Examples.of(made), fairness=fairness, l2=1e-4)

    neutral = pa.array([f"the {' '.join(rng.choices(plain, k=6))} muslim" for _ in range(100)])
    bare = pa.array([t.as_py().replace("muslim", "christian") for t in neutral])
    gap = lambda m: np.abs(m.scores(neutral) - m.scores(bare)).mean()
    fair, unfair = learn(5.0), learn(0.0)
    assert gap(fair) < 0.3 * gap(unfair)
    assert (fair.scores(neutral) >= 0.5).mean() <= (unfair.scores(neutral) >= 0.5).mean()
    assert fair.scores(pa.array(["the idiot tree", "scum of the day", ""]))[:2].min() > 0.5


def test_toxicity_without_labels_scores_nothing():
    none = toxicity.fit(toxicity.Examples(np.zeros(0), *[(np.zeros(0, np.int32), np.zeros(0, np.int64))] * 3))
    assert none.scores(pa.array(["a b", ""])).tolist() == pytest.approx([0.0, 0.0])


def test_best_fit_decreasing_and_its_bound():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 500):
        sizes = rng.integers(1, 2049, n)
        bins, offsets, fills = packing.best_fit_decreasing(sizes)
        assert packing.lower_bound(sizes) <= len(fills) <= n
        for b in range(len(fills)):
            own = np.flatnonzero(bins == b)
            order = own[np.argsort(offsets[own])]
            assert offsets[order].tolist() == np.concatenate(([0], np.cumsum(sizes[order])[:-1])).tolist()
            assert sizes[order].sum() == fills[b] <= 2048


def test_lower_bounds_hold_against_exhaustive_packing():
    rng = np.random.default_rng(2)

    def fewest(sizes, cap):
        best = len(sizes)

        def put(i, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if i == len(sizes):
                best = len(bins)
                return
            for b in range(len(bins)):
                if bins[b] + sizes[i] <= cap:
                    put(i + 1, [*bins[:b], bins[b] + sizes[i], *bins[b + 1 :]])
            put(i + 1, [*bins, sizes[i]])

        put(0, [])
        return best

    for _ in range(60):
        sizes = rng.integers(1, 21, 8)
        assert packing.lower_bound(sizes, 20) <= fewest(sizes.tolist(), 20) <= len(packing.best_fit_decreasing(sizes, 20)[2])


def test_token_ids_as_by_the_tokenizer():
    exact = packing.tokenizer("byte_bpe_50k.json")
    for t in ["", "a<|endoftext|>b", "\x85\xa0　 x  \n\n y", "Éé 1²३ ßﬁ 👩‍👩‍👧 ​", "''ll 'S 's", "x" * 5000]:
        assert packing.token_ids(t).tolist() == exact.encode(t, add_special_tokens=False).ids


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "</p>";</script></head><body><!-- x <p> -->
<nav><a href=x>menu</a></nav><div class="cookie-notice">We use cookies</div><div id="c12" class="col story-7"><h1>Head &amp; line</h1><p>One <b>two
 three<br><p>four &lt;five&gt; <a href="y">six</a></p><div class="comments"><p>Nice post</p></div><form><p>mail</p></form></div>
<aside>side</aside><footer><p>&copy; all</p></footer></body></html>"""


def test_html_text_of_a_page():
    want = "Head & line\nOne two three\nfour <five> six"
    best = html_consensus.path_of("/html/body/div.c#.col.story-#")
    assert html_consensus.text_at(PAGE, None) == html_consensus.text_at(PAGE, best) == want
    votes = html_consensus.votes_of(PAGE)
    assert votes[0][0] == best and sum(x for _, x in votes) == pytest.approx(1.0)


@pytest.mark.parametrize(
    "html, want",
    [
        ("<p>plain paragraph</p>", "plain paragraph"),
        ("plain <b>text</b> without tags", "plain text without tags"),
        ("<body><article class=a><p>One two three.</p></article><article class=b><p>Four five six.</p></article></body>", "One two three.\nFour five six."),
        ("<body><div class='ad-free article'><p>The whole article.</p></div></body>", "The whole article."),
        ("<body><nav>menu</nav><div class=box><div class=box><p>a b c d</p></div></div><footer>end</footer></body>", "a b c d"),
        ("<p>one<p>two<br>lines &lt;x&gt;", "one\ntwo lines <x>"),
    ],
)
def test_html_loses_no_text(html, want):
    assert html_consensus.text_at(html, None) == want


def plain_article(html):
    """The text of a page by the library's own tree of tags: all blocks but those of menus, adverts and the like."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        out, skip, part = [], 0, ""
        outside = {"nav", "footer", "aside", "script", "style", "head", "form", "title"}

        def handle_starttag(self, tag, attrs):
            self.cut(tag)
            if self.skip or tag in self.outside or {"ad", "comments", "cookie", "sidebar", "related", "share", "newsletter"} & set((dict(attrs).get("class") or "").split()):
                self.skip += tag not in html_consensus.VOID

        def handle_endtag(self, tag):
            self.cut(tag)
            self.skip = max(0, self.skip - (tag not in html_consensus.VOID))

        def handle_data(self, data):
            self.part += "" if self.skip else data

        def cut(self, tag):
            if tag in html_consensus.BLOCKS:
                self.out.append(" ".join(self.part.split()))
                self.part = ""
            elif tag == "br":
                self.part += " "

    reader = Reader()
    reader.out = []
    reader.feed(html)
    reader.cut("p")
    return "\n".join(x for x in reader.out if x)


@pytest.mark.parametrize("unit", ["<a ", "<style ", "<div>x", '<a ">" ', "<p title='x>", "<b>", "<td>", "<", "</"])
def test_html_is_read_in_linear_time(unit):
    import time

    took = []
    for size in (100_000, 400_000):
        html = unit * (size // len(unit))
        began = time.process_time()
        html_consensus.text_at(html, None)
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.5


@pytest.mark.parametrize("names", [("single has-sidebar", "post"), ("no-sidebar", "category-social tag-search"), ("", "post related share")])
def test_html_layout_and_topic_names_are_no_asides(names):
    prose = "A sentence of the article, with words enough. " * 6
    page = f"<html><body class='{names[0]}'><div class='layout no-sidebar'><article class='{names[1]}'><p>{prose}</p><div class='share-bar'>Share it</div></article><div class='sidebar'>Side</div></div></body></html>"
    assert html_consensus.text_at(page, None) == prose.strip()
    assert html_consensus.text_at(page, html_consensus.votes_of(page)[0][0]) == prose.strip()


@pytest.mark.parametrize("html", ["", "plain & text", "<p>", "</div></div>x", "<div" * 50, "<p>" * 3000 + "deep", "<script>never closed"])
def test_html_odd_pages_do_not_fail(html):
    assert isinstance(html_consensus.text_at(html, "/html/body/article"), str)
