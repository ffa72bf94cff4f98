"""The methods against brute force on small inputs."""

import itertools
import math
import os
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from photonloom.llm import bpe, components, ctw, langid, lines, neardup, packing, quality, toxicity, winnow
from photonloom.llm.common import most_frequent

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def copies(spark):
    """Texts with exact and near copies, among them a large group around one text."""
    g = random.Random(4)
    word = lambda: "".join(g.choice("abcdefgh") for _ in range(4))
    texts = []
    for n in (0, 1, 3, 4, 5, 30, 200):
        texts += [" ".join(word() for _ in range(n)) for _ in range(3)]
    base = [word() for _ in range(120)]
    for k in range(160):
        t = list(base)
        for _ in range(k % 9):
            t[g.randrange(len(t))] = word()
        texts.append(" ".join(t))
    texts += texts[:40]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), texts


def test_near_duplicates_equal_brute_force(spark, copies):
    df, texts = copies
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.doc_id: r for r in neardup.near_duplicates(df, node_size=16, tile_side=24).collect()}
    assert [got[k].component_id for k in range(len(texts))] == [root(k) for k in range(len(texts))]
    assert all(got[k].n_shingles == len(s) and got[k].kept == (root(k) == k) for k, s in enumerate(sets))


def test_near_duplicates_among_common_passages(spark):
    """Texts put together from a few passages: nodes stay large though their members are little alike."""
    g = random.Random(11)
    word = lambda: "".join(g.choice("abcdefgh") for _ in range(5))
    passages = [[word() for _ in range(60)] for _ in range(32)]
    choices = []
    while len(choices) < 300:  # two texts share two passages of four at most
        c = set(g.sample(range(32), 4))
        if all(len(c & d) <= 2 for d in choices):
            choices.append(c)
    texts = [[w for p in c for w in passages[p]] for c in map(sorted, choices)]
    for k in range(30):
        t = list(texts[7 * k + 60])
        for i in range(5):
            t[20 + 40 * i] = word()
        texts.append(t)
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    pairs = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert pairs == [(7 * k + 60, 300 + k) for k in range(30)]
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df, node_size=2, max_depth=1, tile_side=16).collect()}
    assert got == {k: 7 * (k - 300) + 60 if k >= 300 else k for k in range(330)}


def test_nodes_branch_on_fresh_tokens(spark):
    """Classes that agree in the tokens of all first nodes and in no other part at once; only agreement in a node's own further tokens keeps them together."""
    n = 16 * 7
    for same in (16, n):
        classes = spark.createDataFrame([(r, [0 if i < same else 1 + r for i in range(n)]) for r in range(40)], "rep long, tokens array<int>")
        small, large = neardup.leaves(classes, 4, 3, 0.75)
        assert small.count() == 0 and (large.count() == 0) == (same == 16)
    tree0 = spark.createDataFrame([(r, [0 if i < 16 or i in (16, 17, 48, 49, 50, 51) else 1 + r for i in range(n)]) for r in range(40)], "rep long, tokens array<int>")
    nodes = neardup.leaves(tree0, 4, 3, 0.75)[1].select("node").distinct().count()
    assert 1 <= nodes <= 4  # of one tree
    words = " ".join(str(k) for k in range(300))
    tokens = neardup.sketches(spark.createDataFrame([(0, words)], "doc_id long, text string"), 5, 3, "doc_id", "text").first().tokens
    assert len(set(tokens)) == n


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(links).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}
    assert components.connected_components(links.limit(0)).count() == 0


def chosen(text, k, w):
    """Winnowing by its definition, over the bytes of a text: (position, hash), rightmost of ties."""
    data = text.encode()
    h = [xxhash.xxh64_intdigest(data[i : i + k], seed=42) >> 64 - winnow.HASH_BITS for i in range(max(len(data) - k + 1, 1))] if data else []
    out = set()
    for i in range(max(len(h) - w + 1, 1) if h else 0):
        least = min(h[i : i + w])
        out.add((max(j for j, x in enumerate(h[i : i + w], i) if x == least), least))
    return sorted(out)


@pytest.mark.parametrize(("k", "doublings"), [(24, 6), (5, 2), (3, 3)])
def test_winnowing_equals_brute_force(spark, k, doublings):
    """Texts, edited texts and the next one's, with ties (runs of one letter), multi-byte characters and texts shorter than a window."""
    g = random.Random(3)
    texts = ["", "a", "abc" * 3, "x" * 500] + ["".join(g.choice("abc \u00e9\u6f22") for _ in range(g.randrange(0, 700))) for _ in range(40)]
    got = {r.doc_id: r for r in winnow.fingerprint_with_edits(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), k, doublings).collect()}
    pairs = lambda v: [(x >> winnow.HASH_BITS, x & ((1 << winnow.HASH_BITS) - 1)) for x in v]
    for i, t in enumerate(texts):
        third = len(t) // 3
        edited = t[: len(t) - third] + texts[i - 1][:third]
        assert got[i].n_chars == len(t) and got[i].edited == edited
        assert pairs(got[i].prints) == chosen(t, k, 1 << doublings)
        assert pairs(got[i].edited_prints) == chosen(edited, k, 1 << doublings)
        assert pairs(got[i].next_prints) == chosen(texts[i - 1], k, 1 << doublings)


def test_winnowing_guarantee(spark):
    """A shared passage of w + k - 1 bytes gives a common choice wherever it begins, without any white space too."""
    g = random.Random(1)
    letters = lambda n, of="abcdef": "".join(g.choice(of) for _ in range(n))
    shared, cjk = letters(64 + 24 - 1), letters(29, "\u4e00\u4e8c\u4e09\u56db\u4e94\u516d\u4e03")
    texts = [letters(200) + shared + letters(100), letters(37) + shared + letters(333), "\u5b57" * 5 + cjk + "\u65e5" * 9, "\u5b57" * 2 + cjk + "\u672c" * 40, "", letters(3000)]
    texts.append("z" + texts[-1])
    p = {r.i: {v & ((1 << winnow.HASH_BITS) - 1) for v in r.p} for r in winnow.add_fingerprint(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "text", "p").collect()}
    assert p[0] & p[1] and p[2] & p[3] and not p[4]
    assert len(p[5] & p[6]) >= 0.95 * len(p[5])


def test_next_document_over_groups(spark):
    df = spark.createDataFrame([(k * 3, str(k)) for k in range(100)], "doc_id long, text string").repartition(7)
    got = {r.doc_id: r.next_text for r in winnow.with_next(df, ["text"], rows_per_group=9).collect()}
    assert got == {k * 3: str(k - 1) if k else "99" for k in range(100)}


def test_choices_of_pieces_are_those_of_the_whole(spark):
    """Texts around the length of a piece, and of many pieces, with runs of one letter that tie across the cuts."""
    g = random.Random(5)
    texts = ["ab" * 3, *("".join(g.choice("ab") for _ in range(n)) for n in (85, 86, 87, 100, 116, 117, 118, 150, 1000)), "y" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for k, doublings, span in ((24, 6, 32), (3, 2, 1), (5, 3, 7)):
        for r in df.select("i", winnow.choices(F.col("text").cast("binary"), k, doublings, span).alias("p")).collect():
            assert [(x >> winnow.HASH_BITS, x & ((1 << winnow.HASH_BITS) - 1)) for x in r.p] == chosen(texts[r.i], k, 1 << doublings)


def test_places_of_long_texts_are_whole_numbers(spark):
    """The greatest place that a text can have leaves the packed number positive and its place as it is."""
    last = (1 << 31) - 1
    assert (last << winnow.HASH_BITS | (1 << winnow.HASH_BITS) - 1) < 1 << 63
    got = spark.range(1).select(winnow.as_text(F.array(F.lit(last << winnow.HASH_BITS | 10))).alias("t")).first().t
    assert got == f"A@{last}"


@pytest.mark.parametrize("known", [0, 3])
def test_many_rows_without_an_id(spark, known):
    """They come last, over many groups, each once, in one circle with the others."""
    rows = [(None, f"n{k}") for k in range(300)] + [(k, f"t{k}") for k in range(known)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = winnow.with_next(df, ["text"], rows_per_group=16)
    follows = {r.text: r.next_text for r in got.collect()}
    assert len(follows) == len(rows) and sorted(follows.values()) == sorted(follows)
    circle, at = [], rows[-1][1]
    for _ in rows:
        circle.append(at)
        at = follows[at]
    assert len(set(circle)) == len(rows) and circle[:known] == [f"t{k}" for k in reversed(range(known))]
    order = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    nulls = [order[t] for t in circle[known:]]
    assert sum(x > y for x, y in zip(nulls, nulls[1:] + nulls[:1])) == 1


def test_suffix_automaton_and_phrases():
    text = "abracadabra"
    a = langid.suffix_automaton(text)

    def has(s):
        state = 0
        for c in s:
            if c not in a[state]:
                return False
            state = a[state][c]
        return True

    for s in map("".join, itertools.product("abcdr", repeat=3)):
        assert has(s) == (s in text)


def test_phrases_are_longest_matches():
    """Greedy parsing by its definition, across words, against two languages at once."""
    g = random.Random(9)
    texts = {"a": bytes(g.choice(b"abc ") for _ in range(300)), "b": b"ab ca "}
    model = langid.LanguageModel.of(texts)
    blocks = [bytes(g.choice(b"abcx ") for _ in range(g.randrange(1, 120))) for _ in range(40)]
    got = model.phrases(blocks)
    for k, lang in enumerate(model.languages):
        for j, block in enumerate(blocks):
            i = n = 0
            while i < len(block):
                end = i + 1
                while end <= len(block) and block[i:end] in texts[lang]:
                    end += 1
                i = max(end - 1, i + 1)
                n += 1
            assert got[k, j] == n


def test_phrases_run_on_across_blocks(monkeypatch):
    """A text's phrases are the same in blocks of any size, so its rate doesn't depend on its length."""
    g = random.Random(10)
    texts = {"a": bytes(g.choice(b"abc ") for _ in range(500)), "b": b"ab ca bb "}
    model = langid.LanguageModel.of(texts)
    mine = [bytes(g.choice(b"abcx ") for _ in range(n)) for n in (0, 1, 7, 8, 9, 300, 64, 65)] + [texts["a"] * 3, texts["b"] * 100, b""]
    want = model.phrases(mine)
    assert want[:, 0].tolist() == want[:, -1].tolist() == [0, 0]
    for size in (1, 3, 8, 64):
        monkeypatch.setattr(langid, "BLOCK", size)
        assert (model.phrases(mine) == want).all()


def test_the_winner_by_definition():
    """Language, confidence and bits a byte of whole texts from phrases counted one by one, long texts too."""
    g = random.Random(12)
    words = {"x": ["alpha", "beta", "gamma", "delta"], "y": ["eins", "zwei", "drei", "alpha"], "z": ["un", "deux", "trois", "beta"]}
    learned = {k: langid.normalised(" ".join(g.choice(v) for _ in range(200))) for k, v in words.items()}
    model = langid.LanguageModel.of(learned)
    texts = [" ".join(g.choice(words[k]) for _ in range(n)) for k in words for n in (1, 5, 40, 900)] + ["alpha beta eins un", None, "..."]
    for text, (lang, score, rate) in zip(texts, langid.Identifier(model, at_once=4)(texts)):
        d = langid.normalised(text)
        if not d:
            assert (lang, score, rate) == ("und", 0.0, [])
            continue
        want = []
        for k in sorted(learned):
            i = n = 0
            while i < len(d):
                end = i + 1
                while end <= len(d) and d[i:end] in learned[k]:
                    end += 1
                i, n = max(end - 1, i + 1), n + 1
            want.append(n * math.log2(len(learned[k]) + 1) / len(d))
        odds = [2.0 ** -min(8 * (r - min(want)), 1000) for r in want]
        assert rate == pytest.approx(want) and lang == sorted(learned)[want.index(min(want))] and score == pytest.approx(max(odds) / sum(odds))


def test_letterless_texts_have_no_language():
    model = langid.LanguageModel.of({"en": b" the cat sat ", "de": b" die katze "})
    identify = langid.Identifier(model, at_once=3)
    assert [x[0] for x in identify([None, "", "\u00b2 \u00bd \u2460 \u2167 42 _ \u0664", "The cat!", "the katze die katze"])] == ["und", "und", "und", "en", "de"]
    long = "the cat sat " * 3000
    assert identify([long, "the cat sat"])[0][0] == "en" and identify([])== []
    assert langid.Identifier(langid.LanguageModel.of({}))(["x"]) == [("und", 0.0, [])]


def test_every_language_is_learned(spark):
    g = random.Random(2)
    rows = [(k, f"l{k % 70}", "".join(g.choice("abcdefg ") for _ in range(50)) + f" w{chr(97 + k % 26)} end") for k in range(280)] + [(1000, "long", "y" * 50_000 + " end")]
    rows.append((1001, "late", " " + "1" * 60_000 + " z" * 30_000))  # letters far behind the beginning
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, lang string, text string"), lambda i: i >= 0)
    assert set(model.languages) >= {r[1] for r in rows} - {"late"}


def test_rows_of_any_length_teach(spark):
    """Rows are chosen by hash alone, and a passage of each comes from anywhere in it."""
    g = random.Random(3)
    short, long = ["ab"] * 40, ["qz"] * 40
    rows = [(k, "l", " ".join([w] * (400 if w == "qz" else 3)) + " " + "".join(g.choice("xy") for _ in range(8))) for k, w in enumerate(short + long)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = langid.fit(df, lambda i: i >= 0, docs_per_language=40, bytes_per_language=2000)
    rate = [r[2][0] for r in langid.Identifier(model)(["qz qz qz qz", "ab ab ab ab", "vv vv vv vv"])]
    assert max(rate[:2]) < rate[2] / 2


def test_maximal_segments_are_the_recursive_ones():
    g = random.Random(7)
    for _ in range(200):
        s = [g.choice([-1.0, -0.5, 0.7, 1.3]) for _ in range(12)]
        scored = [(i, v) for i, v in enumerate(s) if v != -0.5]

        def split(lo, hi):
            best = max(((sum(s[i:j]), -(j - i), i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=(0,))
            if best[0] <= 1e-9:
                return []
            return [*split(lo, best[2]), (best[2], best[3] - 1, round(best[0], 6)), *split(best[3], hi)]

        got = toxicity.maximal_segments(scored, -0.5)
        assert sum(x for *_, x in got) == pytest.approx(sum(x for *_, x in split(0, 12)))
        assert max((round(x, 6) for *_, x in got), default=0) == max((x for *_, x in split(0, 12)), default=0)


def test_toxic_texts_of_words_of_their_own(spark):
    """The easy case: no word is on both sides; and one wording pasted into many texts is learned."""
    g = random.Random(6)
    word = lambda of: "".join(g.choice(of) for _ in range(6))
    bad, good = [word("qxz") for _ in range(6)], [word("abcde") for _ in range(60)]
    rows = [(k, " ".join(g.sample(bad, 6) if k < 40 else [g.choice(good) for _ in range(30)])) for k in range(200)]
    rows += [(k, " ".join([*(g.choice(good) for _ in range(15)), "vile", "phrase", "here", *(g.choice(good) for _ in range(15))])) for k in range(200, 260)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 40 or k >= 200)) for k in range(260)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, lambda i: i >= 0)
    got = {r.doc_id: r.score for r in toxicity.score_documents(docs, model).collect()}
    assert {w for w in model.weights if model.weights[w] > 0} >= {"phrase", "here", "vile"}
    assert min(got[k] for k in got if k < 40 or k >= 200) > 0.5 > max(got[k] for k in got if 40 <= k < 200)


def test_context_tree_is_a_distribution():
    g = ctw.grams_of([b"abab", b"abba", b"ab"] * 20, 3)
    k, n = np.unique(g, return_counts=True)
    tree = ctw.ContextTree.of(k, n.astype(float), 3)
    for context in (0x616261, 0x0A0A0A, 0x7A7A7A):
        all_bytes = np.array([(context << 8) | b for b in range(256)], dtype=np.uint64)
        assert (10 ** tree.log10(all_bytes)).sum() == pytest.approx(1, abs=1e-6)
    assert tree.log10(np.array([(0x0A6162 << 8) | ord("a")], dtype=np.uint64))[0] > math.log10(0.3)
    t = ctw.GramTable(k, tree.log10(k).astype(np.float32))
    out, missing = t.look_up(np.append(k, np.uint64(5)))
    assert missing.tolist() == [len(k)] and np.allclose(out[:-1], tree.log10(k), atol=1e-5)
    x = np.array([0.5, 1.0, 7.25, 1000.0])
    assert np.allclose(ctw.log_gamma(x), [math.lgamma(v) for v in x])


def test_context_tree_equals_sequential_weighting():
    """One context of depth 0 and 1 over single decisions: the block probability by the recursion itself."""
    words = [b"ab", b"a", b"abb"]
    g = ctw.grams_of(words, 1)
    k, n = np.unique(g, return_counts=True)
    tree = ctw.ContextTree.of(k, n.astype(float), 1)
    data = b" ".join(words) + b"\n"
    pairs = list(zip(b"\n" + data[:-1], data))
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    bits = [[(c, b >> 7 & 1) for c, b in pairs]]
    zero, ones = sum(1 - b for _, b in bits[0]), sum(b for _, b in bits[0])
    own = kt(zero, ones)
    children = sum(kt(sum(1 - b for c2, b in bits[0] if c2 == c), sum(b for c2, b in bits[0] if c2 == c)) for c in {c for c, _ in bits[0]})
    assert tree.own[0][0][0] == pytest.approx(math.exp(own - np.logaddexp(own, children)), rel=1e-5)


@pytest.mark.parametrize("depth", [0, 1, 2, 5])
def test_scores_keep_their_depth_however_few_grams_are_held(spark, depth):
    g = random.Random(5)
    texts = [" ".join("".join(g.choice("abcd") for _ in range(g.randrange(1, 6))) for _ in range(25)) for _ in range(24)] + ["", "zebra ab"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    grams = [ctw.grams_of(ctw.words_of(t), depth) for t in texts]
    k, n = np.unique(np.concatenate(grams[:16]), return_counts=True)
    tree = ctw.ContextTree.of(k, n.astype(float), depth)
    for held in (3_000_000, 40):
        model, words = ctw.fit(df, F.col("doc_id") < 16, depth=depth, max_grams=held)
        assert len(model.grams) == len(k) if held > 40 else len(model.grams) <= 40
        got = {r.doc_id: r for r in ctw.score_documents(df, model, words).collect()}
        for i, x in enumerate(grams):
            want = tree.log10(x).sum()
            assert got[i].score == pytest.approx(want, rel=1e-5)
            assert got[i].bits_per_byte == pytest.approx(-want / math.log10(2) / len(x), rel=1e-5)
        unseen = df.select((100 + F.col("doc_id")).alias("doc_id"), F.concat("text", F.lit(" dcbad zq")).alias("text"))
        for r in ctw.score_documents(unseen, model, words).collect():
            assert r.score == pytest.approx(tree.log10(ctw.grams_of(ctw.words_of(texts[r.doc_id - 100] + " dcbad zq"), depth)).sum(), rel=1e-5)


def test_base_score(spark):
    texts = ["a b a", "c a", "zz b", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model, words = ctw.fit(df, F.col("doc_id") < 2, depth=2, frequent=2)
    n = {"a": 3, "b": 1, "c": 1, "\n": 2}
    total, distinct = 7, 4
    for r in ctw.score_documents(df, model, words).collect():
        tokens = [*texts[r.doc_id].split(), "\n"]
        assert r.base_score == pytest.approx(sum(math.log10((n.get(t, 0) + 0.5) / (total + 0.5 * (distinct + 1))) for t in tokens))
        assert r.n_known == sum(t in n for t in tokens)


def test_a_whole_text_by_its_definition():
    """Every byte's probability by the recursion over contexts, one after the other, for texts with known and new contexts."""
    g = random.Random(12)
    depth = 3
    texts = [[bytes(g.choice(b"abc") for _ in range(g.randrange(1, 5))) for _ in range(12)] for _ in range(8)]
    data = [ctw.END * depth + b" ".join(t) + ctw.END for t in texts]
    counts: dict = {}
    for x in data:
        for i in range(depth, len(x)):
            for bit in range(8):
                for d in range(depth + 1):
                    counts.setdefault((x[i - d : i], bit, x[i] >> (8 - bit)), [0, 0])[x[i] >> (7 - bit) & 1] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(c, bit, prefix):
        own = kt(*counts[c, bit, prefix])
        if len(c) == depth:
            return own, 1.0
        below = sum(weighted(bytes([b]) + c, bit, prefix)[0] for b in range(256) if (bytes([b]) + c, bit, prefix) in counts)
        both = np.logaddexp(own, below)
        return both - math.log(2), math.exp(own - both)

    def one(context, bit, prefix):
        p = None
        for d in range(depth, -1, -1):
            if (node := (context[len(context) - d :], bit, prefix)) in counts:
                n0, n1 = counts[node]
                est, own = (n1 + 0.5) / (n0 + n1 + 1), weighted(*node)[1]
                p = est if p is None else own * est + (1 - own) * p
        return 0.5 if p is None else p

    k, n = np.unique(np.concatenate([ctw.grams_of(t, depth) for t in texts]), return_counts=True)
    tree = ctw.ContextTree.of(k, n.astype(float), depth)
    for t in (texts[0], [b"abca", b"zzz", b"cab"], []):
        x = ctw.END * depth + b" ".join(t) + ctw.END
        want = 0.0
        for i in range(depth, len(x)):
            for bit in range(8):
                p = one(x[i - depth : i], bit, x[i] >> (8 - bit))
                want += math.log10(p if x[i] >> (7 - bit) & 1 else 1 - p)
        assert tree.log10(ctw.grams_of(t, depth)).sum() == pytest.approx(want, rel=1e-5)


def test_long_words_merge_as_the_library_does():
    from photonloom.llm.queries import tokenizer_path

    b = bpe.vocabulary(tokenizer_path("word_bpe_49k.json"))
    g = random.Random(1)
    for n in (1, 2, 64, 65, 66, 500, 100_000):
        w = "".join(g.choice("etaoinshr") for _ in range(n))
        want = b.library.encode(w, add_special_tokens=False).ids
        assert b.merge(w.encode()) == want
        if 1 < n < 1000:
            assert b.merge_long([b.inner[x] for x in w.encode()[:-1]] + [b.last[w.encode()[-1]]]) == want


def test_lexicon_is_minimal_and_exact():
    entries = {w: [i, i + 1] for i, w in enumerate(["tapped", "tapping", "tap", "taps", "wrapped", "wrapping", "wrap", "wraps"])}
    lex = bpe.Lexicon(bpe.compile_lexicon(entries))
    assert {w: lex[w] for w in entries} == entries
    assert lex["ta"] is None and lex["tapsx"] is None and lex[""] is None
    assert len(lex.finals) < 20  # suffixes are shared


def test_placement_is_balanced():
    g = random.Random(2)
    lengths = sorted((g.randrange(1, 1024) for _ in range(200)), reverse=True)
    whole, left = divmod(sum(lengths), 1024)
    caps = [1024] * whole + [1 << b for b in range(10, -1, -1) if left >> b & 1]
    out = packing.place(lengths, caps, 1.0, 1 / 1024)
    used = [0] * len(caps)
    for k, begin, end, j, offset in out:
        assert offset == used[j]
        used[j] += end - begin
    assert used == caps and len(out) < 1.7 * len(lengths)


def test_most_frequent_is_bounded(spark):
    d = spark.createDataFrame([(k, n) for k, n in enumerate([5, 5, 5, 9, 9, 20000, 7])], "w int, n long")
    assert sorted(r.n for r in most_frequent(d, 4).collect()) == [7, 9, 9, 20000]
    assert most_frequent(d, 6).count() == 4 and most_frequent(d, 0).count() == 0


def test_licenses_equal_brute_force(spark):
    """The base phrases by scanning word by word."""
    import re

    from photonloom.llm import licenses

    g = random.Random(8)
    texts = ["", None, "cc", "CC-BY"] + [" ".join(g.choice(["cc", "by", "BY,", "general", "public", "license", "all", "rights", "reserved", "caf\u00e9"]) for _ in range(g.randrange(1, 60))) for _ in range(60)]
    got = {r.doc_id: r for r in licenses.scan_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    phrases = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    for k, t in enumerate(texts):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = sorted((i, label) for p, label in phrases.items() for i in range(len(w)) if tuple(w[i : i + len(p)]) == p)
        r = got[k]
        assert (r.n_words, r.n_base) == (len(w), len(at))
        assert (r.first_word, r.last_word) == ((at[0][0], at[-1][0]) if at else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and set(r.base_labels.split(",")) <= set(r.labels.split(","))


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_sql_gives_the_same_rows(spark):
    import duckdb

    from photonloom.llm import queries

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    for name, sql in (("op1_quality", quality.ORACLE_SQL), ("op9_lines", lines.ORACLE_SQL)):
        want = con.sql(sql).df()
        got = queries.queries()[name](spark, SF).toPandas()[list(want.columns)]
        rows = lambda d: sorted(map(str, d.astype(str).itertuples(index=False, name=None)))
        assert rows(got) == rows(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_held_out_languages(spark):
    from photonloom.llm import queries

    lang = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    out = queries.op5_language(spark, SF).join(lang, "doc_id").where("held_out")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
