"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from photonloom.llm import bpe, ctw, langid, licenses, lines, neardup, packing, quality, toxicity, winnow
from photonloom.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, h string"
LONG = "lorem ipsum dolor sit amet " * 4000
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and runs", "en", "a"),
    (1, "the quick brown fox jumps over the lazy dog and runs", "en", "a"),  # a repeated row
    (2, None, "en", "b"),
    (3, "", None, None),
    (4, LONG, "la", "c"),
    (5, "the quick brown fox jumps over the lazy dog and runs", None, "d"),  # a tie
    (None, "no id here but some words in it all the same", "en", "e"),
    (6, " \n\t ", "de", "f"),
    (7, "12345 !!! ###", "de", "f"),
    (8, "x" * 30000, "de", "g"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), "s", "k", "h") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 1, 1), (5, 1, 0), (8, 0, 1), (None, None, None)], "doc_id long, quality int, toxic int")


def test_quality(docs, empty):
    def run(df):
        return quality.cascade(df, quality.default_rules(), first=quality.base_rules()).collect()

    got = run(docs)
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert by[2].n_words == 0 and by[2].rejected_by == "short"
    assert by[4].n_words == 20000 and by[4].n_repeat_words == 20000 and by[4].rejected_by == "repetitive"
    assert by[7].n_symbols == 3 and by[8].n_words == 1
    assert run(empty) == []


def test_packing(docs, empty):
    path = tokenizer_path("byte_bpe_50k.json")
    got = packing.pack_documents(docs, path, block_docs=3).collect()
    encode = packing.encoder(path).library
    want = sorted(((r[0] or 0, [*encode.encode(r[1] or "", add_special_tokens=False).ids, 0]) for r in ROWS), key=str)
    whole = {}
    for r in sorted(got, key=lambda r: r.start):
        assert zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r.ids)) == r.ids_crc32
        whole.setdefault((r.doc_id or 0, r.doc_tokens), []).extend(r.ids)
    total = sum(len(ids) for _, ids in want)
    assert sum(map(len, whole.values())) == total
    assert all(whole[(i, len(ids))][: len(ids)] == ids or i == 1 for i, ids in want)
    used = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert used.get(r.sequence_id, 0) == r.offset
        used[r.sequence_id] = r.offset + r.length
    assert all(n & (n - 1) == 0 and n <= 1024 for n in used.values())  # no padding at all
    assert packing.pack_documents(empty, path).collect() == []


def test_toxicity(docs, empty, labels):
    model = toxicity.fit(docs, labels, toxicity.default_learn, min_count=1)
    got = toxicity.score_documents(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    nothing = toxicity.fit(empty, labels.limit(0), toxicity.default_learn)
    assert toxicity.score_documents(empty, nothing).collect() == []
    assert {r.score for r in toxicity.score_documents(docs, nothing).collect()} != {None}


def test_licenses(docs, empty, spark):
    got = licenses.scan_documents(docs).collect()
    assert len(got) == len(ROWS) and all(r.n_base == 0 for r in got)
    assert licenses.scan_documents(empty).collect() == []
    more = spark.createDataFrame([(1, "CC-BY all rights reserved; All Rights, Reserved"), (2, "This work is licensed under the (splendid) GNU General Public License, version 3")], "doc_id long, text string")
    by = {r.doc_id: r for r in licenses.scan_documents(more).collect()}
    assert (by[1].n_base, by[1].first_word, by[1].last_word, by[1].base_labels) == (3, 0, 5, "cc-by,reserved")
    assert by[2].labels == "gpl" and by[2].n_base == 1 and by[2].score == 1.0


def test_language(docs, empty):
    model = langid.fit(docs, lambda i: i > 0)
    got = {r.doc_id: r for r in langid.identify_documents(docs, model).collect()}
    assert got[2].lang_pred == got[3].lang_pred == got[7].lang_pred == "und"
    assert got[1].lang_pred == "en" and got[4].lang_pred == "la"
    assert langid.identify_documents(empty, langid.fit(empty, lambda i: i > 0)).collect() == []
    assert {r.lang_pred for r in langid.identify_documents(docs, langid.fit(empty, lambda i: i > 0)).collect()} == {"und"}


def test_bpe(docs, empty):
    path = tokenizer_path("word_bpe_49k.json")
    got = bpe.encode_documents(docs, path, lexicon_size=5).collect()
    tk = bpe.vocabulary(path).library
    assert len(got) == len(ROWS)
    for r in got:
        text = next(x[1] for x in ROWS if x[0] == r.doc_id) or ""
        ids = tk.encode(text, add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == tk.decode(ids, skip_special_tokens=False) and r.n_tokens == len(ids)
    assert bpe.encode_documents(empty, path).collect() == []


def test_near_duplicates(docs, empty):
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect()), key=str)
    by = {g[0]: g for g in got}
    assert len(got) == len(ROWS)
    assert by[1] == (1, 7, 1, True) and by[5] == (5, 7, 1, False)
    assert by[2] == (2, 0, 2, True) and by[0][2] is None and by[4][1] == 5
    assert neardup.near_duplicates(empty).collect() == []


def test_winnow(docs, empty):
    got = winnow.fingerprint_with_edits(docs).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert by[2].prints == by[3].prints == [] and by[5].prints == by[1].prints
    assert winnow.fingerprint_with_edits(empty).collect() == []


def test_lines(docs, empty, spark):
    got = lines.dedup_lines(docs, min_sites=2).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert by[5].emptied and not by[1].emptied and by[2].n_lines == 0 and by[2].text is None
    assert lines.dedup_lines(empty).collect() == []
    rows = [(k, "common\nown %d" % k, f"s{k}") for k in range(1, 8)] + [(3, "precious\nother", "s1"), (3, "other\ncommon", "s1"), (9, "common\n" * 2000 + "end", "s2")]
    got = {(r.doc_id, r.text, r.n_removed) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_sites=6).collect()}
    assert got >= {(1, "common\nown 1", 0), (3, "precious\nother", 0), (3, "other", 1), (3, "own 3", 1), (9, "end", 2000)}


def test_scores(docs, empty):
    model, words = ctw.fit(docs, F.col("doc_id") != 4, depth=2)
    got = ctw.score_documents(docs, model, words).collect()
    assert len(got) == len(ROWS) and all(r.score <= 0 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (2, 3, 6)} == {1}
    nothing, none = ctw.fit(empty, F.lit(True))
    assert ctw.score_documents(empty, nothing, none).collect() == []
    assert {r.base_score for r in ctw.score_documents(docs.where("doc_id = 3"), nothing, none).collect()} == {0.0}


def test_pipeline(spark, docs, empty, labels, tmp_path):
    import corpus_pipeline

    for k, table in enumerate((docs, empty)):
        sf = str(tmp_path / str(k))
        table.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{sf}/documents.parquet")
        labels.write.parquet(f"{sf}/labels.parquet")
        out = corpus_pipeline.run(spark, sf).collect()
        assert bool(out) == (k == 0)
        assert len({hashlib.sha256(str(r).encode()).digest() for r in out}) == len(out)


def test_stages_keep_further_columns(spark, docs, empty, labels, tmp_path):
    """Columns that bear the names of the operators' own come back as they were; rows keep theirs."""
    import corpus_pipeline

    labels.write.parquet(f"{tmp_path}/labels.parquet")
    names = ["score", "passages", "lang_pred", "bits_per_byte", "n_lines", "n_removed", "emptied", "kept", "component_id", "n_shingles", "__i", "rep", "digest", "a.b"]
    more = lambda df: df.select("doc_id", "text", "lang", "source", "n_chars", *[F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))).alias(n) for n in names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        full, none = more(docs), more(empty)
        out = stage(spark, full, str(tmp_path))
        assert out.columns == full.columns and out.dtypes == full.dtypes
        rows = out.collect()
        assert rows and all(r[n] == f"{n}{'?' if r.doc_id is None else r.doc_id}" for r in rows for n in names)
        assert stage(spark, none, str(tmp_path)).collect() == []
    assert corpus_pipeline.packing_stage(spark, more(docs), str(tmp_path)).count() > 0


def test_pipeline_stages_one_after_the_other(spark, tmp_path):
    """Small documents whose fate is known by stage."""
    import random

    import corpus_pipeline

    g = random.Random(5)
    good = ["".join(g.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    text = lambda n: " ".join(g.choice(good) for _ in range(n))
    rows = [(k, text(60) + ("\nmenu home contact" if 20 <= k < 30 else ""), "en", f"s{k % 9}") for k in range(100)]
    rows += [(k, text(20) + " qqzx vvzk wwzj " * 3, "en", "s1") for k in range(100, 160)]  # toxic
    rows += [(200, "1234 5678", "en", "s2"), (201, None, "en", "s2"), (202, rows[50][1], "en", "s3"), (203, rows[50][1] + " more", "en", "s4"), (204, "menu home contact", "en", "s5")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(100 <= k < 160)) for k in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    stages = dict(corpus_pipeline.STAGES)
    docs = stages["toxicity"](spark, docs, str(tmp_path)).cache()
    assert ids(docs) == {*range(100), 200, 201, 202, 203, 204}
    docs = stages["language"](spark, docs, str(tmp_path)).cache()
    assert ids(docs) == {*range(100), 202, 203, 204}
    docs = stages["line_dedup"](spark, docs, str(tmp_path)).cache()
    assert ids(docs) == {*range(100), 202, 203}
    by = {r.doc_id: r for r in docs.collect()}
    assert [k for k in range(20, 30) if "menu" in by[k].text] == [20] and all(r.n_chars == len(r.text) for r in by.values())
    docs = stages["near_dedup"](spark, docs, str(tmp_path)).cache()
    assert ids(docs) == set(range(100))
    assert ids(stages["packing"](spark, docs, str(tmp_path))) == set(range(100))
    assert ids(corpus_pipeline.run(spark, str(tmp_path))) == set(range(100))


def test_licenses_by_row(spark):
    """Rows that share an id, or have none, each have their own spans; repeated rows have the same."""
    a, b, c = "this work is cc by and all rights reserved here", "nothing to see in this row at all", "published as cc by today"
    rows = [(1, a), (1, b), (1, a), (None, c), (None, b), (None, None), (2, b), (0, c)]
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()), key=str)
    of = {a: (10, 2, 3, 6, "cc-by,reserved"), b: (8, 0, None, None, ""), c: (5, 1, 2, 2, "cc-by"), None: (0, 0, None, None, "")}
    assert got == sorted(((i, *of[t]) for i, t in rows), key=str)


def test_whole_license_notices(spark):
    """Each template is found in its own text, also where some words are missing or put in, and long notices among other words."""
    rows = [(k, "before it " + t.text + " and after it") for k, t in enumerate(licenses.NOTICES)]
    got = {r.doc_id: r for r in licenses.scan_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(t.label in got[k].labels.split(",") and got[k].score == 1.0 for k, t in enumerate(licenses.NOTICES))
    long = next(t for t in licenses.NOTICES if len(t.text.split()) > 60).text.split()
    cut = long[:20] + ["truly"] + long[20:40] + long[42:]
    spans = licenses.find_spans(spark.createDataFrame([(1, " ".join(cut))], "doc_id long, text string"), [licenses.Template("whole", " ".join(long))]).collect()
    assert [(s.first_word, s.last_word) for s in spans] == [(0, len(cut) - 1)] and 0.9 < spans[0].cover < 1
