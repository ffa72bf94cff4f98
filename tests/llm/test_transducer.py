"""Token counts against the named library: whole texts, chunks in any grouping, edge cases."""

import os
import random

import pytest

from photonloom.llm import transducer
from photonloom.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
PATH = tokenizer_path("word_bpe_49k.json")
SIGNS = "abcdefghijklmnopqrstuvwxyz'''''' strelvdm 0123456789!?.,<>|/wé́中文가ᅡ \n\t 　İΣ٣½ः"
PARTS = ["<|endoftext|>", "<|startoftext|>", "'re", "'ll", "'ve", "'R", "ing", "the", "tion", "</w>", "<|end", "''"]


@pytest.fixture(scope="module")
def machine():
    return transducer.Transducer(transducer.vocabulary(PATH))


def library(machine, text):
    return len(machine.bpe.library.encode(text, add_special_tokens=False).ids)


def texts(n, seed=1):
    g = random.Random(seed)
    for k in range(n):
        if k % 3:
            yield "".join(g.choice(SIGNS) if g.random() < 0.8 else g.choice(PARTS) for _ in range(g.randint(0, 40)))
        else:
            yield "".join(g.choice("abcdeinorst") for _ in range(60))


def test_counts_are_the_librarys(machine):
    for t in texts(3000):
        assert machine.count(t) == library(machine, t), repr(t)


def test_state_is_forgotten_without_loss():
    small = transducer.Transducer(transducer.vocabulary(PATH), most=200)
    for t in texts(300, seed=2):
        assert small.count(t) == library(small, t), repr(t)
    assert small.arcs + len(small.pairs) < 2000


def test_exactly_one_token_fits(machine):
    """What makes the vocabulary finite-state: at each byte one open beginning alone gives a token."""
    for t in texts(300, seed=3):
        p = machine.root
        for b in t.encode()[:80]:
            s, n = p.suffix + bytes([b]), len(p.suffix)
            for of in (machine.inner, machine.last):
                assert sum(s[n - back :] in of and machine.fits(before, of[s[n - back :]]) for back, before, _ in p.marks) == 1
            p, _ = machine.byte(p, b)


def test_maps_compose_in_any_grouping(machine):
    g = random.Random(5)
    for t in texts(400, seed=4):
        t = machine.plain(t.replace("<|", "<"))
        cuts = sorted(g.sample(range(len(t) + 1), min(5, len(t) + 1)))
        maps = [machine.chunk_map(t[a:b]) for a, b in zip([0, *cuts], [*cuts, len(t)])]
        whole = machine.run(machine.start, t)
        while len(maps) > 1:
            i = g.randrange(len(maps) - 1)
            maps[i : i + 2] = [machine.compose(maps[i], maps[i + 1])]
        assert machine.tokens(maps[0]) == whole[1] + whole[0].end


def test_names_of_states(machine):
    for t in texts(200, seed=6):
        s, _ = machine.run(machine.start, machine.plain(t))
        assert machine.named(machine.name(s)) is s


def test_chunks_make_up_the_text(machine):
    for t in (*texts(200, seed=7), "中" * 500, "e" + "́" * 300, "가" * 200, " " * 50):
        parts = list(transducer.chunks(t, 7))
        assert "".join(parts) == t and all(parts)
        assert machine.plain(t).split() == "".join(machine.plain(p) for p in parts).split()


ROWS = [(1, "The quick brown fox's tail, isn't it? 'Twas 2024!"), (1, "The quick brown fox's tail, isn't it? 'Twas 2024!"), (2, None), (3, ""), (4, " \n\t "), (None, "no id <|endoftext|>at all"), (5, "x" * 30000), (6, "lorem ipsum dolor sit amet " * 3000), (7, "中文" * 4000), (8, "ab <|startoftext|> cd'll " * 700), (9, "x" * 30000)]
SCHEMA = "doc_id long, text string, n_tokens string, n_bytes string, h string, k long"


@pytest.mark.parametrize("limits", [{}, {"long": 100, "chunk": 64}, {"long": 1000, "chunk": 1024}], ids=["whole", "small chunks", "chunks"])
def test_rows(spark, machine, limits):
    df = spark.createDataFrame([(*r, "n", "b", "h", 1) for r in ROWS], SCHEMA)
    out = transducer.count_tokens(df, PATH, **limits)
    assert sorted(out.columns) == ["doc_id", "h", "k", "n_bytes", "n_tokens"]
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.h, r.k) for r in out.collect()), key=str)
    want = sorted(((i, len((t or "").encode()), library(machine, t or ""), "h", 1) for i, t in ROWS), key=str)
    assert got == want
    assert transducer.count_tokens(df.limit(0), PATH, **limits).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_query(spark, machine):
    from photonloom.llm.queries import op12_token_counts

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in op12_token_counts(spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        n = library(machine, d.text or "")
        assert (got[d.doc_id].n_tokens, got[d.doc_id].n_bytes, got[d.doc_id].over_limit) == (n, len((d.text or "").encode()), n > 2048)
