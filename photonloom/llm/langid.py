"""Language identification by cross-parsing.

For each language, labelled text is compiled into a suffix automaton of its
bytes. A text is parsed into the longest phrases that occur in the language's
text, across words; every phrase costs the bits of a pointer into that text,
log2 of its length; the language with the fewest bits a byte wins. Texts are
parsed side by side: one array step takes a byte of each of them through the
automata of all languages. A text goes through in blocks, and where one ends
the automata stand still until the next, so phrases run on across blocks.
"""

from __future__ import annotations

import functools
import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns

#: Bytes of each text that are held at a time.
BLOCK = 2048
#: Runs of word characters but digits and '_'.
WORD = re.compile(r"[^\W\d_]+")


@functools.cache
def letters() -> re.Pattern:
    """Runs of letters: as WORD, but without the numbers that aren't digits (fractions, superscripts, numerals)."""
    numbers = "".join(c for c in map(chr, range(0x110000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
    return re.compile(f"[^\\W\\d_{re.escape(numbers)}]+")


def normalised(text: str | None) -> bytes:
    """The words of letters in lower case, each with a space before it, and a space at the end; empty if there is no letter."""
    low = (text or "").lower()
    words = WORD.findall(low)
    if not "".join(words).isalpha():  # numbers among them
        words = letters().findall(low)
    return f" {' '.join(words)} ".encode() if words else b""


def suffix_automaton(text: str | bytes) -> list[dict]:
    """The transitions of the minimal automaton of all substrings of text; state 0 is the start."""
    nxt: list[dict] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


@dataclass(frozen=True)
class LanguageModel:
    """The automata of all languages in one table of steps.

    steps[state * width + symbol] is twice the next state (times width), plus
    one if a phrase ends before the symbol, which then begins the next one.
    """

    languages: list[str]  # sorted
    symbol: np.ndarray  # of each byte; 0 for those that no language has
    width: int
    starts: np.ndarray  # each language's first state, times width
    steps: np.ndarray
    bits: list[float]  # of a phrase

    @staticmethod
    def of(texts: dict[str, bytes]) -> LanguageModel:
        languages = sorted(texts)
        used = sorted(set(b"".join(texts.values())))
        symbol = np.zeros(256, dtype=np.int32)
        symbol[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        parts, starts, at = [], [], 0
        for lang in languages:
            automaton = suffix_automaton(texts[lang])
            n = len(automaton) + 1  # and a state that nothing follows, after a byte that the language doesn't have
            table = np.full((n, width), -1, dtype=np.int64)
            for k, arcs in enumerate(automaton):
                for c, t in arcs.items():
                    table[k, symbol[c]] = t
            table[0, table[0] < 0] = n - 1
            ends = table < 0
            table = np.where(ends, table[0], table)
            parts.append((((table + at) * width) << 1 | ends).ravel())
            starts.append(at * width)
            at += n
        steps = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return LanguageModel(languages, symbol, width, np.array(starts, dtype=np.int64), steps.astype(np.int32 if at * width < 1 << 30 else np.int64), [math.log2(len(texts[x]) + 1) for x in languages])

    def begin(self, n: int) -> np.ndarray:
        """The states of all languages (rows) before any byte of n texts (columns)."""
        return np.repeat(self.starts[:, None], n, axis=1).astype(self.steps.dtype)

    def advance(self, blocks: list[bytes], state: np.ndarray) -> np.ndarray:
        """Takes state through one block of each text and returns how many phrases end on the way, by language and block."""
        order = np.array(sorted(range(len(blocks)), key=lambda k: -len(blocks[k])), dtype=np.int64)
        size = np.array([len(blocks[k]) for k in order])
        data = np.zeros((len(blocks), int(size.max(initial=0))), dtype=np.uint8)
        for row, k in zip(data, order):
            row[: len(blocks[k])] = np.frombuffer(blocks[k], dtype=np.uint8)
        columns = self.symbol.astype(self.steps.dtype)[data.T]
        now = state[:, order]
        count = np.zeros(now.shape, dtype=np.int32)
        live = np.searchsorted(-size, -np.arange(len(columns)), side="left")  # the blocks that are longer than so many bytes
        for j, n in enumerate(live.tolist()):
            step = self.steps[now[:, :n] + columns[j, :n]]
            count[:, :n] += step & 1
            now[:, :n] = step >> 1
        state[:, order] = now
        out = np.empty_like(count)
        out[:, order] = count
        return out

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """The number of longest-match phrases of each text, by language (rows) and text (columns); none for an empty one."""
        size = np.array([len(t) for t in texts], dtype=np.int64)
        total = np.repeat((size > 0)[None].astype(np.int64), len(self.languages), axis=0)  # the phrase that the text ends in
        lanes = np.flatnonzero(size)
        state = self.begin(len(lanes))
        for at in range(0, int(size.max(initial=0)), BLOCK):
            on = size[lanes] > at
            lanes, state = lanes[on], state[:, on]
            total[:, lanes] += self.advance([texts[k][at : at + BLOCK] for k in lanes], state)
        return total


def fit(docs: DataFrame, learn, docs_per_language: int = 64, bytes_per_language: int = 24_000, bytes_in_all: int = 480_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """A model from rows with text and language for which learn(id column) holds.

    Every language is learned from a bounded sample: the docs_per_language rows
    with the least hash of id and text, of any length. Of each a passage is
    taken, at a place that its hash says; passages are as long as fills
    bytes_per_language (an equal share of bytes_in_all, where that is less)
    twice over, and are put together until it is full.
    """
    rows = docs.select(F.col(id_col).alias("i"), F.col(lang_col).alias("l"), F.col(text_col).alias("t")).where("i IS NOT NULL AND l IS NOT NULL AND t IS NOT NULL").where(learn(F.col("i")))
    rows = rows.where(F.regexp_like("t", F.lit(r"\p{L}"))).select("l", "t", F.xxhash64("i", "t").alias("h"))
    langs = sorted(r.l for r in rows.select("l").distinct().collect())  # languages are few
    room = min(bytes_per_language, bytes_in_all // max(len(langs), 1))
    passage = max(2 * room // docs_per_language, 1)
    keyed = rows.select("l", "h").withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h"))).where(F.col("r") <= docs_per_language).select("l", "h").distinct()
    begin = F.pmod(F.xxhash64("h"), F.greatest(F.length("t") - passage + 1, F.lit(1))).cast("int") + 1
    chosen = rows.join(F.broadcast(keyed), ["l", "h"]).select("l", "h", F.substring(F.col("t"), begin, F.lit(passage)).alias("t")).distinct()  # docs_per_language short rows a language
    learned: dict[str, bytes] = dict.fromkeys(langs, b"")
    for r in chosen.orderBy("l", "h", "t").collect():
        own = normalised(r.t)
        if not learned[r.l] or len(learned[r.l]) + len(own) <= room:
            learned[r.l] += own
    return LanguageModel.of({k: v for k, v in learned.items() if v})


class Identifier:
    """Languages of texts; so many are parsed side by side."""

    def __init__(self, model: LanguageModel, at_once: int = 4096):
        self.model, self.at_once = model, at_once

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float, list[float]]]:
        """For each text: language, confidence and bits a byte of each language."""
        m = self.model
        out: list[tuple[str, float, list[float]]] = [("und", 0.0, [])] * len(texts)
        if not m.languages:
            return out
        order = sorted(range(len(texts)), key=lambda k: -len(texts[k] or ""))  # texts of like lengths end together
        for lo in range(0, len(texts), self.at_once):
            some = order[lo : lo + self.at_once]
            data = [normalised(texts[k]) for k in some]
            counts = m.phrases(data)
            for k, d in enumerate(data):
                if not d:
                    continue
                rate = [float(n) * b / len(d) for n, b in zip(counts[:, k], m.bits)]
                best = min(rate)
                odds = [2.0 ** -min(8 * (r - best), 1000) for r in rate]
                j = rate.index(best)
                out[some[k]] = (m.languages[j], odds[j] / sum(odds), rate)
        return out


def identify_documents(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score (confidence, 0 to 1) and bits_per_byte of each language in the model's order.

    Whole texts, however long; null, empty and letterless texts get 'und', 0
    and no bits; of languages with equally many bits the first in order wins.
    Columns with these names are replaced; rows stay as they are, repeated ones
    too; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by fit()
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.ArrayType(T.DoubleType()))]

    def make():
        identify = Identifier(shared.value)

        def run(texts):
            return [list(c) for c in zip(*identify(texts))] if texts else [[], [], []]

        return run

    return append_columns(docs, text_col, fields, make)
