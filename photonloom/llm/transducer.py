"""Token counts by a deterministic transducer whose transitions carry the tokens they add.

A merge vocabulary has one property that makes it finite-state: of all tokens
that end at a byte of a word, exactly one fits behind the last token of the
text before it. So a word read so far is described by the places at which a
token under way may have begun, each with the token that ends there and the
number of tokens up to there. These descriptions are the states; a byte leads
to the next one and changes the count by a whole number. What a word's end adds
is known in each state. Above the bytes lie the states that split text into
words (letters, single digits, other signs, contractions).

The vocabulary's own words are compiled at first, other states when a text asks
for them. What a chunk of text does to a state is a map; maps compose in any
grouping, so the chunks of a long text are worked on side by side and folded by
a scan.
"""

from __future__ import annotations

import functools
import hashlib
import unicodedata
from ast import literal_eval

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import WordBpe, vocabulary
from .common import append_columns, staged
from .packing import PLAIN

#: The word pattern's contractions: the letters after the apostrophe (fixed values).
SHORT, LONG = frozenset("stmd"), {"r": "e", "v": "e", "l": "l"}


class Prefix:
    """A word read so far: its last bytes, the open beginnings in them as (bytes back, token before, tokens so far relative to now), and what the word's end adds."""

    __slots__ = ("suffix", "marks", "end", "next")

    def __init__(self, suffix: bytes, marks: tuple, end: int):
        self.suffix, self.marks, self.end, self.next = suffix, marks, end, {}


class State(dict):
    """Maps a character to the next state and the tokens added; fills itself in when asked for more."""

    __slots__ = ("machine", "kind", "at", "end")

    def __init__(self, machine: Transducer, kind: str, at, end: int):
        super().__init__()
        self.machine, self.kind, self.at, self.end = machine, kind, at, end

    def __missing__(self, char: str) -> tuple[State, int]:
        arc = self[char] = self.machine.move(self, char)
        self.machine.arcs += 1
        return arc


class Transducer:
    """The compiled vocabulary of a word-level merge tokenizer; most: arcs and pairs kept in memory (more are worked out anew)."""

    def __init__(self, bpe: WordBpe, most: int = 1_000_000):
        self.bpe, self.most = bpe, most
        spelled = {t: (bytes([b]), False) for b, t in enumerate(bpe.inner)} | {t: (bytes([b]), True) for b, t in enumerate(bpe.last)}
        for pair, made in bpe.rank.items():
            (a, _), (b, last) = spelled[pair >> 20], spelled[pair & 0xFFFFF]
            spelled[made & 0xFFFFF] = (a + b, last)
        self.spelled = spelled
        self.inner = {s: t for t, (s, last) in spelled.items() if not last}
        self.last = {s: t for t, (s, last) in spelled.items() if last}
        self.begun = {s[:i] for s, _ in spelled.values() for i in range(1, len(s))}
        self.classes: dict[str, str] = {}
        self.empty()

    def empty(self) -> None:
        """Forgets all states but the first ones; those in use go on working."""
        self.arcs, self.pairs, self.prefixes, self.states = 0, {}, {}, {}
        self.root = Prefix(b"", ((0, -1, 0),), 0)
        self.start = State(self, "start", None, 0)
        self.states["start", None] = self.start

    def make_room(self) -> None:
        if self.arcs + len(self.pairs) > self.most:
            self.empty()

    def fits(self, a: int, b: int) -> bool:
        """Whether the two tokens stay as they are side by side (a below 0: the word begins with b)."""
        key = a << 20 | b
        if key not in self.pairs:
            (x, _), (y, last) = self.spelled.get(a, (b"", False)), self.spelled[b]
            inner, s = self.bpe.inner, x + y
            ids = [inner[c] for c in s[:-1]] + [(self.bpe.last if last else inner)[s[-1]]]
            self.pairs[key] = self.bpe.merge_ids(ids) == ([b] if a < 0 else [a, b])
        return self.pairs[key]

    def byte(self, p: Prefix, b: int) -> tuple[Prefix, int]:
        """The prefix with one more byte, and the tokens that it adds (or takes away, where tokens grow together)."""
        if b in p.next:
            return p.next[b]
        s, n, now, end, open_ = p.suffix + bytes([b]), len(p.suffix), None, None, []
        for back, before, count in p.marks:
            piece = s[n - back :]
            t, u = self.inner.get(piece), self.last.get(piece)
            if now is None and t is not None and self.fits(before, t):
                now, token = count + 1, t
            if end is None and u is not None and self.fits(before, u):
                end = count + 1
            if piece in self.begun:
                open_.append((back + 1, before, count))
        marks = (*[(back, before, count - now) for back, before, count in open_], (0, token, 0))
        p.next[b] = self.prefix(s[len(s) - marks[0][0] :], marks, end - now), now
        return p.next[b]

    def prefix(self, suffix: bytes, marks: tuple, end: int) -> Prefix:
        key = (suffix, marks, end)
        return self.prefixes.get(key) or self.prefixes.setdefault(key, Prefix(*key))

    def state(self, kind: str, at) -> State:
        key = (kind, at)
        if key not in self.states:
            end = at.end if isinstance(at, Prefix) else self.word("'") + (self.word(at) if at else 0)
            self.states[key] = State(self, kind, at, end)
        return self.states[key]

    def grown(self, kind: str, p: Prefix, char: str) -> tuple[State, int]:
        added = 0
        for b in char.encode("utf-8", "replace"):
            p, d = self.byte(p, b)
            added += d
        return self.state(kind, p), added

    def word(self, text: str) -> int:
        """The tokens of a whole word."""
        s, n = self.grown("letters", self.root, text)
        return n + s.end

    def kind_of(self, char: str) -> str:
        """space, digit, letters or signs, as the library's splitting has it."""
        if char not in self.classes:
            found = [w for w, _ in self.bpe.library.pre_tokenizer.pre_tokenize_str(f"a{char}{char}a")]
            self.classes[char] = {1: "letters", 2: "space", 3: "signs", 4: "digit"}[len(found)]
        return self.classes[char]

    def begin(self, char: str) -> tuple[State, int]:
        kind = self.kind_of(char)
        if char == "'":
            return self.state("quote", ""), 0
        if kind in ("space", "digit"):
            return self.start, 0 if kind == "space" else self.word(char)
        return self.grown(kind, self.root, char)

    def move(self, s: State, char: str) -> tuple[State, int]:
        if s.kind == "start":
            return self.begin(char)
        if s.kind == "quote":
            if s.at and LONG[s.at] == char or not s.at and char in SHORT:
                return self.start, self.word("'" + s.at + char)
            if not s.at and char in LONG:
                return self.state("quote", char), 0
            # no contraction: the apostrophe is a sign, and what came behind it a word's beginning
            t, n = self.grown("signs", self.root, "'")
            if s.at:
                t, n = self.grown("letters", self.root, s.at)[0], n + t.end + self.grown("letters", self.root, s.at)[1]
            u, m = t[char]
            return u, n + m
        if self.kind_of(char) == s.kind:
            return self.grown(s.kind, s.at, char)
        t, n = self.begin(char)
        return t, s.end + n

    def run(self, s: State, text: str) -> tuple[State, int]:
        total = 0
        for c in text:
            s, n = s[c]
            total += n
        return s, total

    def resets(self, char: str) -> bool:
        """Whether every state ends its word at the character and is the first state again behind it."""
        return self.kind_of(char) in ("space", "digit")

    def name(self, s: State) -> str:
        """A state as text that every task understands."""
        return repr((s.kind, (s.at.suffix, s.at.marks, s.at.end) if isinstance(s.at, Prefix) else s.at))

    def named(self, text: str) -> State:
        kind, at = literal_eval(text)
        return self.start if kind == "start" else self.state(kind, self.prefix(*at) if isinstance(at, tuple) else at)

    def compile(self) -> Transducer:
        """States of all words of the vocabulary."""
        for s, last in list(self.spelled.values()):
            if last:
                try:
                    self.run(self.start, s.decode())
                except UnicodeDecodeError:
                    continue
        return self

    # What a chunk does to a state: (head, count, exit). The head is what comes before the first character that
    # resets; from there on neither count nor exit depends on the state before. A chunk that has no such character
    # is all head, and has no exit.

    def chunk_map(self, text: str) -> tuple[str, int, str | None]:
        self.make_room()
        at = next((i for i, c in enumerate(text) if self.resets(c)), -1)
        if at < 0:
            return text, 0, None
        s, n = self.run(self.start, text[at:])
        return text[:at], n, self.name(s)

    def compose(self, a: tuple, b: tuple) -> tuple[str, int, str | None]:
        """The map of a's chunk followed by b's."""
        if a[2] is None:
            return a[0] + b[0], b[1], b[2]
        s, n = self.run(self.named(a[2]), b[0])
        return (a[0], a[1] + n, self.name(s)) if b[2] is None else (a[0], a[1] + n + s.end + b[1], b[2])

    def tokens(self, m: tuple) -> int:
        """The tokens of a text whose map is m."""
        s, n = self.run(self.start, m[0])
        return n + s.end + (m[1] + self.named(m[2]).end if m[2] is not None else 0)

    def plain(self, text: str) -> str:
        """The text as the library's normaliser leaves it, but for blanks."""
        if PLAIN.fullmatch(text):
            return (text if text.isascii() or unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)).lower()
        return self.bpe.library.normalizer.normalize_str(text)

    def count(self, text: str) -> int:
        """The tokens of a text, special tokens in it included."""
        self.make_room()
        total = 0
        for piece in self.bpe.marks.split(text) if "<|" in text else (text,):
            if piece in self.bpe.special:
                total += 1
            elif piece:
                s, n = self.run(self.start, self.plain(piece))
                total += n + s.end
        return total


@functools.lru_cache(1)
def transducer(path: str) -> Transducer:
    """One for all tasks that a worker runs."""
    return Transducer(vocabulary(path)).compile()


def joins_backward(char: str) -> bool:
    """Whether a character may change by normalisation with what comes before it."""
    return unicodedata.category(char)[0] == "M" or "ᄀ" <= char <= "ᇿ" or "ꥠ" <= char <= "꥿" or "ힰ" <= char <= "퟿"


def chunks(text: str, size: int):
    """Cuts a text into chunks of about size characters, before a blank where there is one near, and never where normalising would join the parts."""
    at = 0
    while at < len(text):
        end = at + size
        while end < len(text) and not text[end].isspace() and end < at + size + min(size, 256):
            end += 1
        if end < len(text) and not text[end].isspace():
            end = at + size
            while end < len(text) and joins_backward(text[end]):
                end += 1
        yield text[at:end]
        at = end


def count_tokens(docs: DataFrame, tokenizer: str, text_col: str = "text", long: int = 1 << 20, chunk: int = 1 << 16) -> DataFrame:
    """docs without their text, with n_bytes (UTF-8) and n_tokens, special tokens in a text counted as the library does.

    Whole texts of any length. A null or empty text has no bytes and no tokens;
    repeated rows each get their count; an empty table gives no rows; columns
    of docs with the new names are replaced, all others stay. Texts of more
    than `long` characters are cut into chunks, which are dealt to tasks and
    folded; equal long texts are counted once. Chunk and limit change nothing
    in the counts.
    """
    rest = [c for c in docs.columns if c not in (text_col, "n_bytes", "n_tokens")]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    kept = [F.col(f"`{c}`") for c in rest]
    is_long = F.length(text) > long

    def make():
        count = transducer(tokenizer).count
        return lambda texts: [[count(t) for t in texts]]

    inner = "__counted_text"
    short = docs.where(~is_long).select(*kept, F.octet_length(text).cast("long").alias("n_bytes"), text.alias(inner))
    short = append_columns(short, inner, [T.StructField("n_tokens", T.LongType())], make).drop(inner)
    counts = count_long(docs.where(is_long).select(text.alias("text")), tokenizer, chunk)
    whole = docs.where(is_long).select(*kept, F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("__text_hash"))
    whole = whole.join(counts, F.col("__text_hash") == F.col("__counted_hash"), "left").drop("__text_hash", "__counted_hash")
    return short.unionByName(whole)


def count_long(texts: DataFrame, tokenizer: str, chunk: int) -> DataFrame:
    """The tokens of each distinct text: __counted_hash, n_tokens. Chunks of one text go to different tasks; their maps are folded in two rounds."""

    def cut(batches):
        import numpy as np

        marks, seen = vocabulary(tokenizer).marks, set()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                h = hashlib.sha256(t.encode()).hexdigest()
                if h in seen:
                    continue
                if len(seen) < 100_000:
                    seen.add(h)
                k = 0
                for i, part in enumerate(marks.split(t)):  # every second part is a special token
                    for c in (part,) if i % 2 else chunks(part, chunk):
                        yield pa.RecordBatch.from_arrays([pa.array([h]), pa.array(np.array([k])), pa.array([bool(i % 2)]), pa.array([c])], names=["h", "k", "special", "chunk"])
                        k += 1

    def maps(batches):
        m = transducer(tokenizer)
        for batch in batches:
            d = batch.to_pydict()
            found = [("", 1, m.name(m.start)) if s else m.chunk_map(m.plain(c)) for s, c in zip(d["special"], d["chunk"])]
            yield pa.RecordBatch.from_pydict({"h": d["h"], "k": d["k"], "head": [x[0] for x in found], "n": pa.array([x[1] for x in found], pa.int64()), "exit": pa.array([x[2] for x in found], pa.string())})

    def fold(rows):
        m = transducer(tokenizer)
        rows = rows.sort_values("k")
        head, n, exit_ = functools.reduce(m.compose, [(r.head, int(r.n), r.exit if isinstance(r.exit, str) else None) for r in rows.itertuples()])
        return rows.head(1)[["h", "k"]].assign(head=head, n=n, exit=[exit_])

    def total(rows):
        last = next(fold(rows).itertuples())
        return rows.head(1)[["h"]].assign(n_tokens=transducer(tokenizer).tokens((last.head, int(last.n), last.exit)))

    kind = "h string, k long, head string, n long, exit string"
    pieces = texts.mapInArrow(cut, "h string, k long, special boolean, chunk string").repartition("h", "k")
    found = staged(pieces.mapInArrow(maps, kind).dropDuplicates(["h", "k"]), "chunk-maps")
    blocks = found.withColumn("block", F.floor(F.col("k") / 512)).groupBy("h", "block").applyInPandas(fold, kind)
    return blocks.groupBy("h").applyInPandas(total, "h string, n_tokens long").withColumnRenamed("h", "__counted_hash")
