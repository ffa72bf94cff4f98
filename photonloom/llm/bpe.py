"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The most frequent words of the corpus and their ids are compiled into one
minimal acyclic automaton (suffixes shared; the number of words passed on the
way is a word's number, which addresses its ids). Tasks memory-map it, walk it
for each word new to them, and merge exactly whatever it doesn't accept.
"""

from __future__ import annotations

import functools
import json
import mmap
import re
import struct
import tempfile
import unicodedata
from array import array
from bisect import bisect_left
from hashlib import sha256
from heapq import heapify, heappop, heappush

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, most_frequent, staged
from .packing import PLAIN, byte_alphabet

#: The published word pattern of this family of vocabularies (fixed value).
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

#: Longer words are encoded anew each time and don't go into the lexicon.
LONGEST_KEPT = 64


def compile_lexicon(entries: dict[str, list[int]]) -> bytes:
    """The image of a minimal acyclic transducer: header, states, transitions, offsets of ids, ids; unsigned 32-bit words."""
    words = sorted(entries)
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []

    def freeze(final: bool, arcs: list[tuple[str, int]]) -> int:
        key = (final, tuple(arcs))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    # path[i]: the state after i letters of the word before, not yet shared: [final, arcs]
    path: list[list] = [[False, []]]
    before = ""
    for w in [*words, ""]:
        shared = 0
        while shared < min(len(w), len(before)) and w[shared] == before[shared]:
            shared += 1
        while len(path) > shared + 1:
            final, arcs = path.pop()
            path[-1][1].append((before[len(path) - 1], freeze(final, arcs)))
        for _ in w[shared:]:
            path.append([False, []])
        if w:
            path[-1][0] = True
        before = w
    root = freeze(*path[0])
    below: list[int] = []
    for final, arcs in states:  # a state comes after those that it leads to
        below.append(final + sum(below[t] for _, t in arcs))
    first, finals, labels, targets, skips = array("I"), array("I"), array("I"), array("I"), array("I")
    for final, arcs in states:
        first.append(len(labels))
        finals.append(final)
        passed = int(final)
        for letter, t in arcs:
            labels.append(ord(letter))
            targets.append(t)
            skips.append(passed)
            passed += below[t]
    first.append(len(labels))
    offsets, ids = array("I", [0]), array("I")
    for w in words:
        ids.extend(entries[w])
        offsets.append(len(ids))
    head = struct.pack("=5I", root, len(states), len(labels), len(words), len(ids))
    return head + b"".join(x.tobytes() for x in (first, finals, labels, targets, skips, offsets, ids))


class Lexicon:
    """A compiled lexicon, memory-mapped from a file that has no name any more once it is open."""

    def __init__(self, image: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(image)
            f.flush()
            self.view = memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)).cast("I")
        self.root, n, m, w, k = self.view[:5]
        at = 5
        for name, size in (("first", n + 1), ("finals", n), ("labels", m), ("targets", m), ("skips", m), ("offsets", w + 1), ("ids", k)):
            setattr(self, name, self.view[at : at + size])
            at += size

    def __getitem__(self, word: str) -> list[int] | None:
        state, number = self.root, 0
        for c in map(ord, word):
            hi = self.first[state + 1]
            lo = bisect_left(self.labels, c, self.first[state], hi)
            if lo == hi or self.labels[lo] != c:
                return None
            number += self.skips[lo]
            state = self.targets[lo]
        return self.ids[self.offsets[number] : self.offsets[number + 1]].tolist() if self.finals[state] else None


class WordBpe:
    """The vocabulary, exact merging of one word, the split of a text into words and special tokens, and decoding."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.token = {i: t for t, i in (vocab | self.special).items()}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        alphabet = byte_alphabet()
        self.byte = {c: b for b, c in enumerate(alphabet)}
        self.inner, self.last = [vocab[c] for c in alphabet], [vocab[c + suffix] for c in alphabet]
        merges = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.rank = {(vocab[a] << 20) | vocab[b]: (r << 20) | vocab[a + b] for r, (a, b) in enumerate(merges)}

    def merge(self, data: bytes) -> list[int]:
        """Merges the pair of least rank, leftmost first, until none is left."""
        ids = [self.inner[b] for b in data[:-1]]
        ids.append(self.last[data[-1]])
        return self.merge_ids(ids)

    def merge_ids(self, ids: list[int]) -> list[int]:
        """The same for a word given by the ids of its bytes."""
        if len(ids) > 64:
            return self.merge_long(ids)
        get, none = self.rank.get, 1 << 62
        ranks = [get((a << 20) | b, none) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i, new = ranks.index(best), best & 0xFFFFF
            ids[i : i + 2] = [new]
            del ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1] << 20) | new, none)
            if i < len(ranks):
                ranks[i] = get((new << 20) | ids[i + 1], none)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same in n log n steps: pairs wait in a heap, ids are linked; a pair that is no longer there is passed over."""
        get, n = self.rank.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := get((ids[i] << 20) | ids[i + 1])) is not None]
        heapify(heap)
        while heap:
            r, i = heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or get((ids[i] << 20) | ids[j]) != r:
                continue
            ids[i], ids[j] = r & 0xFFFFF, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (x := get((ids[i] << 20) | ids[k])) is not None:
                    heappush(heap, (x, i))
            if (h := before[i]) >= 0 and (x := get((ids[h] << 20) | ids[i])) is not None:
                heappush(heap, (x, h))
        return [x for x in ids if x >= 0]

    def words(self, text: str) -> list[str | bytes]:
        """Words as lower-case text or, from rare characters, as bytes."""
        if PLAIN.fullmatch(text):
            return WORDS.findall((text if text.isascii() or unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)).lower())
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(self.byte[c] for c in p) for p, _ in pieces]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.token[i] for i in ids)


@functools.lru_cache(2)
def vocabulary(path: str) -> WordBpe:
    return WordBpe(path)


class Encoder:
    """Encodes texts; what it knows of a word is kept, for so many words at most."""

    def __init__(self, path: str, image: bytes, kept: int = 400_000):
        self.bpe, self.lexicon, self.kept = vocabulary(path), Lexicon(image), kept
        self.known: dict[str | bytes, tuple[int, str, str]] = {}

    def ids(self, word: str | bytes) -> list[int]:
        found = self.lexicon[word] if isinstance(word, str) else None
        return found if found is not None else self.bpe.merge(word.encode() if isinstance(word, str) else word)

    def entry(self, word: str | bytes) -> tuple[int, str, str]:
        if len(self.known) >= self.kept:
            self.known.clear()
        ids = self.ids(word)
        e = (len(ids), " ".join(map(str, ids)), self.bpe.decode(ids))
        if len(word) <= LONGEST_KEPT:
            self.known[word] = e
        return e

    def __call__(self, text: str) -> tuple[int, str, str]:
        """The number of ids, the ids as text and the decoded text."""
        parts: list[tuple[int, str, str]] = []
        known, entry = self.known, self.entry
        for piece in self.bpe.marks.split(text) if "<|" in text else (text,):
            if piece in self.bpe.special:
                i = self.bpe.special[piece]
                parts.append((1, str(i), piece))
            elif piece:
                parts += [known.get(w) or entry(w) for w in self.bpe.words(piece)]
        return sum(p[0] for p in parts), " ".join([p[1] for p in parts]), " ".join([p[2] for p in parts])


def frequent_words(docs: DataFrame, size: int = 65536, text_col: str = "text") -> list[str]:
    """The words of letters that occur most often over all documents, size at most."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(r"\p{L}+"), F.lit(0))).alias("w")).where(F.length("w") <= LONGEST_KEPT)
    counts = staged(words.groupBy("w").agg(F.count("*").alias("n")).where("n > 1"), "words")
    return [r.w for r in most_frequent(counts, size).select("w").collect()]


def build_lexicon(docs: DataFrame, tokenizer: str, size: int = 65536, text_col: str = "text") -> bytes:
    bpe = vocabulary(tokenizer)
    return compile_lexicon({w: bpe.merge(w.encode()) for w in frequent_words(docs, size, text_col)})


def encode_documents(docs: DataFrame, tokenizer: str, lexicon_size: int = 65536, digests: bool = False, text_col: str = "text") -> DataFrame:
    """docs with n_tokens and, for digests, ids_sha256 and decoded_sha256, else ids and decoded.

    Whole texts; a null text counts as empty (no ids). Columns of docs with
    these names are replaced; rows stay as they are, repeated ones too; of
    words that tie in frequency at the lexicon's edge none goes in, which
    changes no id. A word of n bytes is merged in n log n steps, so texts may
    be of any length. An empty table gives no rows. The lexicon has
    lexicon_size words at most, so its image is bounded.
    """
    image = docs.sparkSession.sparkContext.broadcast(build_lexicon(docs, tokenizer, lexicon_size, text_col))
    text = [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    plain = [T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType())]

    def make():
        encode = _encoder(tokenizer, image)

        def run(texts):
            n, a, b = [], [], []
            for t in texts:
                count, ids, decoded = encode(t or "")
                n.append(count)
                a.append(sha256(ids.encode()).hexdigest() if digests else [int(i) for i in ids.split()])
                b.append(sha256(decoded.encode()).hexdigest() if digests else decoded)
            return [n, a, b]

        return run

    return append_columns(docs, text_col, [T.StructField("n_tokens", T.LongType()), *(text if digests else plain)], make)


_encoders: dict = {}


def _encoder(path: str, image) -> Encoder:
    """One encoder a worker, for the tasks that it runs one after the other."""
    key = (path, image._jid if hasattr(image, "_jid") else id(image))
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(path, image.value)
    return _encoders[key]


def decode_documents(encoded: DataFrame, tokenizer: str, ids_col: str = "ids") -> DataFrame:
    """encoded with decoded_text, the text of the ids in ids_col (null: empty)."""

    def make():
        bpe = vocabulary(tokenizer)
        return lambda rows: [[bpe.decode(r or []) for r in rows]]

    return append_columns(encoded, ids_col, [T.StructField("decoded_text", T.StringType())], make)
