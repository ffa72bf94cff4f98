"""Cost-balanced packing of tokenised documents into sequences of bounded length.

A piece's cost is linear * n + quadratic * n * n (projections and attention
within the piece). Each task works through its own rows in blocks: what fills
whole sequences goes out at once, the rest of a block is placed in descending
length, each piece in the sequence of least cost that still has room. The
capacities of a block are chosen to add up to its tokens exactly: whole
sequences, then one sequence for each power of two in what is left over, so
that cutting only what fits nowhere leaves no padding at all. No shuffle, and
memory is bounded by a block plus one document.
"""

from __future__ import annotations

import functools
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: The published splitting pattern of byte-level BPE (fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts of these characters alone are split alike by every Unicode version; all others go through the tokenizers library.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-ɏ–—‘’“”…]*")


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        out.append(chr(b) if b in plain else chr(spare))
        spare += b not in plain
    return out


class ByteLevelEncoder:
    """Ids as the tokenizers library gives them without its added special tokens: tiktoken's engine on the same vocabulary where both split alike, else the library itself."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {c: b for b, c in enumerate(byte_alphabet())}
        self.special = [x["content"] for x in spec["added_tokens"]]
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.fast = tiktoken.Encoding("photonloom", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return np.array(self.fast.encode_ordinary(text), dtype="<u4")
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")


@functools.lru_cache(2)
def encoder(path: str) -> ByteLevelEncoder:
    return ByteLevelEncoder(path)


def place(lengths: list[int], capacities: list[int], linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(index, begin, end, sequence, offset) of pieces, for lengths in descending order whose sum is that of the capacities."""
    room, used, cost = np.array(capacities, dtype=np.int64), np.zeros(len(capacities), dtype=np.int64), np.zeros(len(capacities))
    out = []
    for k, n in enumerate(lengths):
        begin = 0
        while begin < n:
            left = n - begin
            fits = room >= left
            if fits.any():
                j, take = int(np.argmin(np.where(fits, cost, np.inf))), left
            else:  # it fits nowhere: fill the roomiest sequence, which cuts it least
                j = int(np.argmax(room))
                take = int(room[j])
            out.append((k, begin, begin + take, j, int(used[j])))
            room[j] -= take
            used[j] += take
            cost[j] += linear * take + quadratic * take * take
            begin += take
    return out


FIELDS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()),
    T.StructField("offset", T.LongType()), T.StructField("cost", T.DoubleType()),
])
IDS = T.StructField("ids", T.ArrayType(T.IntegerType(), False))


def pack_documents(docs: DataFrame, tokenizer: str, max_tokens: int = 1024, end_id: int = 0, linear: float = 1.0, quadratic: float = 1 / 1024, block_docs: int = 512, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, cost and, with_ids, the ids.

    A document's ids are those of its whole text and then end_id; a null or
    empty text has end_id alone. Equal and repeated rows are packed as often as
    they occur; a null doc_id stays null; other columns are left out; an empty
    table gives no rows. Sequences carry the number of their task in the upper
    bits of sequence_id, so a repeated task gives the same numbers.
    """
    schema = T.StructType([*FIELDS.fields, *([IDS] if with_ids else [])])
    arrow = to_arrow_schema(schema)

    def run(batches):
        encode, base = encoder(tokenizer), TaskContext.get().partitionId() << 36
        count = 0
        rows: list[tuple] = []
        rest: list[tuple] = []

        def put(doc, start, ids, total, sequence, offset):
            n = len(ids)
            row = (doc, start, n, zlib.crc32(ids.tobytes()), total, base + sequence, offset, linear * n + quadratic * n * n)
            rows.append((*row, ids.astype(np.int32)) if with_ids else row)

        def flush():
            nonlocal count, rest
            rest.sort(key=lambda x: (-len(x[2]), x[0] is None, x[0] or 0, x[1]))
            whole, left = divmod(sum(len(x[2]) for x in rest), max_tokens)
            capacities = [max_tokens] * whole + [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]
            for k, begin, end, j, offset in place([len(x[2]) for x in rest], capacities, linear, quadratic):
                doc, start, ids, total = rest[k]
                put(doc, start + begin, ids[begin:end], total, count + j, offset)
            count += len(capacities)
            rest = []

        def out():
            columns = list(zip(*rows)) if rows else [[] for _ in arrow]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                total, full = len(ids), len(ids) // max_tokens * max_tokens
                for start in range(0, full, max_tokens):
                    put(doc, start, ids[start : start + max_tokens], total, count, 0)
                    count += 1
                if full < total:
                    rest.append((doc, full, ids[full:].copy(), total))
                if len(rest) >= block_docs:
                    flush()
                if len(rows) >= 4096:
                    yield out()
        flush()
        if rows:
            yield out()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
