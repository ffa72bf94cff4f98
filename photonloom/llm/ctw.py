"""Language-model scores by context-tree weighting.

A text is its words in lower case, one space between them and an end; each
byte of it is eight binary decisions. Every context of 0 to `depth` bytes has
a Krichevsky-Trofimov estimate for each of its decisions; a node's weighted
probability is the even mixture of its own estimate and of the product over
its children, so the mixture runs over all depths and all tree models. A context
that training doesn't have predicts what the longest part of it that training
has does. The
counts come from all training documents, gathered by aggregation; scoring uses
the trained mixture as it stands. The tree is dealt over tasks by the last two
bytes of context, as all deeper nodes stand below one of those; the driver has
no more than the nodes of one byte of context and none, whose number the
alphabet bounds. Beside it, a smoothed unigram score of words.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import most_frequent, staged

END = b"\n"  # stands in no word


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def grams_of(words: list[bytes], depth: int) -> np.ndarray:
    """For each byte of the text, it and the depth bytes before it (ends, before the first) in one number."""
    x = np.frombuffer(END * depth + b" ".join(words) + END, dtype=np.uint8).astype(np.uint64)
    n = len(x) - depth
    out = x[:n].copy()
    for j in range(1, depth + 1):
        out = (out << np.uint64(8)) | x[j : j + n]
    return out


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma of positive numbers, by Stirling's series after eight steps upwards."""
    x = np.asarray(x, dtype=np.float64)
    low = np.zeros_like(x)
    for k in range(8):
        low += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - low


def by_depth(grams: np.ndarray, counts: np.ndarray, depth: int, floor: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted grams and their counts, then those of ever shorter contexts, down to floor bytes."""
    pairs = [(grams, counts)]
    for d in range(depth - 1, floor - 1, -1):
        k, at = np.unique(pairs[-1][0] & np.uint64((1 << 8 * (d + 1)) - 1), return_inverse=True)
        pairs.append((k, np.bincount(at, weights=pairs[-1][1], minlength=len(k))))
    return pairs


def estimate_of(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1) - math.log(math.pi)


def nodes_of(pairs: list, bit: int, depth: int) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
    """The nodes that decide a bit, (keys, one, own) by depth from the least of pairs on, and ln of the weighted probability and the counts of 0 and 1 of those of the least depth."""
    out: list[tuple] = []
    above = None
    for d, (pair, n) in zip(range(depth, -1, -1), pairs):
        byte = pair & np.uint64(255)
        node = (pair & ~np.uint64(255)) | np.uint64(1 << bit) | (byte >> np.uint64(8 - bit))
        first = np.flatnonzero(np.diff(node, prepend=~node[:1])) if len(node) else np.zeros(0, np.int64)
        value = ((byte >> np.uint64(7 - bit)) & np.uint64(1)).astype(np.float64)
        keys = node[first]
        n1 = np.add.reduceat(n * value, first) if len(first) else n
        n0 = np.add.reduceat(n, first) - n1 if len(first) else n
        estimate = estimate_of(n0, n1)
        if above is None:
            weighted, share = estimate, np.ones(len(keys), dtype=np.float32)
        else:
            parent = np.searchsorted(keys, above[0] & np.uint64((1 << 8 * (d + 1)) - 1))
            children = np.bincount(parent, weights=above[1], minlength=len(keys))
            both = np.logaddexp(estimate, children)
            weighted, share = both - math.log(2), np.exp(estimate - both).astype(np.float32)
        above = (keys, weighted)
        out.insert(0, (keys, ((n1 + 0.5) / (n0 + n1 + 1)).astype(np.float32), share))
    return out, above[1], n0, n1


def mixed(p: np.ndarray, nodes: list[tuple], least: int, grams: np.ndarray, bit: int) -> np.ndarray:
    """p, the probability of a 1 by deeper nodes (NaN where there is none), after the nodes (keys, one, own) of depths from least on."""
    context, prefix = grams >> np.uint64(8), np.uint64(1 << bit) | ((grams & np.uint64(255)) >> np.uint64(8 - bit))
    for d in range(least + len(nodes) - 1, least - 1, -1):
        keys, one, own = nodes[d - least]
        if not len(keys):
            continue
        node = ((context & np.uint64((1 << 8 * d) - 1)) << np.uint64(8)) | prefix
        at = np.minimum(np.searchsorted(keys, node), len(keys) - 1)
        below = np.where(np.isnan(p), one[at], own[at] * one[at] + (1 - own[at]) * p)
        p = np.where(keys[at] == node, below, p)
    return p


def log10_of_bit(p: np.ndarray, grams: np.ndarray, bit: int) -> np.ndarray:
    """log10 of the probability of the grams' bits, p being that of a 1 (NaN: even)."""
    p = np.where(np.isnan(p), 0.5, p)
    return np.log10(np.where(((grams >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool), p, 1 - p))


@dataclass(frozen=True)
class ContextTree:
    """Nodes by the number of bits decided, then by depth of context, each sorted by its key: context << 8 | bits so far after a leading 1."""

    depth: int
    keys: list[list[np.ndarray]]
    one: list[list[np.ndarray]]  # the estimate that the decision is 1
    own: list[list[np.ndarray]]  # the posterior weight of the node's own estimate against its children

    @staticmethod
    def of(grams: np.ndarray, counts: np.ndarray, depth: int) -> ContextTree:
        """From sorted grams and their counts; a node's children decide the same bit, so the eight bits go one after the other."""
        pairs = by_depth(grams, counts, depth)
        bits = [nodes_of(pairs, bit, depth)[0] for bit in range(8)]
        return ContextTree(depth, *([[nodes[k] for nodes in b] for b in bits] for k in range(3)))

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's last byte after the others."""
        if len(grams) > 250_000:
            return np.concatenate([self.log10(x) for x in np.array_split(grams, len(grams) // 250_000 + 1)])
        total = np.zeros(len(grams))
        for bit in range(8):
            p = mixed(np.full(len(grams), np.nan), list(zip(self.keys[bit], self.one[bit], self.own[bit])), 0, grams, bit)
            total += log10_of_bit(p, grams, bit)
        return total


class GramTable:
    """The values of known grams in a table with open addressing, at most two thirds full."""

    def __init__(self, grams: np.ndarray, values: np.ndarray):
        bits = max(4, int(1.5 * len(grams)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.keys = np.full(1 << bits, np.iinfo(np.uint64).max, dtype=np.uint64)  # no gram of up to seven bytes
        self.values = np.zeros(1 << bits, dtype=np.float32)
        at, left = self.slots(grams), np.arange(len(grams))
        while len(left):
            free = self.keys[at] == np.iinfo(np.uint64).max
            one, which = np.unique(at[free], return_index=True)
            placed = np.flatnonzero(free)[which]
            self.keys[one], self.values[one] = grams[left[placed]], values[left[placed]]
            rest = np.ones(len(left), dtype=bool)
            rest[placed] = False
            left, at = left[rest], (at[rest] + np.uint64(1)) & self.mask

    def slots(self, grams: np.ndarray) -> np.ndarray:
        return (grams * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def look_up(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values, and the places of the grams that aren't in the table."""
        at = self.slots(grams)
        key = self.keys[at]
        out = self.values[at].astype(np.float64)
        left = np.flatnonzero(key != grams)
        missing = []
        while len(left):
            gone = key[left] == np.iinfo(np.uint64).max
            missing.append(left[gone])
            left = left[~gone]
            at[left] = (at[left] + np.uint64(1)) & self.mask
            key[left] = self.keys[at[left]]
            out[left] = self.values[at[left]]
            left = left[key[left] != grams[left]]
        return out, np.concatenate(missing) if missing else left


_prepared: dict = {}


def prepared(model: TextModel) -> tuple[dict[bytes, float], GramTable]:
    """What tasks derive from a model, once in each worker."""
    if id(model) not in _prepared:
        _prepared.clear()
        _prepared[id(model)] = (model, {w: model.word_log10(n) for w, n in model.frequent.items()}, GramTable(model.grams, model.gram_log10))
    return _prepared[id(model)][1:]


def folded(k: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of k, sorted, and the sums of their n."""
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(n, first) if len(first) else n


def gather(docs: DataFrame, learn: Column, depth: int, text_col: str, held_words: int = 250_000, held_grams: int = 2_000_000) -> DataFrame:
    """(kind, word, gram, n): counts in training rows of words and ends (kind 0) and of the byte grams of all rows (kind 1; 0 for those that training doesn't have)."""
    names = ["kind", "word", "gram", "n"]

    def run(batches):
        words: Counter = Counter()
        held = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        taught: list[np.ndarray] = []
        other: list[np.ndarray] = []
        size = 0

        def fold():
            nonlocal held, size
            parts = [held]
            for arrays, weight in ((taught, 1), (other, 0)):
                if arrays:
                    k, n = np.unique(np.concatenate(arrays), return_counts=True)
                    parts.append((k, n * weight))
                    arrays.clear()
            held, size = folded(*map(np.concatenate, zip(*parts))), 0

        def words_out():
            out = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(words), np.int32)), pa.array(list(words), pa.binary()), pa.nulls(len(words), pa.int64()), pa.array(list(words.values()), pa.int64())], names=names)
            words.clear()
            return out

        def grams_out():
            nonlocal held
            (k, n), held = held, (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            for lo in range(0, len(k), 100_000):
                part = k[lo : lo + 100_000].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(part), np.int32)), pa.nulls(len(part), pa.binary()), pa.array(part), pa.array(n[lo : lo + 100_000])], names=names)

        for batch in batches:
            for text, known in zip(batch.column(0), batch.column(1).to_pylist()):
                ws = words_of(text.as_py())
                if known:
                    words.update(ws)
                    words[END] += 1
                grams = grams_of(ws, depth)
                (taught if known else other).append(grams)
                size += len(grams)
                if size > 1_500_000:  # bytes whose grams are held as such
                    fold()
                    if len(held[0]) > held_grams:
                        yield from grams_out()
                if len(words) > held_words:
                    yield words_out()
        fold()
        yield from grams_out()
        if words:
            yield words_out()

    rows = docs.select(F.col(text_col).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn")).mapInArrow(run, "kind int, word binary, gram long, n long")
    # a key comes a few times from each task, so there is nothing to sum up before the shuffle and no hot key after it
    return rows.repartition("word", "gram").groupBy("kind", "word", "gram").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class TextModel:
    depth: int
    top: list[list[tuple]]  # by bit, the nodes (keys, one, own) of depths below two
    counts: DataFrame | None  # (gram, n) of training, all of them; not sent to tasks
    values: DataFrame | None  # (gram, log10) of all rows that fit() saw; likewise
    grams: np.ndarray  # the most frequent of them
    gram_log10: np.ndarray
    frequent: dict[bytes, int]
    tokens: int  # N
    distinct: int  # V

    def word_log10(self, count: int) -> float:
        return math.log10((count + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))


def by_context(rows: DataFrame, floor: int, schema: str, work, held_rows: int = 300_000) -> DataFrame:
    """work(grams, n), over rows (gram, n) dealt by the last floor bytes of context; those of one such context come together."""

    def run(batches):
        held, size, limit = [], 0, held_rows
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size > limit:
                t = pa.Table.from_batches(held)
                ids = t.column("key").to_numpy()
                last = int(np.searchsorted(ids, ids[-1]))  # the last context may go on
                if last:
                    yield work(t.column("gram").to_numpy()[:last].view(np.uint64), t.column("n").to_numpy()[:last])
                held, size = t.slice(last).combine_chunks().to_batches(), len(ids) - last
                limit = max(held_rows, 2 * size)
        if size:
            t = pa.Table.from_batches(held)
            yield work(t.column("gram").to_numpy().view(np.uint64), t.column("n").to_numpy())

    key = F.shiftrightunsigned("gram", 8).bitwiseAND(F.lit((1 << 8 * floor) - 1).cast("long"))
    return rows.select(key.alias("key"), "gram", "n").repartition("key").sortWithinPartitions("key").mapInArrow(run, schema)


def trained(grams: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The grams of training among rows of by_context, sorted, and their counts; n is 0 in those that are asked for."""
    at = np.flatnonzero(n > 0)
    at = at[np.argsort(grams[at])]
    return grams[at], n[at].astype(np.float64)


def top_nodes(counts: DataFrame, depth: int) -> list[list[tuple]]:
    """By bit, the nodes (keys, one, own) of depths below min(depth, 2), from counts(gram, n): their children are weighted in tasks and summed by aggregation."""
    floor = min(depth, 2)
    if not floor:
        return [[] for _ in range(8)]

    def work(grams, n):
        pairs = by_depth(*trained(grams, n), depth, floor)
        bits, columns = [], []
        for bit in range(8):
            nodes, *values = nodes_of(pairs, bit, depth)
            columns.append([nodes[0][0] & np.uint64((1 << 8 * floor) - 1), *values])
            bits.append(np.full(len(nodes[0][0]), bit, dtype=np.int32))
        node, *values = (np.concatenate(c) for c in zip(*columns))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(bits)), pa.array(node.view(np.int64)), *map(pa.array, values)], names=["bit", "node", "w", "n0", "n1"])

    below = by_context(counts, floor, "bit int, node long, w double, n0 double, n1 double", work)
    t = below.groupBy("bit", "node").agg(F.sum("w").alias("w"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()  # 256 contexts of 255 nodes at most
    bit_of, node, w, n0, n1 = (t.column(c).to_numpy() for c in ("bit", "node", "w", "n0", "n1"))
    out: list[list[tuple]] = []
    for bit in range(8):
        at = np.flatnonzero(bit_of == bit)
        at = at[np.argsort(node[at])]
        keys, children, zeros, ones = node[at].view(np.uint64), w[at], n0[at], n1[at]
        nodes: list[tuple] = []
        for d in range(floor - 1, -1, -1):
            estimate = estimate_of(zeros, ones)
            both = np.logaddexp(estimate, children)
            nodes.insert(0, (keys, ((ones + 0.5) / (zeros + ones + 1)).astype(np.float32), np.exp(estimate - both).astype(np.float32)))
            if d:
                keys, parent = np.unique(keys & np.uint64((1 << 8 * d) - 1), return_inverse=True)
                children, zeros, ones = (np.bincount(parent, weights=x, minlength=len(keys)) for x in (both - math.log(2), zeros, ones))
        out.append(nodes)
    return out


def gram_values(rows: DataFrame, top: list[list[tuple]], depth: int) -> DataFrame:
    """(gram, n, log10): the log10 probability of the last byte of each gram after the others, by the whole tree of rows(gram, n); grams with n = 0 are but asked for."""
    floor = min(depth, 2)
    shared = rows.sparkSession.sparkContext.broadcast(top)

    def work(grams, n):
        total = np.zeros(len(grams))
        pairs = by_depth(*trained(grams, n), depth, floor)
        for bit in range(8):
            p = mixed(np.full(len(grams), np.nan), nodes_of(pairs, bit, depth)[0], floor, grams, bit)
            p = mixed(p, shared.value[bit], 0, grams, bit)
            total += log10_of_bit(p, grams, bit)
        return pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n), pa.array(total)], names=["gram", "n", "log10"])

    return by_context(rows, floor, "gram long, n long, log10 double", work)


def fit(docs: DataFrame, learn: Column, depth: int = 6, frequent: int = 65_536, max_grams: int = 2_000_000, text_col: str = "text") -> tuple[TextModel, DataFrame]:
    """The model of the rows for which learn holds, and (word, n), the counts of all its words.

    Tasks hold the frequent most frequent words and the max_grams most frequent
    byte grams with their values (documented bounds); all others are joined
    when documents are scored, so that no score depends on the bounds. The
    grams of rows that teach nothing are valued on the way.
    """
    counts = staged(gather(docs, learn, depth, text_col), "counts")
    words = counts.where("kind = 0").select("word", "n")
    total = words.agg(F.sum("n"), F.count("*")).first()
    top = {bytes(r.word): r.n for r in most_frequent(words, frequent).collect()}
    grams = counts.where("kind = 1").select("gram", "n")
    upper = top_nodes(grams, depth)
    values = staged(gram_values(grams, upper, depth), "values")
    table = most_frequent(values.where("n > 0"), max_grams).select("gram", "log10").toArrow()
    g, v = table.column("gram").to_numpy().view(np.uint64), table.column("log10").to_numpy().astype(np.float32)
    order = np.argsort(g)
    return TextModel(depth, upper, grams.where("n > 0"), values.select("gram", "log10"), g[order], v[order], top, int(total[0] or 0), int(total[1])), words


def score_documents(docs: DataFrame, model: TextModel, words: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_chars, n_tokens, n_known, base_score, score and bits_per_byte, over whole texts.

    A null text is empty: an end alone. score is the tree's log10 probability,
    base_score the unigram one. Rows stay as they are, repeated ones and ones
    with a null doc_id too; other columns are left out; an empty table gives no
    rows. Texts may be of any length. Words or grams that tie in frequency at a
    bound's edge are joined, which changes no score. Frequent words are
    counted on the spot, all others by a join with the counts of all words;
    likewise the byte grams, all others by a join with the tree.
    """
    shared = docs.sparkSession.sparkContext.broadcast(replace(model, counts=None, values=None))  # bounded by fit()
    schema = "row long, doc_id long, n_chars long, n_tokens long, n_known long, base double, held double, n_bytes long, rare array<binary>, rare_grams array<long>, rare_n array<long>"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        m = shared.value
        value, table = prepared(m)
        row = TaskContext.get().partitionId() << 36
        depth = m.depth

        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows, pieces = [], []

                def settle():
                    g = [x for _, x in pieces]
                    every = np.concatenate(g)
                    out, new = table.look_up(every)
                    new = np.sort(new)
                    out[new] = 0.0
                    starts = np.cumsum([0, *map(len, g)])
                    sums = np.add.reduceat(out, starts[:-1])
                    cuts = np.searchsorted(new, starts)
                    for j, (k, x) in enumerate(pieces):
                        rare, n = np.unique(every[new[cuts[j] : cuts[j + 1]]], return_counts=True)
                        rows[k][6:8] = float(sums[j]), len(x)
                        rows[k][9:11] = rare.view(np.int64), n
                    pieces.clear()

                size = 0
                for doc, text in zip(part.column(0).to_pylist(), part.column(1)):
                    text = text.as_py() or ""
                    ws = words_of(text)
                    values = list(map(value.get, [*ws, END]))
                    known = [v for v in values if v is not None]
                    rare = [w for w, v in zip([*ws, END], values) if v is None] if len(known) < len(values) else []
                    rows.append([row, doc, len(text), len(values), len(known), math.fsum(known), 0.0, 0, rare, None, None])
                    pieces.append((len(rows) - 1, grams_of(ws, depth)))
                    size += len(pieces[-1][1])
                    row += 1
                    if size > 400_000:
                        settle()
                        size = 0
                if pieces:
                    settle()
                columns = list(zip(*rows))
                types = [pa.int64()] * 5 + [pa.float64()] * 2 + [pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)

    scored = staged(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema), "scored")
    rare = scored.select("row", F.explode("rare").alias("word")).join(words, "word", "left")
    count = F.coalesce("n", F.lit(0))
    value = F.log10((count + 0.5) / F.lit(model.tokens + 0.5 * (model.distinct + 1)))
    rest = rare.groupBy("row").agg(F.sum(value).alias("rest"), F.count("n").alias("more"))
    grams = scored.select("row", F.explode(F.arrays_zip("rare_grams", "rare_n")).alias("g")).select("row", F.col("g.rare_grams").alias("gram"), F.col("g.rare_n").alias("k"))
    found = grams.join(model.values, "gram", "left").groupBy("row").agg(F.sum(F.col("k") * F.col("log10")).alias("deep"), F.collect_list(F.when(F.isnull("log10"), F.struct("gram", "k"))).alias("new"))
    deep = staged(found, "deep", compact=True)  # new: of one document
    new = deep.select("row", F.explode("new").alias("g")).select("row", F.col("g.gram").alias("gram"), F.col("g.k").alias("k"))
    if not new.isEmpty():  # documents that fit() hasn't seen
        asked = new.select("gram", F.lit(0).cast("long").alias("n")).distinct()
        values = staged(gram_values(model.counts.unionByName(asked), model.top, model.depth).where("n = 0"), "values", compact=True)
        deep = deep.select("row", "deep").unionByName(new.join(values, "gram").groupBy("row").agg(F.sum(F.col("k") * F.col("log10")).alias("deep"))).groupBy("row").agg(F.sum("deep").alias("deep"))
    deep = deep.select("row", "deep")
    out = scored.drop("rare", "rare_grams", "rare_n").join(rest, "row", "left").join(deep, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    score = F.col("held") + zero("deep")
    return out.select("doc_id", "n_chars", "n_tokens", (F.col("n_known") + zero("more")).alias("n_known"), (F.col("base") + zero("rest")).alias("base_score"), score.alias("score"), (-score / math.log10(2) / F.col("n_bytes")).alias("bits_per_byte"))
