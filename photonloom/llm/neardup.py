"""Near-duplicates by chosen paths.

Documents with one and the same set of shingles form a class, which takes part
once. In each of independent trees a class starts in the node of one of its
minwise tokens; nodes of more than a given size branch on, each class into the
children of one or two further tokens, which no other node's place in any tree
uses, so that the classes of a small
node agree in all tokens of its path. Small nodes are compared exhaustively on
sketches of 64 bytes. What is still large at the greatest depth is dealt into
chunks first, which join what is much alike; then all its pairs that are still
apart meet in tiles of bounded size, on sketches too. Of the pairs whose
sketches may reach the threshold each node, chunk or tile gives a spanning
forest, which is confirmed on the full sets; so the classes that may
be linked at all lie in the components of the forests, and those linked for
sure in the components of the confirmed pairs. What is left are pairs within
the former and across the latter: they are compared exactly, set by set, in
tiles of bounded size that give back nothing but further links.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .components import connected_components

SKETCH = 64
TREES = 16
#: A text's copies meet the name of their component in so many tasks.
SALTS = 64


def shingles_of(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of all windows of width words of text (of all its words, if there are fewer)."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(len(h) - width + 1, 1)
    k = min(width, len(h))
    out = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        out = _mixed(out ^ h[j : j + n])
    return np.unique(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits (the finisher of splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def token_count(max_depth: int) -> int:
    """Tokens of all trees: one for each place of a binary tree of max_depth levels."""
    return TREES * (2**max_depth - 1)


def minwise(shingles: np.ndarray, n: int = SKETCH) -> np.ndarray:
    """n minwise hashes of a set that isn't empty."""
    seeds = _mixed(np.arange(1, 2 * n + 1, dtype=np.uint64))
    xor, odd = seeds[:n, None], seeds[n:, None] | np.uint64(1)
    least = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), 1024):
        x = (shingles[None, i : i + 1024] ^ xor) * odd
        x ^= x >> np.uint64(32)
        least = np.minimum(least, x.min(axis=1))
    return least


def sketches(docs: DataFrame, width: int, max_depth: int, id_col: str, text_col: str) -> DataFrame:
    """Per document: doc_id, n_shingles, digest of the set, tokens (32 bits of a minwise hash for each place in a tree, level by level), sketch (a byte of each of 64 minwise hashes)."""
    schema = "doc_id long, n_shingles long, digest binary, tokens array<int>, sketch binary"
    n_tokens = token_count(max_depth)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                n, digest, tokens, sketch = [], [], [], []
                for text in part.column(1):
                    s = shingles_of(text.as_py(), width)
                    n.append(len(s))
                    if len(s):
                        m = _mixed(minwise(s, max(SKETCH, n_tokens)))
                        digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                        tokens.append(m[:n_tokens].astype(np.uint32).view(np.int32))
                        sketch.append((m[:SKETCH] >> np.uint64(56)).astype(np.uint8).tobytes())
                    else:
                        digest.append(None), tokens.append(None), sketch.append(None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(tokens, pa.list_(pa.int32())), pa.array(sketch, pa.binary())], names=["doc_id", "n_shingles", "digest", "tokens", "sketch"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def full_sets(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                sets = [shingles_of(t.as_py(), width).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["rep", "shingles"])

    return docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text")).mapInArrow(run, "rep long, shingles array<long>")


def leaves(classes: DataFrame, node_size: int, max_depth: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(node, rep) of the small nodes of all trees with two classes or more, and (node, rep, size) of those still large at max_depth.

    A node at place p of a level (the tree's number, at first) has its children
    at places 2 p and 2 p + 1 of the next, each of which has a token to itself.
    """
    rows = classes.select(F.posexplode(F.slice("tokens", 1, TREES)).alias("place", "token"), "rep").select(F.xxhash64("place", "token").alias("node"), "place", "rep")
    small = None
    for depth in range(max_depth):
        if depth:  # the first level is but a projection of the classes
            rows = staged(rows, "nodes", compact=True)
        sizes = staged(rows.groupBy("node").agg(F.count("*").alias("size")).where("size > 1"), "sizes", compact=True)
        few = rows.select("node", "rep").join(sizes.where(F.col("size") <= node_size), "node", "left_semi")
        small = few if small is None else small.unionByName(few)
        large = sizes.where(F.col("size") > node_size)
        if depth == max_depth - 1 or large.isEmpty():
            return small, rows.select("node", "rep").join(large, "node")
        # one child or two: 1 / threshold of them on the whole, so that a pair at the threshold keeps one
        both = F.pmod(F.xxhash64("node", F.lit(2)), F.lit(1000)) < round(1000 * (1 / threshold - 1))
        inner = rows.join(large.select("node"), "node", "left_semi").join(classes.select("rep", "tokens"), "rep")
        inner = inner.select("node", "rep", "tokens", F.explode(F.when(both, F.array(2 * F.col("place"), 2 * F.col("place") + 1)).otherwise(F.array(2 * F.col("place")))).alias("place"))
        token = F.get("tokens", F.col("place") + F.lit(token_count(depth + 1)))
        rows = inner.select(F.xxhash64("node", "place", token).alias("node"), "place", "rep")
    raise ValueError("max_depth is at least 1")


def by_group(rows: DataFrame, key: str, schema: str, work) -> DataFrame:
    """work(columns of one group) over the groups of key, batch by batch; a group is held as a whole, so it has to be bounded."""
    names = [c for c in rows.columns if c != key]

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            ids = held.column(key).to_numpy()
            last = int(np.searchsorted(ids, ids[-1]))  # the last group may go on
            if last:
                yield from groups(held.slice(0, last), ids[:last])
                held = held.slice(last)
        if held is not None:
            yield from groups(held, held.column(key).to_numpy())

    def groups(t, ids):
        cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
        t = t.select(names).combine_chunks()
        a, b = [], []
        for lo, hi in zip(cuts, cuts[1:]):
            if hi - lo > 1:
                for x, y in work(t.slice(lo, hi - lo)):
                    a.append(x), b.append(y)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], names=["a", "b"])

    return rows.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def forest(pairs: list[tuple[int, int]], n: int) -> list[int]:
    """The places of the pairs that join what those before them left apart."""
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    keep = []
    for k, (x, y) in enumerate(pairs):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep.append(k)
    return keep


def candidates(members: DataFrame, least_equal: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b), a < b, of members(node, rep, n_shingles, sketch): a forest of each node's most alike pairs that may reach the threshold.

    Sets whose sizes rule the threshold out and sketches with fewer than
    least_equal equal bytes make no pair.
    """

    def work(t):
        rep, size = t.column("rep").to_numpy(), t.column("n_shingles").to_numpy()
        order = np.argsort(rep, kind="stable")
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, SKETCH)[order]
        rep, size = rep[order], size[order]
        found = []
        for i in range(len(rep) - 1):
            equal = (sketch[i + 1 :] == sketch[i]).sum(axis=1)
            j = np.flatnonzero((equal >= least_equal) & (den * np.minimum(size[i], size[i + 1 :]) >= num * np.maximum(size[i], size[i + 1 :])) & (rep[i + 1 :] != rep[i]))
            if len(j):
                found.append((np.full(len(j), i), j + i + 1, equal[j]))
        if not found:
            return
        a, b, equal = (np.concatenate(x) for x in zip(*found))
        best = np.lexsort((b, a, -equal))
        a, b = a[best], b[best]
        keep = forest(list(zip(a.tolist(), b.tolist())), len(rep))
        yield rep[a[keep]], rep[b[keep]]

    rows = members.select("node", "rep", "n_shingles", "sketch")
    return by_group(rows, "node", "a long, b long", work).distinct()


def tiles(reps: DataFrame, side: int) -> DataFrame:
    """reps(rep, coarse, fine) dealt into tiles: tile, rep, fine, left.

    Within a coarse component the classes outside its largest fine one (left)
    meet all classes of the component (right). Both sides are cut into parts
    of about side; a tile is a left part and a right part.
    """
    counts = reps.groupBy("coarse", "fine").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("coarse").agg(F.sum("n").alias("size"), F.max("n").alias("most"), F.max_by("fine", F.struct("n", "fine")).alias("main")).where("most < size")
    sizes = sizes.select("coarse", "main", F.ceil((F.col("size") - F.col("most")) / side).alias("p"), F.ceil(F.col("size") / side).alias("q"))
    d = reps.join(sizes, "coarse")
    part = lambda n, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(n))
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    left = d.where(F.col("fine") != F.col("main")).select("coarse", "rep", "fine", part("p", 1).alias("i"), F.explode(every("q")).alias("j"), F.lit(True).alias("left"))
    right = d.select("coarse", "rep", "fine", F.explode(every("p")).alias("i"), part("q", 2).alias("j"), F.lit(False).alias("left"))
    return left.unionByName(right).select(F.xxhash64("coarse", "i", "j").alias("tile"), "rep", "fine", "left")


def candidates_across(tiled: DataFrame, least_equal: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b), a < b, of a tile(tile, rep, fine, left, n_shingles, sketch), a left one and a right one of another component (fine), that may reach the threshold: a forest over the components."""

    def work(t):
        left = t.column("left").to_numpy(zero_copy_only=False)
        rep, fine, size = (t.column(c).to_numpy() for c in ("rep", "fine", "n_shingles"))
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, SKETCH)
        ls, rs = np.flatnonzero(left), np.flatnonzero(~left)
        right, sizes, others = sketch[rs], size[rs], fine[rs]
        found = []
        for i in ls:
            j = np.flatnonzero((den * np.minimum(size[i], sizes) >= num * np.maximum(size[i], sizes)) & (others != fine[i]))
            if len(j):
                j = j[(right[j] == sketch[i]).sum(axis=1) >= least_equal]
            if len(j):
                found.append((np.full(len(j), i), rs[j]))
        if not found:
            return
        a, b = (np.concatenate(x) for x in zip(*found))
        _, ends = np.unique(np.concatenate([fine[a], fine[b]]), return_inverse=True)
        keep = forest(list(zip(ends[: len(a)].tolist(), ends[len(a) :].tolist())), int(ends.max()) + 1)
        x, y = rep[a[keep]], rep[b[keep]]
        yield np.minimum(x, y), np.maximum(x, y)

    return by_group(tiled.select("tile", "rep", "fine", "left", "n_shingles", "sketch"), "tile", "a long, b long", work).distinct()


def exact_links(tiled: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of a tile(tile, rep, fine, left, shingles), a left one and a right one of another fine component, that reach the threshold."""

    def work(t):
        left = t.column("left").to_numpy(zero_copy_only=False)
        rep, fine = t.column("rep").to_numpy(), t.column("fine").to_numpy()
        sets = t.column("shingles").combine_chunks() if isinstance(t.column("shingles"), pa.ChunkedArray) else t.column("shingles")
        size = np.diff(sets.offsets.to_numpy())
        flat = sets.flatten().to_numpy()
        row = np.repeat(np.arange(len(size)), size)
        word, column = np.unique(flat, return_inverse=True)
        both = (np.bincount(column, weights=left[row], minlength=len(word)) > 0) & (np.bincount(column, weights=~left[row], minlength=len(word)) > 0)
        at = np.cumsum(both) - 1
        row, column = row[both[column]], at[column[both[column]]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        place = np.where(left, np.cumsum(left) - 1, np.cumsum(~left) - 1)
        ls, rs = np.flatnonzero(left), np.flatnonzero(~left)
        if not len(ls) or not len(rs):
            return
        common = np.zeros((len(ls), len(rs)), dtype=np.float32)  # exact for counts below 2^24
        for lo in range(0, int(both.sum()), 4096):
            a, b = np.searchsorted(column, [lo, lo + 4096])
            r, c, side = row[a:b], column[a:b] - lo, left[row[a:b]]
            x, y = np.zeros((len(ls), 4096), np.float32), np.zeros((len(rs), 4096), np.float32)
            x[place[r[side]], c[side]] = 1
            y[place[r[~side]], c[~side]] = 1
            common += x @ y.T
        common = common.astype(np.int64)
        union = size[ls][:, None] + size[rs][None, :] - common
        i, j = np.nonzero((den * common >= num * union) & (fine[ls][:, None] != fine[rs][None, :]))
        x, y = rep[ls[i]], rep[rs[j]]
        _, ends = np.unique(np.concatenate([fine[ls[i]], fine[rs[j]]]), return_inverse=True)
        keep = forest(list(zip(ends[: len(i)].tolist(), ends[len(i) :].tolist())), int(ends.max()) + 1 if len(ends) else 0)
        if keep:
            yield np.minimum(x, y)[keep], np.maximum(x, y)[keep]

    return by_group(tiled.select("tile", "rep", "fine", "left", "shingles"), "tile", "a long, b long", work).distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """pairs whose sets have den * intersection >= num * union."""
    x = pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("s")).hint("merge"), "a").join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("t")).hint("merge"), "b")
    common = F.size(F.array_intersect("s", "t"))
    return x.select("a", "b", common.alias("c"), (F.size("s") + F.size("t")).alias("n")).where(den * F.col("c") >= num * (F.col("n") - F.col("c"))).select("a", "b")


def contracted(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs of classes as pairs of their fine components; pairs within one go."""
    x = pairs.join(reps.select(F.col("rep").alias("a"), F.col("fine").alias("u")), "a").join(reps.select(F.col("rep").alias("b"), F.col("fine").alias("v")), "b")
    return x.where("u <> v").select(F.col("u").alias("a"), F.col("v").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, threshold: tuple[int, int] = (75, 100), node_size: int = 128, max_depth: int = 3, tile_side: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the least doc_id linked to it, directly or not), kept (doc_id = component_id).

    Texts are lower-cased in A-Z and cut at white space of ASCII. Documents
    without words are linked with nothing; so are rows with a null doc_id,
    whose component_id and kept are null. Repeated rows stay and share a
    component; of ids that tie none is preferred but the least. Texts may be of
    any length; an empty table gives no rows. A pair at the threshold shares a node at the depth of 3 with a
    chance of 0.52 in each of the 16 trees, which have no token in common, so all
    miss it with one of 1e-5 (a pair in small nodes with one of 1e-9), and its
    sketch falls short with one of 1e-6. All pairs of a node are compared.
    """
    num, den = threshold
    least_equal = round(SKETCH * max(0.0, num / den - 0.25))
    sketched = staged(sketches(docs, width, max_depth, id_col, text_col), "sketches")
    rows = sketched.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = staged(rows.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("tokens").alias("tokens"), F.any_value("sketch").alias("sketch")), "classes", compact=True)
    small, large = leaves(classes, node_size, max_depth, num / den)
    traits = classes.select("rep", "n_shingles", "sketch")
    large = staged(large, "large", compact=True)
    chunks = F.ceil(F.col("size") / node_size)
    own = F.pmod(F.xxhash64("rep", "node"), chunks)
    dealt = large.select("node", "rep", own.alias("chunk"))
    hubs = large.groupBy("node").agg(F.min("rep").alias("rep"), F.first("size").alias("size")).select("node", "rep", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("chunk"))
    chunked = dealt.unionByName(hubs).distinct().select(F.xxhash64("node", "chunk").alias("node"), "rep")
    members = small.unionByName(chunked).join(traits, "rep")
    first = staged(candidates(members, least_equal, num, den), "pairs", compact=True)
    # what is joined by now is compared exactly further down; the rest of a large node meets here, pair by pair
    joined = connected_components(first).withColumnsRenamed({"node": "rep", "component": "fine"})
    apart = large.select(F.col("node").alias("coarse"), "rep").join(joined, "rep", "left").select("coarse", "rep", F.coalesce("fine", "rep").alias("fine"))
    across = tiles(apart, 4 * tile_side).join(traits, "rep")
    first = first.unionByName(staged(candidates_across(across, least_equal, num, den), "pairs", compact=True)).distinct()
    first = staged(first, "pairs", compact=True)
    ends = first.select(F.col("a").alias("i")).unionByName(first.select(F.col("b").alias("i"))).distinct()
    # texts stream past tables of ids; one plan at every size
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("i IS NOT NULL").join(ends.hint("shuffle_hash"), "i", "left_semi")
    sets = staged(full_sets(texts, width, "i", "t").where(F.size("shingles") > 0).dropDuplicates(["rep"]), "sets")
    links = staged(confirmed(first, sets, num, den), "links", compact=True)
    fine = connected_components(links).withColumnsRenamed({"node": "rep", "component": "fine"})
    reps = ends.select(F.col("i").alias("rep")).join(fine, "rep", "left").select("rep", F.coalesce("fine", "rep").alias("fine"))
    reps = staged(reps, "groups", compact=True)
    coarse = connected_components(contracted(first, reps)).select(F.col("node").alias("fine"), F.col("component").alias("coarse"))
    dealt = tiles(reps.join(coarse, "fine").select("rep", "coarse", "fine"), tile_side)
    more = staged(exact_links(dealt.join(sets.hint("merge"), "rep"), num, den), "links", compact=True)
    whole = connected_components(contracted(more, reps)).withColumnsRenamed({"node": "fine", "component": "whole"})
    component = reps.join(whole, "fine", "left").select("rep", F.coalesce("whole", "fine").alias("component"))
    named = classes.select("digest", "rep").join(component, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    # texts without words stand apart, as there may be any number of them; a text's many copies are dealt over tasks by their ids
    rows = sketched.select("doc_id", "n_shingles", "digest")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    many = rows.where("digest IS NOT NULL").groupBy("digest", salt.alias("salt")).agg(F.count("*").alias("n"))
    keys = many.select("digest", "salt").join(named, "digest", "left").select("digest", "salt", "component")
    out = rows.where("digest IS NOT NULL").withColumn("salt", salt).join(keys, ["digest", "salt"], "left").select("doc_id", "n_shingles", "component")
    out = out.unionByName(rows.where("digest IS NULL").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component")))
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", found.alias("component_id"), (F.col("doc_id") == found).alias("kept"))
