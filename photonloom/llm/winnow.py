"""Document fingerprints by winnowing, in DataFrame functions alone.

Every k bytes in a row of a text (in UTF-8) have a hash, at each position. Of
every w hashes in a row the least is chosen, the rightmost of equal ones, with
its position. Any passage of w + k - 1 bytes that two texts share therefore
gives both one same choice, wherever it begins and whether or not there is
white space in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let

K, DOUBLINGS = 24, 6
#: A choice is its position, then so many bits of hash; positions reach as far as a text can.
HASH_BITS = 32
#: Windows whose choices are made at once; a longer text is gone through piece by piece.
SPAN = 1 << 14
_HASH, _PLACE = (1 << HASH_BITS) - 1, (1 << 63 - HASH_BITS) - 1


def choices(data: Column, k: int = K, doublings: int = DOUBLINGS, span: int = SPAN) -> Column:
    """The chosen (position, hash) pairs of bytes in order, packed as position * 2^HASH_BITS + hash.

    The window is w = 2^doublings hashes. Data of fewer than k bytes has the
    hash of all of it; with fewer than w hashes, the least of them; empty data
    has none. Data of any length: pieces of span windows share the bytes that
    both need, so what is at hand at once doesn't grow with the data. Work in
    between is packed as the hash's complement, then the position, so that the
    greatest number of a window is its least hash, the rightmost of equal ones.
    """
    w = 1 << doublings

    def grams(b):
        at = F.sequence(F.lit(1), F.greatest(F.length(b) - k + 1, F.lit(1)))
        high = lambda i: F.bitwise_not(F.shiftrightunsigned(F.xxhash64(F.substring(b, i, F.lit(k))), 1)).bitwiseAND(F.lit(_HASH << 63 - HASH_BITS))
        return F.transform(at, lambda i: high(i).bitwiseOR(i.cast("long")))

    def halving(shift):  # beyond the end there is nothing, which greatest() passes over
        return lambda p: F.zip_with(p, F.slice(p, F.lit(shift + 1), F.greatest(F.size(p) - shift, F.lit(0))), lambda x, y: F.greatest(x, y))

    def whole(p):  # windows that end within the data; the first one, if there is none
        best = p
        for step in range(doublings):
            best = let(best, halving(1 << step))
        return F.slice(best, F.lit(1), F.greatest(F.size(p) - w + 1, F.lit(1)))

    def piece(b, begin):  # positions count from 1 within a piece
        at = lambda x: F.shiftleft(x.bitwiseAND(F.lit(_PLACE)) - 1 + begin, HASH_BITS)
        part = F.substring(b, (begin + 1).cast("int"), F.lit(span + w + k - 2))
        packed = F.array_distinct(let(let(part, grams), whole))
        return F.transform(packed, lambda x: at(x).bitwiseOR(F.bitwise_not(F.shiftright(x, 63 - HASH_BITS)).bitwiseAND(F.lit(_HASH))))

    begins = lambda b: F.sequence(F.lit(0).cast("long"), F.greatest(F.length(b) - (w + k - 1), F.lit(0)).cast("long"), F.lit(span).cast("long"))
    every = let(data, lambda b: F.array_distinct(F.flatten(F.transform(begins(b), lambda begin: piece(b, begin)))))
    return F.when(F.length(data) > 0, every).otherwise(F.array().cast("array<long>"))


def add_fingerprint(df: DataFrame, text_col: str, out: str, k: int = K, doublings: int = DOUBLINGS) -> DataFrame:
    """df with the column out: the choices of the whole text; null and empty texts have none."""
    return df.withColumn(out, choices(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), k, doublings))


def hashes(packed: Column) -> Column:
    return F.transform(packed, lambda x: x.bitwiseAND(F.lit(_HASH)))


def as_text(packed: Column) -> Column:
    """The pairs as text: hash in hexadecimal, '@', position."""
    return F.array_join(F.transform(packed, lambda x: F.concat(F.hex(x.bitwiseAND(F.lit(_HASH))), F.lit("@"), F.shiftright(x, HASH_BITS).cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """The share of hashes in common of all hashes in either; 1 for two fingerprints without any."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def with_next(docs: DataFrame, columns: list[str], id_col: str = "doc_id", rows_per_group: int = 2048, max_groups: int = 32_768) -> DataFrame:
    """docs with next_<column> for each of columns, from the document that follows in descending order of id_col; after the last comes the first.

    The rows are dealt into groups of neighbouring ids by quantiles of the ids,
    each group is ordered for itself, and a group's last row gets the first row
    of the group below. There is a group for each rows_per_group rows; beyond
    max_groups of them (the driver has one number for each) groups grow, which
    are ordered with spills. Rows of one id stand in order of their columns'
    hash. Null ids come last; as there may be any number of them, they have
    groups of their own, by ranges of that hash.
    """
    spark = docs.sparkSession
    sizes = docs.agg(F.count(id_col), F.count("*") - F.count(id_col)).first()
    n, n_null = (max(1, min(max_groups, rows // rows_per_group)) for rows in sizes)
    cuts = docs.agg(F.percentile_approx(id_col, [i / n for i in range(1, n)], max(10_000, 10 * n))).first()[0] if n > 1 else []
    bounds = sorted({int(x) for x in cuts or []})
    step = max(64, int(len(bounds) ** 0.5))
    number = lambda values, x: F.size(F.filter(values, lambda b: b < x))
    i = F.col(id_col).cast("long")
    group = F.lit(0)
    if bounds:
        coarse = number(F.lit(bounds[step - 1 :: step]).cast("array<long>"), i) * step
        group = coarse + number(F.slice(F.lit(bounds).cast("array<long>"), coarse + 1, step), i)
    share = F.shiftright(F.xxhash64(*columns), 32) + F.lit(1 << 31)  # in the order of the hash, from 0 to 2^32
    group = F.when(i.isNull(), -1 - F.shiftright(share * F.lit(n_null), 32)).otherwise(group).cast("int")
    df = docs.withColumn("__g", group).withColumn("__o", F.xxhash64(*columns))
    order = Window.partitionBy("__g").orderBy(F.desc_nulls_last(id_col), "__o")
    heads = docs.select(group.alias("g"), i.alias("i")).groupBy("g").agg(F.max("i").alias("i")).collect()
    groups = sorted((r.g for r in heads), reverse=True)
    above = {b: g for g, b in zip(groups, groups[1:] + groups[:1])}  # the group that comes before, in descending order
    tops = spark.createDataFrame([(r.g, r.i, above[r.g]) for r in heads], "__g int, __top long, __above int")
    known = [r.i for r in heads if r.i is not None]
    chosen = df.where(F.col(id_col).isin(known) | F.col(id_col).isNull()) if known else df
    first = chosen.join(F.broadcast(tops), "__g").where(F.col(id_col).cast("long").eqNullSafe(F.col("__top")))  # max_groups rows of three numbers at most
    # rows that tie for the first place: the one with the least hash, without ordering them
    first = first.groupBy(F.col("__above").alias("__g")).agg(*[F.min_by(F.struct(*columns), "__o").alias("__first")])
    out = df.withColumns({"__more": F.lead(F.lit(1)).over(order), **{f"__lead_{c}": F.lead(c).over(order) for c in columns}})
    out = out.join(first, "__g", "left")
    out = out.withColumns({f"next_{c}": F.when(F.col("__more").isNotNull(), F.col(f"__lead_{c}")).otherwise(F.col(f"__first.{c}")) for c in columns})
    return out.drop("__g", "__o", "__more", "__first", *[f"__lead_{c}" for c in columns])


def fingerprint_with_edits(docs: DataFrame, k: int = K, doublings: int = DOUBLINGS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_chars, edited (the last third replaced by as much of the next document's beginning), the packed fingerprints of text, edited and the next document.

    Whole texts, null ones as empty. Other columns are left out; repeated rows
    stay, and stand next to each other; an empty table gives no rows. The edited
    text is put together from pieces of two texts whose choices are known, and
    so are its choices: a choice depends on its window alone, so only windows
    near the seam and near the end are looked at again.
    """
    w = 1 << doublings
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    df = with_next(add_fingerprint(base, "text", "prints", k, doublings), ["text", "prints"])
    third = F.floor(F.length("text") / 3).cast("int")
    df = df.withColumns({"__a": F.substring(F.col("text"), F.lit(1), F.length("text") - third), "__b": F.substring(F.col("next_text"), F.lit(1), third)})
    df = df.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.concat("__a", "__b").alias("edited"), F.octet_length("__a").alias("__m"), F.octet_length("__b").alias("__t"), "prints", "next_prints")

    def piece(begin, end):  # the choices of the edited text's bytes from begin to end, with their places in it
        part = F.substring(F.col("edited").cast("binary"), begin + 1, end - begin)
        return F.transform(choices(part, k, doublings), lambda x: x + F.shiftleft(begin.cast("long"), HASH_BITS))

    def kept(prints, length, offset):  # choices of the first length bytes that don't depend on what follows
        last = F.shiftleft((length - (k - 1) - w + 1).cast("long"), HASH_BITS)
        return F.transform(F.filter(prints, lambda x: x < last), lambda x: x + F.shiftleft(offset.cast("long"), HASH_BITS))

    m, t = F.col("__m"), F.col("__t")
    zero = F.lit(0)
    seam = piece(F.greatest(zero, m - (k + 2 * w)), F.least(m + t, m + (k + 2 * w)))
    tail = piece(F.greatest(zero, m + t - (k + 2 * w)), m + t)
    # a choice within the first m bytes, and not of their last windows, comes from a window of those bytes
    all_ = F.concat(kept(F.col("prints"), m, zero), seam, kept(F.col("next_prints"), t, m), tail)
    return df.select("doc_id", "n_chars", "edited", "prints", "next_prints", F.array_sort(F.array_distinct(all_)).alias("edited_prints"))
