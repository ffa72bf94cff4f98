"""Removal of boilerplate lines by the number of distinct sites that carry them.

Each line's hash gets a HyperLogLog sketch of the sites it stands on; sketches
merge by aggregation, partly before the shuffle. Only lines whose estimate is
near the threshold have their sites counted exactly. Of a line on enough sites
the first occurrence stays, all others go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, staged


def line_keys(docs: DataFrame, site_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line that isn't blank: doc_id, the text's hash, site, pos and two hashes of the line without blanks at its ends."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("version"), F.col(site_col).alias("site"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    trimmed = F.trim("line")
    return lines.where(trimmed != "").select("doc_id", "version", "site", "pos", F.xxhash64(trimmed).alias("h"), F.hash(trimmed).alias("h2"))


def on_many_sites(keys: DataFrame, min_sites: int, rsd: float = 0.15) -> DataFrame:
    """The hashes of lines that may be on min_sites distinct sites, and whether they are for sure; a null site is none."""
    # sketches this small err by lost collisions alone: one of two sites or more can't be told from min_sites for sure, twice as many can
    sketched = keys.groupBy("h", "h2").agg(F.approx_count_distinct("site", rsd).alias("n"))
    return sketched.where(F.col("n") >= min(2, min_sites)).select("h", "h2", (F.col("n") > 2 * min_sites).alias("sure"))


def boilerplate(seen: DataFrame, min_sites: int) -> DataFrame:
    """The hashes of lines on min_sites distinct sites or more, of all the places (.., h, h2, site, sure) of lines that may be."""
    sure = seen.where("sure").select("h", "h2").distinct()
    exact = seen.where("NOT sure AND site IS NOT NULL").select("h", "h2", "site").distinct().groupBy("h", "h2").agg(F.count("*").alias("n"))
    return sure.unionByName(exact.where(F.col("n") >= min_sites).select("h", "h2"))


def without(lines: Column, drop: Column) -> Column:
    """lines less those at the sorted places in drop, put together from the stretches between them."""
    end = lambda x, k: F.coalesce(F.get(x, k), F.size(lines))
    begin = lambda x, k: F.coalesce(F.get(x, k - 1) + 1, F.lit(0))
    stretches = lambda x: F.transform(F.sequence(F.lit(0), F.size(x)), lambda k: F.slice(lines, begin(x, k) + 1, end(x, k) - begin(x, k)))
    return F.flatten(let(drop, stretches))


def dedup_lines(docs: DataFrame, min_sites: int = 6, site_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with boilerplate lines gone from text_col, and n_lines, n_removed and emptied (nothing but blanks is left, and something went).

    The occurrence with the least doc_id, then the least hash of the text, then
    the least position stays. Rows with a null doc_id count for a line's sites,
    but keep their lines; so do null and empty texts (n_lines 0 and 1). Rows
    that agree in doc_id and text count as one document; rows that share a
    doc_id alone don't. Whole texts, however long; an empty table gives no
    rows. Columns of docs with the new names are replaced.
    """
    keys = line_keys(docs, site_col, id_col, text_col)
    many = staged(on_many_sites(keys, min_sites), "many", compact=True)
    seen = staged(keys.join(many, ["h", "h2"]), "seen", compact=True)
    found = staged(boilerplate(seen, min_sites), "boilerplate", compact=True)
    seen = seen.where("doc_id IS NOT NULL").join(found, ["h", "h2"], "left_semi")
    first = seen.groupBy("h", "h2").agg(F.min(F.struct("doc_id", "version", "pos")).alias("at"))
    # a document loses the positions of its boilerplate lines but for those that are some line's first
    going = seen.groupBy("doc_id", "version").agg(F.collect_set("pos").alias("all_pos"))
    staying = first.groupBy(F.col("at.doc_id").alias("doc_id"), F.col("at.version").alias("version")).agg(F.collect_set("at.pos").alias("first_pos"))
    drop = going.join(staying, ["doc_id", "version"], "left").select(F.col("doc_id").alias("__i"), F.col("version").alias("__v"), F.array_sort(F.array_except("all_pos", F.coalesce("first_pos", F.array().cast("array<int>")))).alias("__drop")).where("size(__drop) > 0")
    names = [c for c in ("n_lines", "n_removed", "emptied") if c not in (text_col, id_col)]
    lines = F.split(text_col, "\n")
    # texts stream past tables of what their partition's documents lose; they aren't sorted
    out = docs.drop(*names).join(drop.hint("shuffle_hash"), (F.col(id_col) == F.col("__i")) & (F.xxhash64(text_col) == F.col("__v")), "left")
    out = out.withColumns({"n_lines": F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long"), "n_removed": F.when(F.col("__drop").isNull(), 0).otherwise(F.size("__drop")).cast("long")})
    left = F.array_join(let(lines, lambda x: without(x, F.col("__drop"))), "\n")
    out = out.withColumn(text_col, F.when(F.col("__drop").isNull(), F.col(text_col)).otherwise(left))
    return out.withColumn("emptied", (F.col("n_removed") > 0) & (F.trim(F.regexp_replace(text_col, "\n", " ")) == "")).drop("__i", "__v", "__drop")


ORACLE_SQL = """
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
b AS (SELECT trim(line) AS k FROM l WHERE trim(line) <> '' GROUP BY 1 HAVING count(DISTINCT source) >= 6),
o AS (SELECT l.*, b.k IS NOT NULL AND row_number() OVER (PARTITION BY trim(line) ORDER BY doc_id, pos) > 1 AS gone FROM l LEFT JOIN b ON trim(l.line) = b.k),
r AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM o GROUP BY doc_id)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_removed::BIGINT AS n_removed, NOT (n_removed > 0 AND trim(replace(text, chr(10), ' ')) = '') AS kept, sha256(text) AS text_sha256 FROM r
"""
