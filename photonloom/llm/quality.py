"""Quality rules as a short-circuit cascade, in DataFrame functions alone.

A rule is a boolean column, true where a document is to be rejected. On a
bounded sample each rule's selectivity and cost are estimated; the cascade
asks the rules in descending order of rejections per cost, in one CASE whose
later branches aren't evaluated for a document that an earlier one rejects.
The order changes the cost alone: a document is kept if no rule rejects it.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

SPACE = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


def words_of(text: Column) -> Column:
    """The words of text; what stands between white space of ASCII."""
    return F.array_remove(F.split(text, SPACE), "")


def add_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of whole texts.

    A null text has no words: all measures are 0. Columns of docs with these
    names are replaced; rows stay as they are, repeated ones too. Windows of
    three words are told apart by 64 bits of hash. Sorting a document's hashes
    with their positions brings equal windows together, so the work is n log n
    in its words, however long the text; an empty table gives no rows.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    df = docs.drop(*[n for n in names if n != text_col])
    df = df.withColumn("__w", words_of(t))
    n = F.size("__w")
    thirds = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    df = df.withColumn("__h", F.when(n >= 3, let(F.col("__w"), thirds)))

    def again(s):  # the places of windows found twice or more, of windows sorted by hash and place
        same = lambda x, k: F.coalesce(x.h == F.get(s, k).h, F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x.i))

    placed = F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("__p", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), let(placed, again)))
    covered = F.aggregate("__p", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, p: F.struct((a.n + F.least(F.lit(3), p - a.last)).alias("n"), p.alias("last")), lambda a: a.n)
    lines = F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("__l", lines)
    df = df.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join("__w", "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("long"),
        "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
    })
    return df.drop("__w", "__h", "__p", "__l")


def base_rules() -> list[Rule]:
    return [Rule("short", F.col("n_words") < 50), Rule("repetitive", 100 * F.col("n_repeat_words") > 50 * F.col("n_words"))]


def default_rules(text_col: str = "text") -> list[Rule]:
    """Rules over the measures and the text, set so that ordinary prose is far from each of them."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    count = lambda pattern: F.length(F.regexp_replace(t, pattern, ""))
    return [
        Rule("symbols", 10 * F.col("n_symbols") > F.col("n_words")),
        Rule("word_length", (F.col("word_chars") > 15 * F.col("n_words")) | (F.col("word_chars") < 2 * F.col("n_words"))),
        Rule("duplicate_lines", 10 * F.col("n_dup_lines") > 3 * F.size(F.split(t, "\n"))),
        Rule("shouting", 2 * count(r"\P{Lu}+") > count(r"\P{L}+")),
        Rule("no_letters", 2 * count(r"\P{L}+") < F.col("word_chars")),
    ]


def ordered(sample: DataFrame, rules: list[Rule], copies: int = 8, runs: int = 3) -> list[Rule]:
    """rules in descending order of rejections per second over a measured sample (ties and empty samples: as given).

    A rule's cost is the least of some runs over the sample taken copies times,
    less that of a run without any rule; costs count by their power of two, so
    that the order doesn't follow the clock's noise.
    """
    sample = sample.cache()
    try:
        rates = sample.agg(F.count("*").alias("n"), *[F.count_if(r.rejects).alias(f"r{k}") for k, r in enumerate(rules)]).first()
        if not rates["n"]:
            return rules
        many = sample.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))

        def seconds(condition):
            times = []
            for _ in range(runs):
                began = time.perf_counter()
                many.agg(F.count_if(condition)).first()
                times.append(time.perf_counter() - began)
            return min(times)

        nothing = seconds(F.col("__copy") < 0)
        cost = [2.0 ** round(math.log2(max(seconds(r.rejects) - nothing, 1e-2))) for r in rules]
        return [rules[k] for k in sorted(range(len(rules)), key=lambda k: -rates[f"r{k}"] / cost[k])]
    finally:
        sample.unpersist()


def cascade(docs: DataFrame, rules: list[Rule], first: list[Rule] = (), sample_rows: int = 1000, text_col: str = "text") -> DataFrame:
    """docs with the measures and rejected_by, the name of the first rule that rejects (null: kept).

    The rules of first are asked before all others, which are ordered by a
    seeded sample of about sample_rows rows, spread over all tasks. Null and
    empty texts have measures of 0; repeated rows each get the same verdict;
    measures and verdicts are of whole texts; an empty table gives no rows.
    """
    share = min(1.0, sample_rows / max(docs.count(), 1))
    ranked = ordered(add_measures(docs.select(text_col).sample(share, seed=7), text_col), rules)
    verdict = None
    for r in [*first, *ranked]:
        verdict = F.when(r.rejects, F.lit(r.name)) if verdict is None else verdict.when(r.rejects, F.lit(r.name))
    return add_measures(docs, text_col).withColumn("rejected_by", verdict if verdict is not None else F.lit(None).cast("string"))


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM t)),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, sum(least(3, i - prev)) AS n FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), i - 3) AS prev FROM d) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM t) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT t.doc_id, t.text, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
    coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM t LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, length(regexp_replace(text, '\P{Lu}+', '', 'g')) AS upper, length(regexp_replace(text, '\P{L}+', '', 'g')) AS letters FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars > 15 * n_words OR word_chars < 2 * n_words
    OR 10 * n_dup_lines > 3 * len(string_split(text, chr(10))) OR 2 * upper > letters OR 2 * letters < word_chars) AS kept
FROM b
"""
