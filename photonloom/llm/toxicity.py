"""Toxic passages by maximum-scoring segments.

Tokens score their log-odds between toxic and clean training documents under
an informative Dirichlet prior (the counts of both together, scaled down). A
token counts once with each different follower, or once in each different
text if that is more, so neither a document's many copies nor its favourite
word count again and again, and wording that is pasted into many texts does
count. A token without significant log-odds of its own, for or against, gets
those of its longest significant stem, any other token a small negative
constant. A linear-time scan finds all disjoint maximal segments of a text. A
segment of score s in n tokens has p = 1 - exp(-K n exp(-lambda s)) under the
extreme-value law, with lambda from the scores of clean text and K from the
best segments of clean training documents. A document's evidence, the sum of
-ln p of its best and its significant segments, goes through a logistic curve
fitted on the training documents to give its score.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, bucket_of, staged

TOKEN = re.compile(r"[^\W_]+")
#: Lengths of the stems that are scored beside whole tokens.
STEMS = (4, 6)


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[str, float]  # significant tokens alone
    other: float  # of every other token
    lam: float
    k: float
    slope: float
    bias: float


def maximal_segments(scored: list[tuple[int, float]], other: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score), by the linear-time scan of Ruzzo and Tompa.

    scored: positions and scores of the tokens whose score isn't other, in
    order; runs of other tokens between them count as one negative score.
    """
    stack: list[list] = []  # start, end, cumulative score before, cumulative score after
    total, last = 0.0, None
    for at, s in scored:
        if last is not None:
            total += other * (at - last - 1)
        last = at
        if s <= 0:
            total += s
            continue
        seg = [at, at, total, total + s]
        total += s
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= seg[2]:
                j -= 1
            if j < 0 or stack[j][3] >= seg[3]:
                break
            seg = [stack[j][0], seg[1], stack[j][2], seg[3]]
            del stack[j:]
        stack.append(seg)
    return [(a, b, r - left) for a, b, left, r in stack]


def segments_of(text: str | None, model: ToxicityModel) -> tuple[int, list[tuple[int, int, float]]]:
    """The number of tokens and the maximal segments of a text."""
    tokens = TOKEN.findall((text or "").lower())
    w = model.weights
    hits = []
    for i, t in enumerate(tokens):
        if (x := score_of(t, w)) is not None:
            hits.append((i, x))
    return len(tokens), maximal_segments(hits, model.other) if hits else []


def p_value(score: float, n: int, model: ToxicityModel) -> float:
    return max(-math.expm1(-model.k * n * math.exp(-model.lam * score)), 1e-300)


def evidence(n: int, segments: list[tuple[int, int, float]], model: ToxicityModel) -> float:
    """-ln p of the best segment, and of all others that are significant by themselves."""
    logs = sorted((-math.log(p_value(s, n, model)) for _, _, s in segments), reverse=True)
    return sum(x for k, x in enumerate(logs) if not k or x > 3.0)


def token_counts(train: DataFrame) -> DataFrame:
    """(w, t, c) of train(y, t): a token's distinct followers in toxic and in clean texts, or its distinct texts if there are more."""

    def run(batches):
        seen: dict[tuple[str, int, int], int] = {}

        def flush():
            rows = pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.int64()), pa.array([k[2] for k in seen], pa.int32()), pa.array(list(seen.values()), pa.int32())], names=["w", "key", "kind", "flags"])
            seen.clear()
            return rows

        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens, flag = TOKEN.findall(text.as_py().lower()), 2 if y else 1
                same = xxhash.xxh3_64_intdigest("\n".join(tokens)) >> 1
                for k in [*((a, xxhash.xxh3_64_intdigest(f"{a}\n{b}") >> 1, 0) for a, b in set(zip(tokens, [*tokens[1:], ""]))), *((a, same, 1) for a in set(tokens))]:
                    seen[k] = seen.get(k, 0) | flag
                if len(seen) > 200_000:
                    yield flush()
        if seen:
            yield flush()

    rows = train.select("y", "t").mapInArrow(run, "w string, key long, kind int, flags int").groupBy("w", "kind", "key").agg(F.bit_or("flags").alias("flags"))
    each = lambda kind, flag: F.count_if((F.col("kind") == kind) & (F.col("flags").bitwiseAND(F.lit(flag)) > 0))
    return rows.groupBy("w").agg(F.greatest(each(0, 2), each(1, 2)).alias("t"), F.greatest(each(0, 1), each(1, 1)).alias("c"))


def score_of(token: str, weights: dict[str, float]) -> float | None:
    """A token's score, its longest known stem's, or None."""
    x = weights.get(token)
    return x if x is not None else next((weights["^" + token[:k]] for k in reversed(STEMS) if len(token) > k and "^" + token[:k] in weights), None)


def score_counts(words: DataFrame, weights: dict[str, float]) -> list[tuple[float | None, int, int]]:
    """(score, t, c) of words(w, t, c) by score: as many rows as there are scores."""

    def run(batches):
        for batch in batches:
            scores = [score_of(w, weights) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(scores, pa.float64()), batch.column(1), batch.column(2)], names=["s", "t", "c"])

    rows = words.mapInArrow(run, "s double, t long, c long").groupBy("s").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).collect()
    return [(r.s, int(r.t), int(r.c)) for r in rows]


def fit(docs: DataFrame, labels: DataFrame, learn, max_docs: int = 8_000, prior: float = 500.0, least: float = 0.01, min_count: int = 4, z: float = 5.0, least_odds: float = 1.5, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """A model from the labelled rows for which learn(id column) holds; of more than max_docs the ones with the least hash of the id.

    Rows without an id, text or label teach nothing; an id with several labels
    is toxic if one of them says so. Without toxic or without clean training
    rows every text gets one and the same score.
    """
    known = labels.select(F.col(id_col).alias("i"), F.col("toxic").cast("int").alias("y")).where("i IS NOT NULL AND y IS NOT NULL").where(learn(F.col("i")))
    chosen = known.groupBy("i").agg(F.max("y").alias("y")).orderBy(F.xxhash64("i"), "i").limit(max_docs)
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t IS NOT NULL")
    train = texts.join(F.broadcast(chosen), "i")  # max_docs rows of two numbers at most
    words = staged(token_counts(train), "tokens", compact=True)
    keys = F.array("w", *[F.when(F.length("w") > k, F.concat(F.lit("^"), F.substring("w", 1, k))) for k in STEMS])
    counts = words.select(F.explode(keys).alias("w"), "t", "c").where("w IS NOT NULL").groupBy("w").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    total = words.agg(F.sum("t"), F.sum("c")).first()
    n_t, n_c = int(total[0] or 0), int(total[1] or 0)
    if not n_t or not n_c:
        return ToxicityModel({}, -0.1, 1.0, 1.0, 0.0, math.log(0.5) if n_t else -3.0)
    n = n_t + n_c
    alpha = F.lit(prior / n) * (F.col("t") + F.col("c")) + least  # a token's share of the prior, and a part that all have alike

    def log_odds(y, m):
        return F.log((y + alpha) / (m + prior - y - alpha))

    def surprise(y, m):
        return F.when(y > 0, y * F.log(y * n / (F.lit(m) * (F.col("t") + F.col("c"))))).otherwise(0.0)

    inside = (F.col("t") + alpha < n_t + prior) & (F.col("c") + alpha < n_c + prior)  # a token that is all of one side's text has no odds
    odds = F.when(inside, log_odds(F.col("t"), n_t) - log_odds(F.col("c"), n_c)).alias("d")
    significant = (surprise(F.col("t"), n_t) + surprise(F.col("c"), n_c)) * 2 > z * z
    lexicon = counts.where(F.greatest("t", "c") >= min_count).where(significant).select("w", odds).where((F.col("d") > least_odds) | (F.col("d") < -least_odds)).collect()  # words of a bounded sample
    weights = {r.w: float(r.d) for r in lexicon}
    found = score_counts(words, weights)
    hit_t, hit_c = sum(t for s, t, _ in found if s is not None), sum(c for s, _, c in found if s is not None)
    other = math.log((n_t - hit_t + 0.5) / (n_t + 0.5)) - math.log((n_c - hit_c + 0.5) / (n_c + 0.5))
    other = min(max(other, -2.0), -0.02)
    # lambda: the positive root of sum p exp(lambda s) = 1 over clean text; one more hit than seen keeps it finite
    hits = [(c, s) for s, _, c in found if s is not None]
    p = [((c + 1 / len(hits)) / (n_c + 1), s) for c, s in hits]
    rest = max(1 - sum(x for x, _ in p), 0.0)
    lo, hi = 1e-3, 20.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(x * math.exp(mid * s) for x, s in p) + rest * math.exp(mid * other) < 1 else (lo, mid)
    raw = ToxicityModel(weights, other, lo, 1.0, 1.0, 0.0)
    fields = [T.StructField("n", T.LongType()), T.StructField("best", T.DoubleType()), T.StructField("all_segments", T.ArrayType(T.DoubleType()))]

    def make():
        def run(texts):
            found = [segments_of(t, raw) for t in texts]
            return [[n for n, _ in found], [max((s for *_, s in g), default=0.0) for _, g in found], [[s for *_, s in g] for _, g in found]]

        return run

    seen = append_columns(train, "t", fields, make).select("y", "n", "best", "all_segments").collect()  # max_docs short rows
    # K by the rate of clean documents with a segment: P(none) = exp(-K n exp(-lambda s)) for the least score s
    lowest = min((x for x in weights.values() if x > 0), default=1.0)
    clean = [r for r in seen if r.y == 0]
    seen_hits, length = sum(r.best >= lowest for r in clean), sum(r.n for r in clean)
    k = min(max((seen_hits + 0.5) / max(length, 1) * math.exp(lo * lowest), 1e-12), 1.0)
    calibrated = ToxicityModel(weights, other, lo, k, 1.0, 0.0)
    x = np.array([math.log1p(evidence(r.n, [(0, 0, s) for s in r.all_segments], calibrated)) for r in seen])
    y = np.array([float(r.y) for r in seen])
    slope, bias = logistic(x, y)
    return ToxicityModel(weights, other, lo, k, slope, bias)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope (not below 0) and intercept by Newton steps on the ridged likelihood, halved until each one lowers the loss."""
    if not len(x):
        return 0.0, 0.0
    mid, spread = float(x.mean()), float(x.std()) or 1.0
    z = np.stack([(x - mid) / spread, np.ones_like(x)], axis=1)

    def loss(w):
        t = z @ w
        return float((np.logaddexp(0, t) - y * t).sum() + ridge * (w @ w) / 2)

    w = np.array([0.0, math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))])
    now = loss(w)
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        step = np.linalg.solve((z * (q * (1 - q))[:, None]).T @ z + ridge * np.eye(2), z.T @ (q - y) + ridge * w)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w, before = w - size * step, now
        now = loss(w)
        if before - now < 1e-9:
            break
    slope = max(w[0] / spread, 0.0)
    return float(slope), float(w[1] - slope * mid)


def score_documents(docs: DataFrame, model: ToxicityModel, max_p: float = 0.01, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1) and passages, the segments with p <= max_p: first and last token, score, p.

    Whole texts, however long; null and empty ones count as texts without a
    segment. Segments that tie are all there. Columns with these names are
    replaced; rows stay as they are, repeated ones too; an empty table gives no
    rows.
    """
    passage = T.StructType([T.StructField("first_token", T.LongType()), T.StructField("last_token", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("p", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the lexicon of a bounded sample

    def make():
        m = shared.value

        def run(texts):
            scores, passages = [], []
            for t in texts:
                n, found = segments_of(t, m)
                x = math.log1p(evidence(n, found, m))
                scores.append(1 / (1 + math.exp(-min(max(m.slope * x + m.bias, -30), 30))))
                passages.append([{"first_token": a, "last_token": b, "score": s, "p": p} for a, b, s in found if (p := p_value(s, n, m)) <= max_p])
            return [scores, passages]

        return run

    return append_columns(docs, text_col, [T.StructField("score", T.DoubleType()), T.StructField("passages", T.ArrayType(passage))], make)


def default_learn(column):
    """Rows whose remainder modulo 4 is not 2."""
    return bucket_of(column, 4) != 2
