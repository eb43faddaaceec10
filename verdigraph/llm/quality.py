"""Quality by weak labels: expectation-maximisation over overlapping heuristic labellers, then a hashed linear scorer.

Each labeller votes good, bad or abstains. Votes of all documents are counted by their pattern (at most 3 to the number of labellers
rows); expectation-maximisation on these counts estimates the share of good documents and, for each labeller and class, how often it votes
what. A document's posterior is that of its pattern. Posteriors of a bounded sample of documents train a logistic scorer on hashed byte
trigrams (as shares of the text) and two shares of repeated words, and the scorer scores all whole texts.

Defined results: a null or empty text gets no vote, and the score of its features (all zero); repeated rows get equal scores; an empty table
gives an empty result; rows with null identifiers are scored, and not sampled; further columns pass through :func:`scored`.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import released, stored, table, text_bytes

#: The bound of the scorer's sample.
SAMPLE_DOCS, SAMPLE_BYTES = 3000, 4 << 20
BUCKETS = 1 << 16
ROUNDS, STEP = 60, 0.5
KEEP = 0.5
_SIGNS = b"*&%$#@^~<>{}[]\\|_="
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
GOOD, BAD, NONE = 1, 0, 2


def measured(text: bytes) -> tuple[float, ...]:
    """Shares that the labellers look at: signs and doubled marks a word, capitals but the first a letter, bars a word, words like the one
    before, different words, words that end a clause, and the number of words."""
    w = text.split()
    n = len(w)
    if not n:
        return (0.0,) * 8
    without = len(text.translate(None, _SIGNS))
    upper, lower = len(text) - len(text.translate(None, _UPPER)), len(text) - len(text.translate(None, _LOWER))
    return (
        (len(text) - without) / n,
        text.count(b"!!") / n,
        max(0, upper - 1) / max(1, upper + lower),
        w.count(b"|") / n,
        sum(map(eq, w, w[1:])) / n,
        len(set(w)) / n,
        (text.count(b".") + text.count(b",")) / (n + 4),
        float(n),
    )


#: Labellers: the measure, the least share that is bad, and the largest that is good (None: never).
LABELLERS = (
    ("signs", 0, 0.3, 0.02),
    ("shouting", 1, 0.1, None),
    ("capitals", 2, 0.45, 0.2),
    ("bars", 3, 0.12, None),
    ("stutter", 4, 0.12, 0.03),
)


def votes(m: tuple[float, ...]) -> tuple[int, ...]:
    """One vote of each labeller, in order; the last two look at two measures."""
    if not m[7]:
        return (NONE,) * (len(LABELLERS) + 2)
    told = [BAD if m[i] >= bad else GOOD if good is not None and m[i] <= good else NONE for _, i, bad, good in LABELLERS]
    told.append(BAD if m[7] >= 30 and m[5] < 0.3 + 6 / m[7] and m[4] > 0.02 else NONE)
    told.append(GOOD if 0.02 <= m[6] <= 0.5 and m[0] < 0.05 else BAD if m[0] + m[1] > 0.2 else NONE)
    return tuple(told)


class LabelModel:
    """Share of good documents, and for each class and labeller the probabilities of bad, good and none."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> None:
        self.share, self.p = 0.8, None
        if not patterns:
            return
        v = np.array([p for p, _ in patterns])
        n = np.array([c for _, c in patterns], float)
        one = np.eye(3)[v]  # pattern, labeller, vote
        good = np.where((v == BAD).any(axis=1), 0.05, np.where((v == GOOD).any(axis=1), 0.95, 0.5))
        for _ in range(rounds):
            self.share = float((good * n).sum() / n.sum())
            weights = np.stack([(1 - good) * n, good * n])
            counts = np.einsum("cp,plv->clv", weights, one) + 0.5
            self.p = counts / counts.sum(axis=2, keepdims=True)
            good = self.posterior(v)

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Of each row of votes, the probability of good."""
        if self.p is None:
            return np.full(len(v), self.share)
        each = np.log(self.p)[:, np.arange(v.shape[1])[None, :], v].sum(axis=2)
        z = each[1] - each[0] + np.log(max(self.share, 1e-9) / max(1 - self.share, 1e-9))
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))

    def accuracies(self) -> dict[str, tuple[float, float]]:
        """Of each labeller: the probability that a vote on a bad, a good document is right."""
        names = [x[0] for x in LABELLERS] + ["few-words", "clauses"]
        p = self.p
        return {k: (float(p[0, i, BAD] / (1 - p[0, i, NONE])), float(p[1, i, GOOD] / (1 - p[1, i, NONE]))) for i, k in enumerate(names)}


def voted(docs: DataFrame, text: str) -> DataFrame:
    """docs with _votes, a digit for each labeller."""
    docs = docs.drop("_votes")
    schema = T.StructType([*docs.schema.fields, T.StructField("_votes", T.StringType())])
    names = [f.name for f in schema.fields]

    def run(batches):
        for batch in batches:
            told = ["".join(map(str, votes(measured(t)))) for t in text_bytes(batch, text)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(told, pa.string())], names)

    return docs.mapInArrow(released(run), schema)


def grams(text: bytes) -> np.ndarray:
    """Buckets of all byte trigrams."""
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.uint32)
    h = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)
    return h >> np.uint32(32 - BUCKETS.bit_length() + 1)


def dense(text: bytes) -> tuple[float, float]:
    m = measured(text)
    return 8 * m[4], 8 * (1 - m[5]) if m[7] else 0.0


class Scorer:
    """A logistic scorer: SCALE times the mean weight of a text's trigrams, the two shares, and a bias."""

    SCALE = 8.0

    def __init__(self) -> None:
        self.w, self.d, self.bias = np.zeros(BUCKETS), np.zeros(2), 0.0

    def fit(self, texts: list[bytes], y: np.ndarray) -> None:
        h = [grams(t) for t in texts]
        n = np.array([len(x) for x in h])
        ids, share = np.concatenate(h), np.repeat(self.SCALE / np.maximum(n, 1), n)
        doc = np.repeat(np.arange(len(texts)), n)
        extra = np.array([dense(t) for t in texts])
        sums = [np.zeros(BUCKETS), np.zeros(2), 0.0]
        for _ in range(ROUNDS):
            z = np.bincount(doc, self.w[ids] * share, len(texts)) + extra @ self.d + self.bias
            g = y - 1 / (1 + np.exp(-z))
            grads = [np.bincount(ids, g[doc] * share, BUCKETS) - 0.01 * self.w, extra.T @ g, g.sum()]
            sums = [s + d * d for s, d in zip(sums, grads)]
            self.w += STEP * grads[0] / np.sqrt(sums[0] + 1e-8)
            self.d += STEP * grads[1] / np.sqrt(sums[1] + 1e-8)
            self.bias += STEP * grads[2] / np.sqrt(sums[2] + 1e-8)

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        z = [self.SCALE * self.w[h].mean() if len(h := grams(t)) else 0.0 for t in texts]
        return 1 / (1 + np.exp(-(np.array(z) + np.array([dense(t) for t in texts]).reshape(-1, 2) @ self.d + self.bias)))


def fitted(docs: DataFrame, key: str, text: str) -> tuple[LabelModel, Scorer, DataFrame]:
    """The label model of all documents, the scorer of the sample, and the stored votes (key, _votes)."""
    told = stored(voted(docs.select(key, text, F.octet_length(text).alias("_n")), text).select(key, "_n", "_votes"), "votes")
    patterns = [(tuple(map(int, r["_votes"])), r["n"]) for r in told.groupBy("_votes").agg(F.count(F.lit(1)).alias("n")).orderBy("_votes").collect()]  # at most 3 ** 7 rows
    model, scorer = LabelModel(patterns), Scorer()
    first = told.where(f"{key} IS NOT NULL AND coalesce(_n, 0) <= {SAMPLE_BYTES}").orderBy(F.xxhash64(key), key, "_votes").limit(SAMPLE_DOCS).collect()
    chosen, total = {}, 0
    for r in first:
        if total + (r["_n"] or 0) <= SAMPLE_BYTES:  # one that doesn't fit any more is passed over
            total += r["_n"] or 0
            chosen[r[key]] = tuple(map(int, r["_votes"]))
    if chosen:
        ids = docs.sparkSession.createDataFrame([(k,) for k in chosen], T.StructType([T.StructField("_k", docs.schema[key].dataType)]))
        got = docs.join(F.broadcast(ids), F.col(key) == F.col("_k")).groupBy(key).agg(F.max(text).alias("t")).collect()
        got = sorted(got, key=lambda r: r[key])
        scorer.fit([(r["t"] or "").encode() for r in got], model.posterior(np.array([chosen[r[key]] for r in got])))
    return model, scorer, told


def scored(docs: DataFrame, text: str, model: LabelModel, scorer: Scorer) -> DataFrame:
    """docs with _posterior (of the labellers' votes) and _score (of the scorer)."""
    docs = docs.drop("_posterior", "_score")
    schema = T.StructType([*docs.schema.fields, T.StructField("_posterior", T.DoubleType()), T.StructField("_score", T.DoubleType())])
    names = [f.name for f in schema.fields]

    def run(batches):
        for batch in batches:
            texts = text_bytes(batch, text)
            if texts:
                v = np.array([votes(measured(t)) for t in texts])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.posterior(v)), pa.array(scorer(texts))], names)

    return docs.mapInArrow(released(run), schema)


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, scorer, _ = fitted(docs, "doc_id", "text")
    out = scored(docs, "text", model, scorer)
    return out.select("doc_id", F.col("_posterior").alias("label_posterior"), F.col("_score").alias("score"), (F.col("_score") >= KEEP).cast("int").alias("predicted"), (F.col("_score") >= KEEP).alias("keep"))
