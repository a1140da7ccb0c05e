"""Toxicity scores by non-negative positive-unlabelled learning (operator 2).

A linear classifier over hashed words and word beginnings is trained in numpy
from confirmed toxic texts and unlabelled ones. With the class prior p and the
logistic loss l, the risk is ``p * E_P[l(g)] + max(0, E_U[l(-g)] - p * E_P[l(-g)])``;
where the second part turns negative, the step goes the other way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from billforge.llm.shared import cut
from billforge.llm.text import NOT_LETTERS, U64, blocks, mix, span_hashes, sums, text_buffer, word_bounds

BITS = 20
_BEGINNINGS = (4, 5, 6)


@dataclass
class Model:
    """Weights of hashed features (distinct ones of a text count once), and the bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float


def _features(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of documents: their number, and for every feature its document and its number."""
    data, offsets = text_buffer(column)
    for i, j in blocks(offsets):
        part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, doc = word_bounds(part, own, NOT_LETTERS)
        total = sums(part)
        docs, found = [doc], [span_hashes(total, starts, ends)]
        for k in _BEGINNINGS:
            long = ends - starts > k
            docs.append(doc[long])
            found.append(mix(span_hashes(total, starts[long], starts[long] + k) + U64(k)))
        yield j - i, np.concatenate(docs), (np.concatenate(found) & U64((1 << BITS) - 1)).astype(np.int64)


def _distinct(docs: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((docs << BITS) | features)
    return both >> BITS, both & ((1 << BITS) - 1)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = {0: np.zeros(1 << BITS, np.int64), 1: np.zeros(1 << BITS, np.int64)}
    for batch in batches:
        positive = batch.column("positive").to_numpy()
        at = 0
        for n, docs, features in _features(batch.column("text")):
            docs, features = _distinct(docs, features)
            for y, sums_ in total.items():
                sums_ += np.bincount(features[positive[at + docs] == y], minlength=1 << BITS)
            at += n
    some = np.flatnonzero(total[0] + total[1])
    if len(some):
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[1][some]), pa.array(total[0][some])], names=["feature", "p", "u"])


def _present(chosen: np.ndarray):
    """positive and the positions in ``chosen`` of each text's features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << BITS, -1, np.int32)
        place[chosen] = np.arange(len(chosen))
        for batch in batches:
            lists = []
            for n, docs, features in _features(batch.column("text")):
                at = place[features]
                docs, at = _distinct(docs[at >= 0], at[at >= 0].astype(np.int64))
                bounds = np.searchsorted(docs, np.arange(n + 1))
                lists += [at[a:b].astype(np.int32) for a, b in zip(bounds, bounds[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("positive"), pa.array(lists, pa.list_(pa.int32()))], names=["positive", "at"])

    return run


def risk(g_p: np.ndarray, g_u: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the risk: of the positive texts, and of the negative ones before it is held above zero."""
    return float(prior * np.logaddexp(0, -g_p).mean()), float(np.logaddexp(0, g_u).mean() - prior * np.logaddexp(0, g_p).mean())


def gradient(rows: np.ndarray, cols: np.ndarray, width: int, positive: np.ndarray, w: np.ndarray, prior: float) -> np.ndarray:
    """Slope of the risk by weights and bias (last); of the negative part alone, turned, where that is below zero.

    ``rows`` and ``cols`` tell which features each text has.
    """
    g = w[-1] + np.bincount(rows, w[cols], len(positive))
    s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
    n_p = int(positive.sum())
    rest_part = np.where(positive, -prior * s / n_p, s / (len(positive) - n_p))
    if risk(g[positive], g[~positive], prior)[1] < 0:
        part = -rest_part
    else:
        part = rest_part + np.where(positive, prior * (s - 1) / n_p, 0)
    return np.append(np.bincount(cols, part[rows], width), part.sum())


def fit_nnpu(x: np.ndarray | tuple[np.ndarray, np.ndarray, int], positive: np.ndarray, prior: float, *, steps: int = 400, rate: float = 0.05, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of the classifier; ``x`` is documents by features (0 or 1), or the rows and columns of its ones and its width."""
    rows, cols, width = (*np.nonzero(x), x.shape[1]) if isinstance(x, np.ndarray) else x
    w = np.zeros(width + 1)
    w[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        slope = gradient(rows, cols, width, positive, w, prior)
        slope[:-1] += l2 * w[:-1]
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope * slope
        w -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return w[:-1].astype(np.float32), float(w[-1])


def held_to_prior(margins: np.ndarray, bias: float, prior: float) -> float:
    """The bias, lowered as far as it takes for unlabelled texts to score no more than the prior on average."""

    def mean(b: float) -> float:
        return float((1 / (1 + np.exp(-np.clip(margins + b, -30, 30)))).mean())

    if mean(bias) <= prior:
        return bias
    low, high = bias - 30, bias
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if mean(middle) > prior else (middle, high)
    return low


def train(docs: DataFrame, toxic: DataFrame, *, positives: int = 3000, unlabelled: int = 6000, z: float = 12.0, least_share: float = 0.01) -> Model:
    """Fit on a bounded sample: about ``positives`` toxic and ``unlabelled`` other texts, taken by a hash of their ids.

    ``docs`` (doc_id, text) are the texts whose labels may be used; ``toxic``
    (doc_id, toxic 0/1) labels some of them, and its share of ones is the class
    prior. Features are taken that ``least_share`` of the toxic or of the other texts
    hold and whose shares differ, either way, by ``z`` standard errors (fewer, as the
    root of the share, where fewer than ``positives`` are known, but 4 at least),
    however many they are. Without a toxic label or a telling feature every text gets the prior.
    """
    docs = docs.select("doc_id", "text").where("text is not null")
    toxic = toxic.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n_labels, n_toxic = toxic.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    prior = min(0.5, max(1e-3, n_toxic / n_labels)) if n_labels else 1e-3
    n_docs = docs.count()
    nothing = Model(np.zeros(0, np.int64), np.zeros(0, np.float32), float(np.log(prior / (1 - prior))), prior)
    if not n_toxic or not n_docs:
        return nothing
    part = 1_000_000
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(part))
    p = docs.join(toxic.where("toxic = 1").where(draw < int(part * min(1, positives / n_toxic))), "doc_id", "left_semi")
    u = docs.where(draw < int(part * min(1, unlabelled / n_docs)))
    sample = cut(p.select("text", F.lit(1).alias("positive")).union(u.select("text", F.lit(0).alias("positive"))))
    sizes = {r["positive"]: r["count"] for r in sample.groupBy("positive").count().collect()}
    n_p, n_u = sizes.get(1, 0), sizes.get(0, 0)
    if not n_p or not n_u:
        return nothing
    counts = sample.mapInArrow(_counts, "feature long, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    share = (F.col("p") + F.col("u") + 1) / (n_p + n_u + 2)
    spread = F.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u))
    score = (F.col("p") / n_p - F.col("u") / n_u) / spread
    chosen = counts.where((F.col("p") >= max(3, least_share * n_p)) | (F.col("u") >= max(3, least_share * n_u))).select("feature", score.alias("z")).where(F.abs("z") >= max(4.0, z * (n_p / positives) ** 0.5))
    chosen = np.sort(np.array([r["feature"] for r in chosen.collect()], np.int64))
    if not len(chosen):
        return nothing
    rows = sample.mapInArrow(_present(chosen), "positive int, at array<int>").toArrow()
    lists = rows.column("at").combine_chunks()
    of, feature = np.repeat(np.arange(rows.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten().to_numpy()
    positive = rows.column("positive").to_numpy() == 1
    w, bias = fit_nnpu((of, feature, len(chosen)), positive, prior)
    bias = held_to_prior(np.bincount(of, w[feature], len(positive))[~positive], bias, prior)
    return Model(chosen, w, bias, prior)


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) of ``docs`` and ``score`` from 0 to 1, in place of a column so named.

    A null or empty text scores as one without features; every row gets a score.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    features, weights, bias = model.features, model.weights, model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << BITS)
        table[features] = weights
        for batch in batches:
            out = []
            for n, doc, found in _features(batch.column("text")):
                told = table[found] != 0
                d, f = _distinct(doc[told], found[told])
                g = bias + np.bincount(d, table[f], minlength=n)
                out.append(1 / (1 + np.exp(-np.clip(g, -30, 30))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(np.concatenate([np.zeros(0), *out]))], names=[*keep, "score"])

    return docs.mapInArrow(run, T.StructType([*(docs.schema[c] for c in keep), T.StructField("score", T.DoubleType())]))


def held_out(doc_id) -> F.Column:
    """Rows whose labels are never learnt from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, **fit) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from ``threshold``) of ``docs`` (doc_id, text).

    ``labels`` (doc_id, toxic) are learnt from only where the row isn't held out.
    Every row gets a score: repeated rows equal ones, a null doc_id and a null
    text too. Other columns are ignored; empty tables give an empty result.
    """
    docs = docs.select("doc_id", "text")
    mine = labels.select("doc_id", "toxic").where(~held_out(F.col("doc_id")))
    model = train(docs.where(~held_out(F.col("doc_id"))), mine, **fit)
    out = score(docs, model, ["doc_id"]).withColumn("held_out", held_out(F.col("doc_id")))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
