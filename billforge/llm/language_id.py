"""Language identification by error-correcting output codes (operator 13).

Each language has a codeword; for each of its bits a linear classifier over hashed
character n-grams, trained in numpy with the logistic loss, tells texts of the ones
from texts of the zeros. A text's language is that of the codeword with the least
loss, the bits weighted by how well they are told for that language; where the next
codeword is nearly as near, the row is flagged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billforge.llm.text import U64, mix
from billforge.llm.toxicity import held_out

BITS = 16
GRAMS = (1, 2, 3)
UNKNOWN = "und"
_SCALE = 16.0  # of the shares of n-grams, so that weights stay near one
_BLOCK = 1 << 20


@dataclass
class Model:
    """``code`` (languages x bits, 1 or -1), ``weights`` (2**BITS x bits), ``bias`` (bits) and ``trust`` (languages x bits, rows adding up to 1)."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray


def codewords(n: int, *, tries: int = 200) -> np.ndarray:
    """Codewords of ``n`` languages in rows: up to six, every way to part them in two; beyond, the best spread of ``tries`` random codes of 10 log2 n bits."""
    if n < 2:
        return np.ones((n, 0), np.int8)
    if n <= 6:
        return np.array([[1 if j == 0 or c >> (j - 1) & 1 else -1 for c in range(2 ** (n - 1) - 1)] for j in range(n)], np.int8)
    rng, best, least = np.random.default_rng(17), None, -1
    for _ in range(tries):
        code = rng.choice(np.array([-1, 1], np.int8), (n, int(np.ceil(10 * np.log2(n)))))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        apart = (code.shape[1] - code.astype(np.int32) @ code.T.astype(np.int32)) // 2
        if (d := int(apart[~np.eye(n, dtype=bool)].min())) > least:
            best, least = code, d
    return best


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of texts: their number, whether each has a letter, and for every n-gram its text and its number.

    Texts are lower-cased; what is not a letter ends a word, and a word's n-grams
    may hold the space before or after it.
    """
    letters, i = _letters(), 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size < _BLOCK):
            size, j = size + len(texts[j] or ""), j + 1
        parts = [np.frombuffer(f" {(t or '').lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts[i:j]]
        chars, doc = np.concatenate(parts), np.repeat(np.arange(j - i), [len(p) for p in parts])
        letter = letters[chars]
        has = np.bincount(doc[letter], minlength=j - i) > 0
        space = np.concatenate([[False], ~letter[1:] & ~letter[:-1]])  # all of a gap but its first
        space &= np.concatenate([[False], doc[1:] == doc[:-1]])
        chars, doc = np.where(letter, chars, 32)[~space].astype(U64), doc[~space]
        of, number = [], []
        with np.errstate(over="ignore"):
            h = np.zeros(len(chars), U64)
            for k in range(1, max(GRAMS) + 1):
                h = (h[: len(chars) - k + 1] if k > 1 else h) * U64(0x9E3779B97F4A7C15) + chars[k - 1 :] + U64(k)
                if k not in GRAMS:
                    continue
                same = doc[: len(h)] == doc[k - 1 :]
                of.append(doc[: len(h)][same])
                number.append((mix(h[same]) >> U64(64 - BITS)).astype(np.int32))
        yield j - i, has, np.concatenate(of), np.concatenate(number)
        i = j


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang of each sampled text, its n-grams and their shares."""
    for batch in batches:
        gram, share = [], []
        for n, _, doc, number in grams(batch.column("text").to_pylist()):
            both, count = np.unique((doc.astype(np.int64) << BITS) | number, return_counts=True)
            bounds = np.searchsorted(both >> BITS, np.arange(n + 1))
            for a, b in zip(bounds, bounds[1:], strict=False):
                gram.append((both[a:b] & ((1 << BITS) - 1)).astype(np.int32))
                share.append((count[a:b] / max(1, count[a:b].sum())).astype(np.float32))
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(gram, pa.list_(pa.int32())), pa.array(share, pa.list_(pa.float32()))], names=["lang", "gram", "share"])


def margins(rows: np.ndarray, n: int, at: np.ndarray, share: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """What each bit's classifier says of each of ``n`` texts."""
    return bias + np.stack([np.bincount(rows, share * w[at], n) for w in weights.T], axis=1) if len(bias) else np.zeros((n, 0))


def fit(lang: np.ndarray, rows: np.ndarray, at: np.ndarray, share: np.ndarray, code: np.ndarray, *, steps: int = 80, rate: float = 0.1, l2: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of all bits. Texts of each language count the same together; ``share`` is already scaled."""
    n, bits = len(lang), code.shape[1]
    used, place = np.unique(at, return_inverse=True)
    sign, weight = code[lang].astype(np.float64), (1 / np.bincount(lang, minlength=len(code))[lang])[:, None] / len(code)
    w = np.zeros((len(used) + 1, bits))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        m = margins(rows, n, place, share, w[:-1], w[-1])
        part = -sign * weight / (1 + np.exp(np.clip(sign * m, -30, 30)))
        slope = np.stack([np.append(np.bincount(place, share * p[rows], len(used)), p.sum()) for p in part.T], axis=1)
        slope[:-1] += l2 * w[:-1]
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope * slope
        w -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-12)
    out = np.zeros((1 << BITS, bits), np.float32)
    out[used] = w[:-1]
    return out, w[-1]


def train(docs: DataFrame, *, sample: int = 1200) -> Model:
    """Fit on about ``sample`` texts of ``docs`` (doc_id, text, lang) in all, as many of each language, drawn by a hash of their ids.

    Every non-null language is learnt, so their number is taken to be bounded; of a
    rare one all texts are taken. Without any the model knows no language.
    """
    docs = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    languages = sorted(counts)
    code = codewords(len(languages))
    nothing = Model(languages, code, np.zeros((1 << BITS, code.shape[1]), np.float32), np.zeros(code.shape[1]), np.full(code.shape, 1 / max(1, code.shape[1])))
    if len(languages) < 2:
        return nothing
    each, parts = max(20, sample // len(languages)), 1_000_000
    least = F.lit(0)
    for name in languages:
        least = F.when(F.col("lang") == name, int(parts * min(1, each / counts[name])) + 1).otherwise(least)
    drawn = docs.where(F.pmod(F.coalesce(F.xxhash64("doc_id"), F.lit(0)), F.lit(parts)) < least)
    rows = drawn.select("text", "lang").mapInArrow(_shares, "lang string, gram array<int>, share array<float>").toArrow()
    if not rows.num_rows:
        return nothing
    gram, share = rows.column("gram").combine_chunks(), rows.column("share").combine_chunks()
    order = {name: i for i, name in enumerate(languages)}
    lang = np.array([order[x] for x in rows.column("lang").to_pylist()])
    of = np.repeat(np.arange(len(lang)), gram.value_lengths().to_numpy(zero_copy_only=False))
    at, value = gram.flatten().to_numpy(), share.flatten().to_numpy().astype(np.float64) * _SCALE
    weights, bias = fit(lang, of, at, value, code)
    right = margins(of, len(lang), at, value, weights, bias) * code[lang] > 0
    trust = np.stack([right[lang == i].mean(axis=0) if (lang == i).any() else np.ones(code.shape[1]) for i in range(len(languages))])
    return Model(languages, code, weights, bias, trust / np.maximum(trust.sum(axis=1, keepdims=True), 1e-9))


def losses(m: np.ndarray, model: Model) -> np.ndarray:
    """The weighted logistic loss of each text's margins against each codeword."""
    return np.stack([(np.logaddexp(0, -m * word) * trust).sum(axis=1) for word, trust in zip(model.code, model.trust, strict=True)], axis=1)


def decode(m: np.ndarray, model: Model, *, near: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each text the nearest codeword, the next, the share of the nearest (0 to 1), and whether the two are apart by less than ``near`` of the mean loss of all."""
    loss = losses(m, model)
    if loss.shape[1] == 1:
        zero = np.zeros(len(loss), np.int64)
        return zero, zero, np.ones(len(loss)), np.zeros(len(loss), bool)
    order = np.argsort(loss, axis=1, kind="stable")
    best, next_ = order[:, 0], order[:, 1]
    i = np.arange(len(loss))
    odds = np.exp(-m.shape[1] * (loss - loss[i, best][:, None]))
    return best, next_, 1 / odds.sum(axis=1), loss[i, next_] - loss[i, best] < near * loss.mean(axis=1)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous and runner_up of every row of ``docs`` (doc_id, text).

    A null text or one without a letter, and any where no language was learnt, is
    ``und`` with score 0 and flagged; its runner-up is null, as is that of an only language.
    """
    schema = "doc_id long, lang_pred string, score double, ambiguous boolean, runner_up string"
    names = np.array([*model.languages, UNKNOWN], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for n, has, doc, number in grams(batch.column("text").to_pylist()):
                if len(model.languages):
                    share = _SCALE / np.maximum(1, np.bincount(doc, minlength=n))[doc]
                    best, next_, score, near = decode(margins(doc, n, number, share, model.weights, model.bias), model)
                else:
                    has, best, next_, score, near = np.zeros(n, bool), *np.zeros((2, n), np.int64), np.zeros(n), np.ones(n, bool)
                told = np.where(has, names[best], UNKNOWN)
                other = np.where(has & (best != next_), names[next_], None)
                for x, column in zip((told, np.where(has, score, 0.0), near | ~has, other), out, strict=True):
                    column.extend(x.tolist())
            types = (pa.string(), pa.float64(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], names=["doc_id", "lang_pred", "score", "ambiguous", "runner_up"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def identify(docs: DataFrame, **fit_) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous and runner_up of every row of ``docs`` (doc_id, text, lang).

    Languages are learnt only from rows that aren't held out; lang, source and
    doc_id are not read for a prediction. Repeated rows get equal predictions, a null id is not
    held out, an empty table gives an empty result; other columns are ignored.
    """
    model = train(docs.where(~held_out(F.col("doc_id"))), **fit_)
    out = predict(docs, model).withColumn("held_out", held_out(F.col("doc_id")))
    return out.select("doc_id", "held_out", "lang_pred", "score", "ambiguous", "runner_up")
