"""Personal data by rules and by a character BiLSTM-CRF (operator 8).

Rules find emails, IP addresses, card and phone numbers. The tagger is trained on
windows around every digit, at sign, equals sign with the word after it, and long
run of capitals, where each labelled kind begins, and on some other windows. It
reads overlapping windows over the whole of every text, whatever stands there.
Spans of all windows of a text are reconciled by one
choice of non-overlapping spans with the largest total weight. Rule spans stay;
tagged secrets and emails that touch none of them are added (a number that the
rules turn down is no card, phone or IP). Offsets are code points.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from billforge.llm.bilstm_crf import BiLstmCrf
from billforge.llm.shared import quoted
from billforge.llm.text import slices

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
WINDOW, STRIDE, MARGIN = 128, 64, 48
PLAIN = 32  # one in so many windows is learnt from although nothing in it looks like personal data
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"[0-9@]|=[ \"]{0,2}[0-9A-Za-z]*|[A-Z]{8}")
#: Patterns of the labels for the kind that no rule finds in the result.
_SECRET = re.compile(r"AKIA[0-9A-Z]{16}|password=[0-9A-Za-z]{8,}|token = \"[0-9a-f]{40}\"")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Rule matches, leftmost and non-overlapping within a kind, by start and kind."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return ordered(out)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def labelled(text: str) -> list[Span]:
    """Spans that the tagger learns from: rule matches, and secrets by their patterns."""
    return ordered([*base_spans(text), *(("secret", *m.span()) for m in _SECRET.finditer(text))])


def _codes(text: str) -> np.ndarray:
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 128).astype(np.uint8)


def window_starts(text: str) -> list[int]:
    """Starts of the windows, multiples of ``STRIDE``, that hold a position of a trigger or its surroundings.

    Each such position is in two windows, or in one in the first ``STRIDE`` characters.
    """
    starts: set[int] = set()
    end = 0
    for m in _TRIGGER.finditer(text):
        a, b = max(end, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if a < b:
            starts.update(range(max(0, a // STRIDE - 1) * STRIDE, b, STRIDE))
            end = b
    return sorted(starts)


def all_starts(text: str) -> list[int]:
    """Starts of windows over the whole text: each character but the first and last ``STRIDE`` is in two."""
    return list(range(0, max(len(text) - STRIDE, min(len(text), 1)), STRIDE))


def _windows(codes: np.ndarray, starts: list[int]) -> np.ndarray:
    out = np.zeros((len(starts), WINDOW), np.uint8)
    for i, s in enumerate(starts):
        part = codes[s : s + WINDOW]
        out[i, : len(part)] = part
    return out


def _training_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        ids, ats, xs, ys = [], [], [], []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            held = window_starts(text or "")
            starts = sorted({*held, *(s for s in all_starts(text or "") if s // STRIDE % PLAIN == (doc or 0) % PLAIN)})
            if held:
                tags = np.zeros(len(text), np.uint8)
                for kind, a, b in labelled(text):
                    if not tags[a:b].any():
                        tags[a:b] = 2 * KINDS.index(kind) + 2
                        tags[a] -= 1
                ids += [doc] * len(starts)
                ats += starts
                xs += [w.tobytes() for w in _windows(_codes(text), starts)]
                ys += [w.tobytes() for w in _windows(tags, starts)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ats, pa.int64()), pa.array(xs, pa.binary()), pa.array(ys, pa.binary())], names=["doc_id", "at", "x", "y"])


def train(docs: DataFrame, *, most_docs: int = 3000, most_windows: int = 8000, steps: int = 300) -> BiLstmCrf | None:
    """A tagger from at most about ``most_docs`` texts that hold a trigger, chosen by a hash of doc_id.

    Windows of one text overlap; at most ``most_windows`` are used, chosen by a
    hash of doc_id and position. None where no text has a labelled span.
    """
    docs = docs.select("doc_id", "text").where(F.col("text").rlike("[0-9@=]|[A-Z]{8}"))
    n = docs.count()
    if not n:
        return None
    part = 1_000_000
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(part)) < int(part * min(1, most_docs / n)))
    rows = some.mapInArrow(_training_windows, "doc_id long, at long, x binary, y binary").orderBy(F.xxhash64("doc_id", "at"), "doc_id", "at").limit(most_windows).collect()
    rows.sort(key=lambda r: (r["doc_id"] or 0, r["x"]))
    if not rows:
        return None
    x = np.frombuffer(b"".join(r["x"] for r in rows), np.uint8).reshape(-1, WINDOW).astype(np.int64)
    y = np.frombuffer(b"".join(r["y"] for r in rows), np.uint8).reshape(-1, WINDOW).astype(np.int64)
    if not y.any():
        return None
    model = BiLstmCrf(2 * len(KINDS) + 1)
    model.fit(x, y, steps=steps)
    return model


def _tagged(starts: list[int], tags: np.ndarray, size: int) -> list[tuple[float, Span]]:
    """Spans of a text's windows; one cut off by its window's edge weighs half."""
    out = []
    hit = np.flatnonzero(tags.any(1)) if len(tags) else ()
    for s, row in ((starts[i], tags[i]) for i in hit):
        at = 0
        n = min(WINDOW, size - s)
        while at < n:
            t = int(row[at])
            if t == 0:
                at += 1
                continue
            kind, end = (t - 1) // 2, at + 1
            while end < n and row[end] == 2 * kind + 2:
                end += 1
            whole = (at > 0 or s == 0) and (end < WINDOW or s + end == size)
            out.append(((end - at) * (1.0 if whole else 0.5), (KINDS[kind], s + at, s + end)))
            at = end
    return out


def reconcile(found: list[tuple[float, Span]]) -> list[Span]:
    """The non-overlapping spans of the largest total weight; equal spans of several windows add up."""
    weights: dict[Span, float] = {}
    for w, s in found:
        weights[s] = weights.get(s, 0) + w
    spans = sorted(weights, key=lambda s: (s[2], s[1], s[0]))
    ends = [s[2] for s in spans]
    best = [0.0] * (len(spans) + 1)
    take = []
    for i, s in enumerate(spans):
        before = bisect.bisect_right(ends, s[1], 0, i)
        with_it = best[before] + weights[s]
        take.append(before if with_it > best[i] else -1)
        best[i + 1] = max(with_it, best[i])
    out, i = [], len(spans)
    while i:
        if take[i - 1] >= 0:
            out.append(spans[i - 1])
            i = take[i - 1]
        else:
            i -= 1
    return ordered(out)


def added(tagged: list[Span], base: list[Span]) -> list[Span]:
    """The tagged spans of six characters or more that touch no rule span.

    A card, phone or IP number that the rules turn down is none, whatever its context.
    """
    zones: list[list[int]] = []
    for _, a, b in base:
        if zones and a <= zones[-1][1]:
            zones[-1][1] = max(zones[-1][1], b)
        else:
            zones.append([a, b])
    starts = [a for a, _ in zones]
    out = []
    for kind, a, b in tagged:
        i = bisect.bisect_left(starts, b)
        if b - a >= 6 and kind in ("email", "secret") and not (i and zones[i - 1][1] > a):
            out.append((kind, a, b))
    return out


def all_spans(texts: list[str], model: BiLstmCrf | None) -> list[tuple[list[Span], list[Span]]]:
    """Of each text the rule spans, and these together with the tagged ones."""
    starts = [all_starts(t) if model else [] for t in texts]
    tags = np.zeros((0, WINDOW), np.int8)
    if any(starts):
        tags = model.decode(np.concatenate([_windows(_codes(t), s) for t, s in zip(texts, starts, strict=True) if s]))
    out, at = [], 0
    for text, own in zip(texts, starts, strict=True):
        base = base_spans(text)
        extra = reconcile(_tagged(own, tags[at : at + len(own)], len(text)))
        at += len(own)
        out.append((base, ordered([*base, *added(extra, base)])))
    return out


def find(docs: DataFrame, model: BiLstmCrf | None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of ``docs`` (doc_id, text).

    Every row yields one; a null text has no spans, as an empty one, and a null
    doc_id stays null. Other columns are ignored; an empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000):
            rows = all_spans([t or "" for t in batch.column("text").to_pylist()], model)
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in rows], pa.int64()) for k in BASE]
            digest = pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in rows])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, digest, pa.array([written(every) for _, every in rows])], names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, model: BiLstmCrf | None) -> DataFrame:
    """``docs`` with all spans in ``text`` masked; null texts stay null, columns may have any names."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000):
            row = batch.column("row")
            columns = [row.field(i) for i in range(row.type.num_fields)]
            texts = columns[at].to_pylist()
            spans = all_spans([t or "" for t in texts], model)
            columns[at] = pa.array([None if t is None else masked(t, every) for t, (_, every) in zip(texts, spans, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(columns, fields=list(row.type))], names=["row"])

    kind = T.StructType(docs.schema.fields)
    return docs.select(F.struct(*quoted(docs)).alias("row")).mapInArrow(run, T.StructType([T.StructField("row", kind)])).select("row.*")
