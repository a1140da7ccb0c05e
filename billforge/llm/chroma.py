"""Chroma audio fingerprints (operator 7).

Recordings become frames of twelve pitch classes. Sixteen filters compare sums of
rectangles of the frames, read off an integral image, and quantise each to two
Gray-coded bits: one packed 32-bit integer for each position. Two recordings are
aligned at the best of all offsets, measured by the share of different bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from billforge.llm.shared import cut
from billforge.llm.text import slices

RATE, FRAME, HOP, CLASSES = 4000, 1024, 256, 12
_HEIGHTS, _WIDTHS = (12, 6, 4, 3), (4, 8, 12, 16)
#: (shape, first class, classes, positions) of each filter: every height with every width, shapes and places in turn.
FILTERS = [(i % 6, (5 * i) % (CLASSES - h + 1), h, w) for i, (h, w) in enumerate((h, w) for h in _HEIGHTS for w in _WIDTHS)]
SPAN = max(_WIDTHS)
_LEVELS = (-0.04, 0.0, 0.04)
_GRAY = np.array([0, 1, 3, 2], np.uint32)


def chroma(samples: np.ndarray) -> np.ndarray:
    """Frames by pitch classes of 16-bit samples at ``RATE``; each frame has length one, or zero in silence."""
    n = (len(samples) - FRAME) // HOP + 1
    if n <= 0:
        return np.zeros((0, CLASSES))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP] * np.hanning(FRAME)
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    hertz = np.fft.rfftfreq(FRAME, 1 / RATE)
    some = (hertz > 60) & (hertz < 1800)
    kind = np.round(CLASSES * np.log2(hertz[some] / 440)).astype(int) % CLASSES
    out = power[:, some] @ np.eye(CLASSES)[kind]
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(size > 1e-9, size, 1)


def fingerprint(frames: np.ndarray) -> np.ndarray:
    """One uint32 for each position with ``SPAN`` frames from it on."""
    n = len(frames) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    integral = np.zeros((len(frames) + 1, CLASSES + 1))
    integral[1:, 1:] = frames.cumsum(0).cumsum(1)
    x = np.arange(n)

    def area(a: int, b: int, c: int, d: int) -> np.ndarray:
        """Sums of positions a to b and classes c to d, from each position on."""
        return integral[x + b, d] - integral[x + a, d] - integral[x + b, c] + integral[x + a, c]

    out = np.zeros(n, np.uint32)
    for shape, c, h, w in FILTERS:
        whole = area(0, w, c, c + h)
        t, v = w // 2, h // 2
        part = (
            lambda: area(0, w, c, c + v),
            lambda: area(0, t, c, c + h),
            lambda: area(0, t, c, c + v) + area(t, w, c + v, c + h),
            lambda: area(0, w, c + h // 3, c + h - h // 3),
            lambda: area(w // 4, w - w // 4, c, c + h),
            lambda: area(t, w, c, c + v) + area(0, t, c + v, c + h),
        )[shape]()
        value = np.log1p(part) - np.log1p(np.maximum(whole - part, 0))
        out = (out << np.uint32(2)) | _GRAY[np.searchsorted(_LEVELS, value)]
    return out


def render(embeddings: DataFrame) -> DataFrame:
    """Recordings (rec_id, pcm) that play the components of ``embeddings`` (vec_id, embedding) as notes.

    A note lasts one hop; its pitch, within two octaves, follows the component's
    share of the largest one. Null and empty vectors give empty recordings, null
    components the middle pitch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out = []
            for v in part.column("embedding").to_pylist():
                x = np.array([0.0 if y is None else y for y in v or []])
                top = np.abs(x).max() if len(x) and np.isfinite(x).all() and np.abs(x).max() > 0 else 1.0
                step = np.clip(np.nan_to_num(np.round(12 * x / top)), -12, 12)
                hertz = np.repeat(440 * 2 ** (step / 12), HOP)
                out.append((8000 * np.sin(2 * np.pi * np.cumsum(hertz) / RATE)).astype("<i2").tobytes())
            yield pa.RecordBatch.from_arrays([part.column("rec_id"), pa.array(out, pa.binary())], names=["rec_id", "pcm"])

    return embeddings.select(F.col("vec_id").cast("long").alias("rec_id"), "embedding").mapInArrow(run, "rec_id long, pcm binary")


def fingerprints(recordings: DataFrame) -> DataFrame:
    """rec_id and fp (packed integers, as array<int>) of ``recordings`` (rec_id, pcm of little-endian 16-bit samples).

    A null or too short pcm gives an empty fp, an odd last byte is left out, a null
    rec_id is kept; every row yields one and other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            fps = [fingerprint(chroma(np.frombuffer((b or b"")[: len(b or b"") // 2 * 2], "<i2"))).view(np.int32) for b in part.column("pcm").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("rec_id"), pa.array(fps, pa.list_(pa.int32()))], names=["rec_id", "fp"])

    return recordings.select(F.col("rec_id").cast("long").alias("rec_id"), "pcm").mapInArrow(run, "rec_id long, fp array<int>")


_FOUND = pa.schema([("q", pa.int64()), ("r", pa.int64()), ("offset", pa.int64()), ("hits", pa.int64()), ("overlap", pa.int64()), ("bit_error", pa.float64())])


def _by_length(rows: list[tuple[int, np.ndarray]], most: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Names, integers and signs of the bits (1 and -1, a row for each recording) of recordings of one length, at most about ``most`` bits at a time."""
    by_size: dict[int, list] = {}
    for row in rows:
        by_size.setdefault(len(row[1]), []).append(row)
    for size, group in by_size.items():
        step = max(1, most // (32 * size))
        for k in range(0, len(group), step):
            x = np.stack([fp for _, fp in group[k : k + step]])
            bits = np.unpackbits(x.astype("<u4").view(np.uint8), axis=1)
            yield np.array([i for i, _ in group[k : k + step]]), x, bits * np.float32(2) - 1


def _align(most_errors: float, least: int):
    """Of each pair in a block the best of all offsets that have ``least`` positions in common and few enough errors.

    Equal bits less different ones are a product of signs, so one product of matrices
    counts them for all pairs at an offset; its whole numbers are exact in floats.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        sides: tuple[list, list] = ([], [])
        for r in table.select(["side", "r", "fp"]).to_pylist():
            sides[r["side"]].append((r["r"], np.array(r["fp"], np.int32).view(np.uint32)))
        out = []
        for names, q, of_q in _by_length(sides[0]):
            for ids, x, of_x in _by_length(sides[1]):
                best, at = np.zeros((len(names), len(ids))), np.zeros((len(names), len(ids)), np.int64)
                other = names[:, None] != ids
                for o in range(least - q.shape[1], x.shape[1] - least + 1):
                    a, b = max(0, -o), max(0, o)
                    n = min(q.shape[1] - a, x.shape[1] - b)
                    if n < least:
                        continue
                    same = of_q[:, 32 * a : 32 * (a + n)] @ of_x[:, 32 * b : 32 * (b + n)].T
                    i, j = np.nonzero(same >= 32 * n * (1 - 2 * most_errors) - 2)
                    bits = (32 * n - same[i, j].astype(np.int64)) // 2 / (32 * n)
                    worth = n * (0.5 - bits)
                    better = (bits <= most_errors) & (worth > best[i, j]) & other[i, j]
                    i, j = i[better], j[better]
                    best[i, j], at[i, j] = worth[better], o
                for i, j in zip(*(v.tolist() for v in np.nonzero(best)), strict=True):
                    o = int(at[i, j])
                    a, b = max(0, -o), max(0, o)
                    n = min(q.shape[1] - a, x.shape[1] - b)
                    differ = q[i, a : a + n] ^ x[j, b : b + n]
                    out.append((int(names[i]), int(ids[j]), o, int((differ == 0).sum()), n, int(np.bitwise_count(differ).sum()) / (32 * n)))
        return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out, strict=True), _FOUND, strict=True)], schema=_FOUND) if out else _FOUND.empty_table()

    return run


def search(prints: DataFrame, *, every: int = 100, most_errors: float = 0.2, least_overlap: int = 16, block: int = 512) -> DataFrame:
    """Alignments of the recordings whose rec_id is divisible by ``every`` with all recordings.

    Recordings with equal fingerprints form a class named after its smallest id,
    and classes are compared once, in blocks of about ``block`` on each side, at
    all offsets; of a pair that with the most overlap and the fewest errors, by
    overlap * (0.5 - bit_error), is told. Rows: rec_id, class_id for each recording with
    a fingerprint, and with them, for each class that a query is in, the matching
    classes: match_id, offset (of the query within the match), hits, overlap and
    bit_error; a recording without a match has nulls there. Only the recording
    that names its class carries matches. Null and too short recordings give no
    rows, repeated rows one; of different fingerprints with one rec_id that of the
    least hash stands for it.
    """
    prints = prints.where("rec_id is not null and size(fp) > 0")
    keyed = prints.select("rec_id", "fp", F.sha2(F.array_join("fp", ",").cast("binary"), 256).alias("k"))
    keyed = keyed.groupBy("rec_id").agg(F.min(F.struct("k", "fp")).alias("x")).select("rec_id", "x.k", "x.fp")
    classes = keyed.groupBy("k").agg(F.min("rec_id").alias("class_id"), F.max(F.col("rec_id") % every == 0).alias("asked"))
    member = cut(keyed.select("rec_id", "k").join(classes, "k").select("rec_id", "class_id", "asked"))
    named = keyed.join(member.where("rec_id = class_id").select("rec_id", "asked"), "rec_id")
    reps = cut(named.select(F.col("rec_id").alias("r"), "fp", "asked"))
    n_q, n_r = reps.agg(F.count(F.when(F.col("asked"), 1)), F.count(F.lit(1))).first()
    lefts, rights = -(-n_q // block) or 1, -(-n_r // block) or 1
    reps = reps.withColumn("lb", F.pmod(F.xxhash64("r"), F.lit(lefts))).withColumn("rb", F.pmod(F.xxhash64(F.lit(1), "r"), F.lit(rights)))
    left = reps.where("asked").withColumn("rb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rights - 1).cast("long")))).withColumn("side", F.lit(0))
    right = reps.withColumn("lb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lefts - 1).cast("long")))).withColumn("side", F.lit(1))
    met = left.unionByName(right).select("lb", "rb", "side", "r", "fp")
    found = met.groupBy("lb", "rb").applyInArrow(_align(most_errors, least_overlap), "q long, r long, offset long, hits long, overlap long, bit_error double")
    found = found.select(F.col("q").alias("rec_id"), F.col("r").alias("match_id"), "offset", "hits", "overlap", "bit_error")
    return member.select("rec_id", "class_id").join(found, "rec_id", "left").select("rec_id", "class_id", "match_id", F.col("offset").cast(T.LongType()).alias("offset"), "hits", "overlap", "bit_error")
