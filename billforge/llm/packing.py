"""Sum-of-squares best-fit packing of tokenized documents (operator 1).

Documents become token ids, end with the end id, and are cut into pieces of
``capacity`` ids only where they are longer; the first piece takes the remainder.
A piece goes where the sum of the squared counts of open sequences per residual
gap becomes smallest, a new sequence being one choice. Pieces are dealt by hash
into groups of bounded size that are packed side by side.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from billforge.llm import pretokens
from billforge.llm.text import blocks, text_buffer


class BpeEncoder:
    """Token ids of texts; distinct pre-tokens of a block are encoded once."""

    def __init__(self, tokenizer_path: str, most: int = 200_000):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer_path)
        #: added tokens are found in a text before it is split
        self.special = {t.content.encode(): i for i, t in self.whole.get_added_tokens_decoder().items()}
        with open(tokenizer_path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.word = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[bytes, list[int]] = {}
        self.most = most

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.DictionaryArray]:
        """Starts of the pre-tokens, and the pre-tokens as a dictionary array."""
        begin = pretokens.starts(data, offsets)
        bounds = np.r_[begin, len(data)].astype(np.int32)
        words = pa.BinaryArray.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
        return begin, words.dictionary_encode()

    def of_words(self, words: list[bytes]) -> list[list[int]]:
        known, encode = self.known, self.word._encode_single_piece
        if len(known) > self.most:
            known.clear()
        out = []
        for w in words:
            ids = known.get(w)
            if ids is None:
                ids = [self.special[w]] if w in self.special else encode(w)
                known[w] = ids
            out.append(ids)
        return out

    def easy(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether each document can be split on its bytes: it has known characters alone and no added token."""
        out = pretokens.plain(data, offsets)
        raw = data.tobytes()
        for token in self.special:
            at = raw.find(token)
            while at >= 0:
                out[np.searchsorted(offsets, at, "right") - 1] = False
                at = raw.find(token, at + 1)
        return out

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """uint32 ids of each text in order; null reads as empty."""
        data, offsets = text_buffer(column)
        for i, j in blocks(offsets, 4 << 20):
            part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            begin, words = self.pieces(part, own)
            ids = self.of_words(words.dictionary.to_pylist())
            lens = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(lens.sum()))
            at = np.cumsum(lens) - lens
            codes = words.indices.to_numpy()
            n = lens[codes]
            end = np.r_[0, np.cumsum(n)]
            tokens = flat[np.repeat(at[codes] - end[:-1], n) + np.arange(end[-1])]
            easy = self.easy(part, own)
            first = end[np.searchsorted(begin, own)]
            for d in range(j - i):
                if easy[d]:
                    yield tokens[first[d] : first[d + 1]]
                else:
                    text = part[own[d] : own[d + 1]].tobytes().decode()
                    yield np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)


def tokenize(docs: DataFrame, tokenizer_path: str, *, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian uint32 bytes) of ``docs`` (doc_id, text).

    A null or empty text is the end id alone. Each row is a document, also where
    it repeats another; a null doc_id is kept. An empty table gives no pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = BpeEncoder(tokenizer_path)
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            size = 0
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text")), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                head = len(ids) % capacity or capacity
                cuts = [0, *range(head, len(ids) + 1, capacity)]
                for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for column, x in zip(rows, (doc, p, a, b - a, ids[a:b].tobytes()), strict=True):
                        column.append(x)
                size += ids.nbytes
                if size > 8 << 20:
                    yield _pieces(rows)
                    rows, size = ([], [], [], [], []), 0
            yield _pieces(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def _pieces(rows: tuple[list, ...]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids"])


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each length, placed in descending order of length.

    Of equally good gaps the smallest remainder is taken, and in a gap the
    sequence opened last; full sequences are closed and count no more.
    """
    closing = np.full(capacity + 1, np.inf)  # change of the sum when a gap loses a sequence
    opening = np.ones(capacity + 1)  # change when a gap gains one
    opening[0] = 0
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    count = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[i])
        change = closing[s:] + opening[: capacity + 1 - s]
        rest = int(change.argmin())
        if change[rest] <= opening[capacity - s]:
            gap = rest + s
            k = stacks[gap].pop()
            n = len(stacks[gap])
            closing[gap] = 1 - 2 * n if n else np.inf
            opening[gap] = 2 * n + 1
        else:
            gap, rest, k = capacity, capacity - s, count
            count += 1
        sequence[i], offset[i] = k, capacity - gap
        if rest:
            stacks[rest].append(k)
            n = len(stacks[rest])
            closing[rest], opening[rest] = 1 - 2 * n, 2 * n + 1
    return sequence, offset


def pack(pieces: DataFrame, *, capacity: int = 2048, group_pieces: int = 8192) -> DataFrame:
    """``pieces`` (doc_id, piece, length and any others) with sequence_id and offset, in place of columns so named.

    Nulls in doc_id, piece and other columns are kept; an empty table stays empty.
    ``length`` is between 1 and ``capacity``. Groups hold about ``group_pieces``
    pieces each, whatever the size of the table, and pieces of one document or
    repeated rows spread over the groups by hash, so that none grows with a key.
    """
    pieces = pieces.drop("sequence_id", "offset")
    group = "_g"
    while group in pieces.columns:
        group += "_"
    n = pieces.count()
    groups = max(1, -(-n // group_pieces))
    keyed = pieces.withColumn(group, F.pmod(F.xxhash64("doc_id", "piece", "length", F.monotonically_increasing_id() % 16), F.lit(groups)).cast("int"))
    out = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        sequence, offset = sum_of_squares(table.column("length").to_numpy(), capacity)
        table = table.drop_columns([group])
        table = table.append_column("sequence_id", pa.array(sequence + (key[0].as_py() << 32)))
        return table.append_column("offset", pa.array(offset))

    return keyed.groupBy(group).applyInArrow(run, out)
