"""SentencePiece-style unigram encoding and decoding (operator 5).

Pieces with log scores lie in a double-array trie over bytes; a space is the
whitespace marker. Viterbi takes the segmentation with the largest total score;
a character that no piece covers becomes its UTF-8 bytes. The steps run for all
distinct words of a block at once. A text gets one marker in front, which decoding
takes off again, so that decoding returns the text exactly.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from billforge.llm.text import blocks, slices, text_buffer

MARKER = "▁"
_STRETCH = 512
_UNKNOWN = 10.0  # below the smallest score, as in the public implementation


@dataclass
class DoubleArray:
    """``base[s] + c + 1`` is the child of state s by byte c where ``check`` there is s; ``value`` is a piece's id or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @classmethod
    def build(cls, keys: list[tuple[bytes, int]]) -> DoubleArray:
        keys = sorted(keys)
        size = 1 << 12
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        check[0] = 0
        free = 1
        queue, hints = [(0, 0, len(keys), 0)], {}
        for state, a, b, depth in queue:  # grows while it is read
            if len(keys[a][0]) == depth:
                value[state] = keys[a][1]
                a += 1
            children, begin = [], a
            for i in range(a, b + 1):
                if i == b or i > begin and keys[i][0][depth] != keys[begin][0][depth]:
                    if i > begin:
                        children.append((keys[begin][0][depth], begin, i))
                    begin = i
            if not children:
                continue
            codes = [c[0] + 1 for c in children]
            at = max(free, codes[0] + 1, hints.get(len(codes), 0) - _STRETCH // 4)
            while True:  # the first place where all children are free, many places at once
                while at + _STRETCH + 257 >= len(base):
                    base, check, value = (np.concatenate([x, np.full(len(x), f, np.int32)]) for x, f in ((base, 0), (check, -1), (value, -1)))
                fits = check[at : at + _STRETCH] < 0
                for c in codes[1:]:
                    fits &= check[at + c - codes[0] : at + c - codes[0] + _STRETCH] < 0
                k = int(fits.argmax())
                at += k
                if fits[k]:
                    break
                at += _STRETCH
            hints[len(codes)] = at
            base[state] = at - codes[0]
            for c in codes:
                check[base[state] + c] = state
            while check[free] >= 0:
                free += 1
            queue += [(int(base[state]) + c + 1, i, j, depth + 1) for c, i, j in children]
        return cls(base, check, value)


@dataclass
class Unigram:
    """Pieces by id with log scores; ``byte_ids`` are the ids of the 256 byte pieces."""

    pieces: list[str]
    scores: np.ndarray
    byte_ids: np.ndarray

    @classmethod
    def from_model(cls, path: str) -> Unigram:
        """The pieces of a public model file; where its scores are merge ranks, the log of the rank by Zipf's law."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        pieces = [m.id_to_piece(i) for i in range(n)]
        given = [m.get_score(i) for i in range(n)]
        ranks = all(s == int(s) for s in given)
        scores = np.array([-math.log(2 - s) if ranks else s for s in given])
        byte_ids = np.array([m.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        plain = [not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i)) for i in range(n)]
        return cls([p if ok else "" for p, ok in zip(pieces, plain, strict=True)], scores, byte_ids)

    def __post_init__(self) -> None:
        self.known = [i for i, p in enumerate(self.pieces) if p]
        self.unknown = float(self.scores[self.known].min()) - _UNKNOWN
        self.apart = not any(re.search(f"[^{MARKER}]{MARKER}", self.pieces[i]) for i in self.known)
        self.trie = DoubleArray.build([(self.pieces[i].replace(MARKER, " ").encode(), i) for i in self.known])
        as_bytes = [p.replace(MARKER, " ").encode() for p in self.pieces]
        for b, i in enumerate(self.byte_ids):
            as_bytes[i] = bytes([b])
        self.as_bytes = pa.array(as_bytes, pa.binary())

    def _best(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word; words are padded to one length."""
        n, longest = len(words), max(map(len, words))
        text = np.zeros((longest + 1, n), np.uint8)
        size = np.array([len(w) for w in words])
        flat = np.frombuffer(b"".join(words), np.uint8)
        text[np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size), np.repeat(np.arange(n), size)] = flat
        best = np.full((longest + 1, n), -np.inf)
        best[0] = 0
        back, piece = np.zeros((longest + 1, n), np.int32), np.full((longest + 1, n), -1, np.int32)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for i in range(longest):
            open_ = np.flatnonzero((i < size) & (best[i] > -np.inf))
            if not len(open_):
                continue
            lead = text[i, open_]
            to = i + np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
            score = best[i, open_] + self.unknown
            better = score > best[to, open_]
            best[to[better], open_[better]] = score[better]
            back[to[better], open_[better]], piece[to[better], open_[better]] = i, -1
            state, j = np.zeros(len(open_), np.int64), i
            while len(open_) and j < longest:
                state_next = base[state] + text[j, open_].astype(np.int64) + 1
                stays = (check[state_next] == state) & (j < size[open_])
                open_, state = open_[stays], state_next[stays]
                j += 1
                v = value[state]
                done = np.flatnonzero(v >= 0)
                at = open_[done]
                score = best[i, at] + self.scores[v[done]]
                better = score > best[j, at]
                at = at[better]
                best[j, at], back[j, at], piece[j, at] = score[better], i, v[done][better]
        out = []
        for w, k in enumerate(size.tolist()):
            ids: list[int] = []
            while k:
                a, p = int(back[k, w]), int(piece[k, w])
                ids += [p] if p >= 0 else self.byte_ids[np.frombuffer(words[w][a:k], np.uint8)][::-1].tolist()
                k = a
            out.append(np.array(ids[::-1], np.uint32))
        return out

    def of_words(self, words: list[bytes]) -> list[np.ndarray]:
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(words)
        begin = 0
        while begin < len(order):
            end = begin + 1
            while end < len(order) and (end - begin + 1) * (len(words[order[end]]) + 1) <= 1 << 20:
                end += 1
            for i, ids in zip(order[begin:end], self._best([words[i] for i in order[begin:end]]), strict=True):
                out[i] = ids
            begin = end
        return out

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """uint32 ids of each text; null reads as empty, and an empty text has no ids."""
        data, offsets = text_buffer(column)
        for i, j in blocks(offsets, 4 << 20):
            own = offsets[i : j + 1] - offsets[i]
            some = np.flatnonzero(np.diff(own) > 0)
            part = np.insert(data[offsets[i] : offsets[j]], own[some], 32)  # the marker in front
            own = own + np.r_[0, np.cumsum(np.diff(own) > 0)]
            begin = np.zeros(len(part), bool)
            if self.apart and len(part):
                begin = part == 32
                begin[1:] &= part[:-1] != 32
            begin[own[:-1][np.diff(own) > 0]] = True
            begin = np.flatnonzero(begin)
            words = pa.BinaryArray.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(np.r_[begin, len(part)].astype(np.int32)), pa.py_buffer(part)]).dictionary_encode()
            ids = self.of_words(words.dictionary.to_pylist())
            lens = np.array([len(x) for x in ids], np.int64)
            flat = np.concatenate([np.zeros(0, np.uint32), *ids])
            codes = words.indices.to_numpy()
            n = lens[codes]
            end = np.r_[0, np.cumsum(n)]
            tokens = flat[np.repeat((np.cumsum(lens) - lens)[codes] - end[:-1], n) + np.arange(end[-1])]
            first = end[np.searchsorted(begin, own)]
            for d in range(j - i):
                yield tokens[first[d] : first[d + 1]]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``ids`` without the marker in front."""
        taken = self.as_bytes.take(pa.array(ids))
        data = taken.buffers()[2]
        return data.to_pybytes()[1 : np.frombuffer(taken.buffers()[1], np.int32)[len(taken)]].decode() if len(taken) else ""


def encode(docs: DataFrame, model: Unigram) -> DataFrame:
    """``docs`` with n_tokens, n_byte_tokens and ids (little-endian uint32) in place of ``text`` and of columns so named.

    A word of n bytes takes n steps, shared by all words of its length in a block.
    Null and empty texts have no ids; every row yields one, other columns stay.
    """
    keep = [c for c in docs.columns if c not in ("text", "n_tokens", "n_byte_tokens", "ids")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_byte = np.zeros(len(model.pieces), bool)
        is_byte[model.byte_ids] = True
        for part in slices(batches, 1000):
            ids = list(model.encode(part.column("text")))
            columns = [pa.array([len(x) for x in ids], pa.int64()), pa.array([int(is_byte[x].sum()) for x in ids], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *columns], names=[*keep, "n_tokens", "n_byte_tokens", "ids"])

    kinds = (("n_tokens", T.LongType()), ("n_byte_tokens", T.LongType()), ("ids", T.BinaryType()))
    return docs.mapInArrow(run, T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(n, k) for n, k in kinds)]))


def decode(encoded: DataFrame, model: Unigram) -> DataFrame:
    """``encoded`` (with ids) with its text, in place of a column so named; null ids give a null text."""
    encoded = encoded.drop("text")
    names = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1000):
            texts = []
            for ids in part.column("ids").to_pylist():
                if ids is None:
                    texts.append(None)
                    continue
                texts.append(model.decode(np.frombuffer(ids, "<u4")))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(texts, pa.string())], names=[*names, "text"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("text", T.StringType())]))
