"""Token counts under edits (operator 3).

A document keeps its pre-tokens in leaves of about ``leaf`` pre-tokens under a
segment tree of characters and token counts. An edit re-encodes the leaves it
touches, one leaf of context before them, and as many after them as it takes for
the pre-token boundaries to fall together again; sums change along the paths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billforge.llm.packing import BpeEncoder
from billforge.llm.text import blocks, slices, text_buffer


class Counter:
    """Pre-tokens and token counts of texts."""

    def __init__(self, tokenizer_path: str):
        import regex
        from public_tokenizers import PATTERN

        self.bpe = BpeEncoder(tokenizer_path)
        self.pieces = regex.compile(PATTERN).findall
        added = [t.decode() for t in self.bpe.special]
        self.reach = max(map(len, added), default=0)  # characters that an added token may take
        self.apart = regex.compile("(" + "|".join(map(regex.escape, added)) + ")").split if added else lambda text: [text]

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a text; each added token is one."""
        parts = self.apart(text)
        return [p for k, part in enumerate(parts) for p in ([part] if k % 2 else self.pieces(part))]

    def counts(self, parts: list[bytes]) -> list[int]:
        return [len(x) for x in self.bpe.of_words(parts)]

    def leaves(self, column: pa.Array, leaf: int) -> Iterator[list[tuple[bytes, int]]]:
        """Of each text the leaves: bytes and token count; null reads as empty."""
        data, offsets = text_buffer(column)
        for i, j in blocks(offsets, 4 << 20):
            part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            begin, words = self.bpe.pieces(part, own)
            n = np.array(self.counts(words.dictionary.to_pylist()) or [0])[words.indices.to_numpy()]
            total = np.r_[0, np.cumsum(n)]
            easy = self.bpe.easy(part, own)
            first = np.searchsorted(begin, own)
            for d in range(j - i):
                if easy[d]:
                    at = np.r_[np.arange(first[d], first[d + 1], leaf), first[d + 1]]
                    cuts = np.r_[begin[at[:-1]], own[d + 1]]
                    yield [(part[a:b].tobytes(), int(total[q] - total[p])) for a, b, p, q in zip(cuts, cuts[1:], at, at[1:], strict=False)]
                else:
                    yield self.leaves_of(part[own[d] : own[d + 1]].tobytes().decode(), leaf)

    def leaves_of(self, text: str, leaf: int) -> list[tuple[bytes, int]]:
        parts = [p.encode() for p in self.split(text)]
        n = self.counts(parts)
        return [(b"".join(parts[i : i + leaf]), sum(n[i : i + leaf])) for i in range(0, len(parts), leaf)]


class TokenTree:
    """One document's leaves under a binary tree of (characters, tokens)."""

    def __init__(self, leaves: list[tuple[bytes, int]], counter: Counter, leaf: int = 64):
        self.counter, self.leaf = counter, leaf
        self._build(leaves)

    def _build(self, leaves: list[tuple[bytes, int]]) -> None:
        self.texts = [t for t, _ in leaves] or [b""]
        self.size = 1 << (len(self.texts) - 1).bit_length()
        self.sums = np.zeros((2 * self.size, 2), np.int64)
        for i, t in enumerate(self.texts):
            self.sums[self.size + i] = len(t.decode()), leaves[i][1] if leaves else 0
        for i in range(self.size - 1, 0, -1):
            self.sums[i] = self.sums[2 * i] + self.sums[2 * i + 1]

    @property
    def chars(self) -> int:
        return int(self.sums[1][0])

    @property
    def tokens(self) -> int:
        return int(self.sums[1][1])

    def _find(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character and the characters before that leaf; the last leaf from the end on."""
        if char >= self.chars:
            node = 1
            while node < self.size:
                node = 2 * node + int(self.sums[2 * node + 1][0] > 0)
            return node - self.size, self.chars - int(self.sums[node][0])
        node, before = 1, 0
        while node < self.size:
            left = int(self.sums[2 * node][0])
            node *= 2
            if char - before >= left:
                before += left
                node += 1
        return node - self.size, before

    def _set(self, i: int, text: bytes, tokens: int) -> None:
        self.texts[i] = text
        node = self.size + i
        change = np.array([len(text.decode()), tokens]) - self.sums[node]
        while node:
            self.sums[node] += change
            node //= 2

    def edit(self, start: int, length: int, insert: str) -> int:
        """Replace ``length`` characters from ``start`` (both cut to the text); the characters encoded anew."""
        start = min(max(start, 0), self.chars)
        end = min(start + max(length, 0), self.chars)
        first, before = self._find(start)
        last, _ = self._find(max(start, end - 1))
        room = 0
        while first and (not room or room < self.counter.reach):  # a leaf of context, and enough for an added token
            first -= 1
            room += int(self.sums[self.size + first][0])
        before -= room
        old = b"".join(self.texts[first : last + 1]).decode()
        new = old[: start - before] + insert + old[end - before :]
        done = last
        while True:
            ahead = done + 1
            while ahead < len(self.texts) and not self.texts[ahead]:
                ahead += 1
            if ahead >= len(self.texts):
                parts = self.counter.split(new)
                break
            # a boundary of the text and the leaf ahead, where the leaf begins, lets the rest stand
            parts, at = [], 0
            after, more = self.texts[ahead].decode(), ahead + 1
            while len(after) < self.counter.reach and more < len(self.texts):
                after += self.texts[more].decode()
                more += 1
            for p in self.counter.split(new + after):
                if at >= len(new):
                    break
                parts.append(p)
                at += len(p)
            if at == len(new):
                break
            new += self.texts[ahead].decode()
            done = ahead
        parts = [p.encode() for p in parts]
        counts = self.counter.counts(parts)
        room = done - first + 1
        if len(parts) > 4 * self.leaf * room:
            kept = [(t, int(self.sums[self.size + k][1])) for k, t in enumerate(self.texts)]
            fresh = [(b"".join(parts[k : k + self.leaf]), sum(counts[k : k + self.leaf])) for k in range(0, len(parts), self.leaf)]
            self._build([x for x in [*kept[:first], *fresh, *kept[done + 1 :]] if x[0]])
        else:
            step = max(1, -(-len(parts) // room))
            for k in range(room):
                own = slice(k * step, (k + 1) * step)
                self._set(first + k, b"".join(parts[own]), sum(counts[own]))
        return len(new)

    def text(self) -> str:
        return b"".join(self.texts).decode()


def count_edits(docs: DataFrame, tokenizer_path: str, *, leaf: int = 64) -> DataFrame:
    """doc_id, edit (0: before any), n_chars, n_tokens and n_encoded (characters encoded for it) after each edit.

    ``docs`` has doc_id, text and edits, an array of structs (start, length,
    insert) in code points that apply in order, each to the text that the one
    before left. A null text reads as empty, null edits as none, a null insert as
    empty and a null start or length as 0. Every row stands for itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer_path)
        for part in slices(batches):
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc, leaves, edits in zip(part.column("doc_id").to_pylist(), counter.leaves(part.column("text"), leaf), part.column("edits").to_pylist(), strict=True):
                tree = TokenTree(leaves, counter, leaf)
                for k, e in enumerate([None, *(edits or [])]):
                    n = tree.edit(e["start"] or 0, e["length"] or 0, e["insert"] or "") if e else tree.chars if not k else 0
                    for column, v in zip(rows, (doc, k, tree.chars, tree.tokens, n), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "edit", "n_chars", "n_tokens", "n_encoded"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "edits")
    return docs.mapInArrow(run, "doc_id long, edit int, n_chars long, n_tokens long, n_encoded long")
