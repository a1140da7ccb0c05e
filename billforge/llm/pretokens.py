"""Pre-tokens of the byte-level BPE pattern, found on bytes with numpy inside Spark tasks.

The pattern is ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
Texts of ASCII and of the letters U+00C0-U+023F are split here; a text with any
other character is left to the tokenizer's own splitter (``plain`` is false).
"""

from __future__ import annotations

import numpy as np

_L, _N, _S, _W, _O, _NONE = range(6)
_CLASS = np.full(256, _O, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _L
_CLASS[48:58] = _N
_CLASS[9:14] = _W
_CLASS[32] = _S
_ODD = np.zeros(256, bool)
_ODD[[0xC2, *range(0xC9, 0x100)]] = True


def plain(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each document has only characters that this module can classify."""
    odd = _ODD[data]
    if len(data) > 1:
        odd[:-1] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    return np.diff(np.r_[0, np.cumsum(odd)][offsets]) == 0


def starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First byte of each pre-token; no pre-token crosses a document's bounds."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    kind = _CLASS[data]
    first = offsets[:-1][np.diff(offsets) > 0]
    last = offsets[1:][np.diff(offsets) > 0] - 1
    before, after = np.empty(n, np.uint8), np.empty(n, np.uint8)
    before[1:], after[:-1] = kind[:-1], kind[1:]
    before[first], after[last] = _NONE, _NONE
    space = (kind == _S) | (kind == _W)
    was_space = (before == _S) | (before == _W)
    then_space = (after == _S) | (after == _W) | (after == _NONE)
    begin = np.where(space, ~was_space | ~then_space, (before != kind) & (before != _S))
    quote = np.flatnonzero(begin & (data == 39) & (after == _L))
    if len(quote):
        end = offsets[np.searchsorted(offsets, quote, "right")]
        one = data[quote + 1]
        two = data[np.minimum(quote + 2, n - 1)]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = (quote + 2 < end) & (((two == 101) & ((one == 114) | (one == 118))) | ((one == 108) & (two == 108)))
        for at, size in ((quote[short], 2), (quote[long], 3)):
            begin[at + 1] = False
            stop = at + size
            begin[stop[stop < offsets[np.searchsorted(offsets, at, "right")]]] = True
    return np.flatnonzero(begin)
