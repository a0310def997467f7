"""Runs of characters in many texts at once, by array operations on their bytes.

A slab is a bounded number of texts, concatenated as UTF-8. Words or terms are maximal runs of bytes of a class;
since classes take all bytes from 128 on or leave them out together, runs of bytes are runs of characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of a slab; a longer text is a slab of its own.
SLAB = 1 << 21


def byte_class(members: bytes) -> np.ndarray:
    """A table of 256 truths."""
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


SPACE = byte_class(b" \t\n\x0b\x0c\r")
#: What words consist of: all but white space.
WORD = ~SPACE
#: The first byte of a character.
STARTS = ~byte_class(bytes(range(0x80, 0xC0)))


@dataclass
class Slab:
    """Texts ``first`` and following of a column: their bytes, and where each begins, the end last."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def total(self, flags: np.ndarray) -> np.ndarray:
        """Sum over each text of a number for every byte."""
        upto = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return upto[self.offsets[1:]] - upto[self.offsets[:-1]]

    def text_of(self, places: np.ndarray) -> np.ndarray:
        """The text to which each byte belongs."""
        return np.searchsorted(self.offsets, places, side="right") - 1

    def heads(self) -> np.ndarray:
        """True at the first byte of every text that has one."""
        out = np.zeros(len(self.data), bool)
        at = self.offsets[:-1]
        out[at[at < len(out)]] = True
        return out


def slabs(column: pa.Array, most: int = SLAB) -> Iterator[Slab]:
    """The texts of a string column, null ones as empty, in slabs of at most ``most`` bytes or one text."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield Slab(at, data[offsets[at] : offsets[upto]], offsets[at : upto + 1] - offsets[at])
        at = upto


def packed(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Strings of the given lengths, one behind the other in ``data``."""
    offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


@dataclass
class Runs:
    """Runs in order: the text of each, its first byte, its number among the different ones, and these."""

    text: np.ndarray
    start: np.ndarray
    code: np.ndarray
    distinct: pa.Array


def runs(slab: Slab, members: np.ndarray) -> Runs:
    """All maximal runs of bytes of the class ``members``; none goes from one text into the next."""
    inside, heads = members[slab.data], slab.heads()
    start = np.flatnonzero(inside & (heads | ~np.concatenate([[False], inside[:-1]])))
    stop = np.flatnonzero(inside & np.concatenate([heads[1:] | ~inside[1:], [True]])[: len(inside)]) + 1
    found = packed(slab.data[inside], stop - start).dictionary_encode()
    return Runs(slab.text_of(start), start, found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary)
