"""Word shingles of many texts at once, as sorted 64-bit hashes, with NumPy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed together; the temporary arrays are some 40 times as large.
CHUNK = 1 << 19

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_ODD = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], dtype=_U)


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers whose output bits all depend on all input bits."""
    x = (x ^ (x >> _U(30))) * _ODD[0]
    x = (x ^ (x >> _U(27))) * _ODD[1]
    return x ^ (x >> _U(31))


def _powers(n: int, known: list = [np.ones(1, dtype=_U)]) -> np.ndarray:  # noqa: B006
    while len(known[0]) < n:
        last = known[0]
        known[0] = np.concatenate([last, last * (last[-1:] * _BASE)])
    return known[0]


def _word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in ``data`` and, for each document bound, how many words come before it."""
    inside = (data != 32) & ((data < 9) | (data > 13))
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = bounds[bounds < len(data)]
    first[at] = inside[at]
    counts = np.concatenate([[0], np.cumsum(first)])[bounds]
    letters = data[inside]
    letters = np.where((letters >= 65) & (letters <= 90), letters + 32, letters).astype(_U)
    starts = np.flatnonzero(first[inside])
    if not len(starts):
        return np.zeros(0, dtype=_U), counts
    lengths = np.diff(np.append(starts, len(letters)))
    place = np.arange(len(letters)) - np.repeat(starts, lengths)
    sums = np.add.reduceat((letters + _U(1)) * _powers(int(lengths.max()) + 1)[place], starts)
    return mix(sums + lengths.astype(_U) * _ODD[2]), counts


def of_texts(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingles of ``width`` words, sorted.

    A text with fewer words gives the whole sequence as one, a text without words none.
    """
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, side="right")) - 1)
        words, counts = _word_hashes(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
        runs = max(0, len(words) - width + 1)
        grams = np.zeros(runs, dtype=_U)
        for k in range(width):
            grams += words[k:k + runs] * _ODD[k]
        grams = mix(grams)
        for a, b in zip(counts[:-1], counts[1:]):
            n = int(b - a)
            if n >= width:
                yield np.unique(grams[a:b - width + 1])
            elif n:
                yield mix((words[a:b] * _ODD[:n]).sum(dtype=_U, keepdims=True) + np.array([n], dtype=_U) * _ODD[7])
            else:
                yield np.zeros(0, dtype=_U)
        i = j


def name_of(grams: np.ndarray) -> int:
    """A 64-bit name of a set of shingles."""
    total = mix(grams ^ _ODD[3]).sum(dtype=_U, keepdims=True)
    return int(mix(total + np.array([len(grams)], dtype=_U) * _ODD[4]).view(np.int64)[0])


def parity_bits(grams: np.ndarray, bits: int = 512) -> np.ndarray:
    """Per cell whether an odd number of shingles falls into it, as longs. Two sets differ in at
    least as many shingles as their bits differ."""
    odd = np.bincount((grams & _U(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)
