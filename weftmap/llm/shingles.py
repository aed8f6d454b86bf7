"""Sets of word shingles as 64-bit hashes, a batch of texts at a time.

Words are what stands between ``[\\x20\\x09-\\x0D]``, with A-Z in lower case. A word's hash is
the sum of its bytes' random numbers times powers of their places, a shingle's that of its
words' hashes times a constant for each place; both are mixed. All of it is array work over
the batch's bytes. A text of fewer words than a shingle is one shingle, a blank one has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import stretches

#: Bytes of texts worked on at once; a longer text is worked on alone, with some 60 times its size in memory.
BATCH_BYTES = 1 << 18
#: Places of a word with a power of their own.
PLACES = 1 << 12

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True
_NUMBERS = np.random.default_rng(20).integers(1 << 63, 1 << 64, 256, np.uint64) | np.uint64(1)
_NUMBERS[ord("A") : ord("Z") + 1] = _NUMBERS[ord("a") : ord("z") + 1]
_NUMBERS[_SPACE] = 0


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BY_PLACE, _BY_STRETCH = _powers(0x9E3779B97F4A7C15, PLACES), _powers(0xD6E8FEB86659FD93, PLACES)
_BY_WORD = _powers(0xA0761D6478BD642F, 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads each bit over all; one to one."""
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, bounds of each text's words) of texts that are data[bounds[k]:bounds[k + 1]]."""
    inside = ~_SPACE[data]
    before = np.concatenate(([False], inside[:-1]))
    before[bounds[:-1][bounds[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(bounds), np.int64)
    place = np.arange(len(data))
    place[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, len(data))))
    terms = _NUMBERS[data] * _BY_PLACE[place % PLACES]
    if place.max() >= PLACES:
        terms = terms * _BY_STRETCH[place // PLACES % PLACES]
    return mix(np.add.reduceat(terms, starts)), np.searchsorted(starts, bounds)


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The set of each text's shingles, of at most 31 words, ascending."""
    for some in stretches(texts.cast(pa.large_string()), BATCH_BYTES):
        some = pa.concat_arrays([pc.fill_null(some, "")])
        bounds = np.frombuffer(some.buffers()[1], np.int64)[some.offset : some.offset + len(some) + 1]
        data = np.frombuffer(some.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        words, ends = word_hashes(data, bounds - bounds[0])
        whole = np.zeros(max(0, len(words) - size + 1), np.uint64)
        for k in range(size):
            whole += words[k : k + len(whole)] * _BY_WORD[k]
        whole = mix(whole)
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            if b - a >= size:
                found = np.sort(whole[a : b - size + 1])
                yield found[np.concatenate(([True], found[1:] != found[:-1]))]
            elif b > a:
                yield mix((words[a:b] * _BY_WORD[: b - a]).sum(keepdims=True) + _BY_WORD[63 - (b - a)])
            else:
                yield np.empty(0, np.uint64)
