"""Words of many texts at once: where they stand, and their hashes."""

from __future__ import annotations

import numpy as np
import xxhash

_U = np.uint64
#: Words are hashed eight bytes at a time, those of more than LONG bytes by xxh64; the seeds give independent hashes.
SEEDS, LONG = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), 64
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> _U(30)) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> _U(27)) * _U(0x94D049BB133111EB)
    return x ^ x >> _U(31)


def spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the words (between ASCII white space) in bytes that end in white space."""
    space = _SPACE[raw]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    edges = np.r_[0, edges] if len(raw) and not space[0] else edges
    return edges[::2], edges[1::2] - edges[::2]


def hashes(data: bytes, starts: np.ndarray, sizes: np.ndarray, seeds=SEEDS) -> list[np.ndarray]:
    """Hashes of words in data, which ends in eight bytes more, for each of the seeds."""
    eights = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    first = eights[starts] & _LOW[np.minimum(sizes, 8)]
    out = [mix(first * _U(seed | 1) + sizes.astype(np.uint64)) for seed in seeds]
    left = np.flatnonzero((sizes > 8) & (sizes <= LONG))
    for at in range(8, LONG, 8):
        left = left[sizes[left] > at]
        if not len(left):
            break
        x = eights[starts[left] + at] & _LOW[np.minimum(sizes[left] - at, 8)]
        for h, seed in zip(out, seeds):
            h[left] = mix((h[left] ^ x) * _U(seed | 1))
    for i in np.flatnonzero(sizes > LONG):
        word = data[starts[i] : starts[i] + sizes[i]]
        for h, seed in zip(out, seeds):
            h[i] = xxhash.xxh64_intdigest(word, seed)
    return out


def inverse(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct value, in order, occurs, and each value's number among the distinct ones."""
    by = np.argsort(values)
    now = values[by]
    fresh = np.r_[True, now[1:] != now[:-1]][: len(by)]
    place = np.empty(len(by), np.uint32)
    place[by] = np.cumsum(fresh, dtype=np.uint32) - np.uint32(1)
    return by[fresh], place
