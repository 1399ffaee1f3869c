"""Hashes of words and word sequences, the same in every process, and what tasks over batches share."""

import ctypes
import gc
import hashlib

import numpy as np
from pyspark.sql import functions as F

KEPT = 300_000
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> _U(30))
        x = x * _U(0xBF58476D1CE4E5B9)
        x = x ^ (x >> _U(27))
        x = x * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_powers_known: list[np.ndarray] = [np.ones(1, "uint64")] * 2


def powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([[_U(1)], np.cumprod(np.full(n, base, "uint64"))])


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of stretches of bytes, equal for equal stretches, from one running sum over all bytes."""
    if len(data) >= len(_powers_known[0]):
        _powers_known[:] = powers(_BASE, 2 * len(data)), powers(_BACK, 2 * len(data))
    times, back = _powers_known
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, "uint64")
        np.cumsum(np.multiply(data, times[:len(data)], dtype="uint64"), out=sums[1:])
        return mix((sums[end] - sums[start]) * back[start] + (end - start).astype("uint64"))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > KEPT:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), "uint64", len(words))


def text_key(text="text"):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def split(text) -> list[bytes]:
    """Words between ASCII white space; a null text has none."""
    return text.encode().split() if isinstance(text, str) else []


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words; a shorter text is one run, an empty one none."""
    if not len(h):
        return h
    n = min(n, len(h))
    out = np.zeros(len(h) - n + 1, "uint64")
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * _U(0x9E3779B97F4A7C15) + h[k:len(h) - n + 1 + k]
            out = mix(out)
    return out


def tidy(run):
    """A task body after which the worker, which Spark keeps for later stages, hands the memory of its tables back to the system."""

    def whole(batches):
        import pyarrow as pa

        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return whole


def groups(batches, keys: list[str]):
    """(key, rows) of a stream of Arrow batches that is sorted by ``keys``; a group may cross batches."""
    import pandas as pd

    held = None
    for b in batches:
        b = b if held is None else pd.concat([held, b], ignore_index=True)
        if not len(b):
            continue
        change = np.zeros(len(b), bool)
        for k in keys:
            v = b[k].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(change).tolist()]
        for lo, hi in zip(cuts, cuts[1:]):
            yield b.iloc[lo:hi]
        held = b.iloc[cuts[-1]:].reset_index(drop=True)
    if held is not None and len(held):
        yield held
