"""Hashes of words and word shingles of whole texts, in array operations over a batch of texts.

Words are maximal runs of bytes other than ASCII white space, A-Z lowered. A word's hash is a
polynomial of its bytes modulo 2**64 taken from running sums, then mixed; a shingle's hash mixes the
hashes of its words. Equal texts have equal hashes on every machine and in every run.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C13  # odd, 3 modulo 4
_GAP = np.zeros(256, bool)
_GAP[[0x20, 9, 10, 11, 12, 13]] = True
_SIGN = _GAP.copy()  # ASCII that is neither letter nor digit
_SIGN[[c for c in range(128) if not chr(c).isalnum()]] = True
#: Bytes of text that are hashed at once; a longer text is hashed alone.
BUFFER = 1 << 20

with np.errstate(over="ignore"):
    _TABLE = np.random.default_rng(20240229).integers(1, 2**64, 256, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first ``n`` powers of the base, or of its inverse, modulo 2**64."""
    got = _POWERS.get(inverse)
    if got is None or len(got) < n:
        base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
        got = np.full(max(n, BUFFER + 1), base, np.uint64)
        got[0] = 1
        got = np.multiply.accumulate(got)
        if len(got) <= 4 * BUFFER:
            _POWERS[inverse] = got
    return got[:n]


def running_hash(data: np.ndarray) -> np.ndarray:
    """Sums such that ``(s[j] - s[i]) * inverse_power[i]`` is the hash of ``data[i:j]``."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_TABLE[data] if data.dtype == np.uint8 else data) * powers(len(data)), out=out[1:])
    return out


def buffers(texts: list[str | bytes | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Texts as UTF-8, in runs of at most BUFFER bytes: (position of the first, the run)."""
    first, run, size = 0, [], 0
    for i, t in enumerate(texts):
        raw = t if isinstance(t, bytes) else (t or "").encode("utf-8", "surrogatepass")
        if run and size + len(raw) > BUFFER:
            yield first, run
            first, run, size = i, [], 0
        run.append(raw)
        size += len(raw) + 1
    if run:
        yield first, run


def word_hashes(run: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of these texts, and the position of its text."""
    data = np.frombuffer(b" ".join(run).lower() + b" ", np.uint8)
    gap = _GAP[data]
    edge = np.flatnonzero(np.diff(gap, prepend=True))
    start, end = edge[0::2], edge[1::2]
    sums = running_hash(data)
    words = mix((sums[end] - sums[start]) * powers(len(data), True)[start] + (end - start).astype(np.uint64))
    text_end = np.cumsum([len(r) + 1 for r in run])
    return words, np.searchsorted(text_end, start, "right")


def count_words(run: list[bytes]) -> int:
    """How many words these texts have."""
    gap = _GAP[np.frombuffer(b" ".join(run) + b" ", np.uint8)]
    return int(np.count_nonzero(gap[1:] & ~gap[:-1]))


def trimmed_words(run: list[bytes]) -> tuple[np.ndarray, ...]:
    """Hash, position of the text, first and end byte (in the texts laid end to end, one byte apart) of each word.

    Words stand between ASCII white space, here without the ASCII signs around them and in their own
    case; a word of signs only is left as it is.
    """
    data = np.frombuffer(b" ".join(run) + b" ", np.uint8)
    edge = np.flatnonzero(np.diff(_GAP[data], prepend=True))
    start, end = edge[0::2], edge[1::2]
    solid = np.flatnonzero(~_SIGN[data])
    if len(solid):
        first = np.searchsorted(solid, start)
        a, b = solid[np.minimum(first, len(solid) - 1)], solid[np.searchsorted(solid, end) - 1] + 1
        some = (first < len(solid)) & (a < end)
        start, end = np.where(some, a, start), np.where(some, b, end)
    sums = running_hash(data)
    words = mix((sums[end] - sums[start]) * powers(len(data), True)[start] + (end - start).astype(np.uint64))
    text_end = np.cumsum([len(r) + 1 for r in run])
    return words, np.searchsorted(text_end, start, "right"), start, end


def combine(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = mix(h * np.uint64(_BASE) + words[i : i + n])
    return h


def shingle_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer than ``k`` words is one shingle."""
    for _, run in buffers(texts):
        words, of = word_hashes(run)
        cut = np.searchsorted(of, np.arange(len(run) + 1))
        all_ = combine(words, k)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(all_[a : b - k + 1])
            elif b > a:
                yield combine(words[a:b], b - a)
            else:
                yield all_[:0]


#: Caches that an operator keeps in a Python worker between tasks.
_CACHES: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """The cache of ``owner`` in this worker."""
    return _CACHES.setdefault(owner, {})


def release_others(owner: str) -> None:
    """Empty the caches that other operators have left in this worker; called as a task starts."""
    for name, cache in _CACHES.items():
        if name != owner:
            cache.clear()


#: Bytes by which a worker may have grown before it gives memory back, and its resident pages when it last did.
GROWN = 8 << 20
_RESIDENT = [0]


def resident() -> int:
    """Bytes of memory that this process holds; 0 where the system does not tell."""
    try:
        with open("/proc/self/statm", "rb") as f:
            return int(f.read().split()[1]) * 4096
    except OSError:
        return 0


def give_back() -> None:
    """Return what this worker has freed to the system: workers wait for their next task beside others that run."""
    if resident() < _RESIDENT[0] + GROWN:
        return
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
    _RESIDENT[0] = resident()


def task(owner: str) -> Callable[[Callable], Callable]:
    """What a task of ``owner`` runs: other operators' caches go as it starts, freed memory as it ends."""

    def wrap(run: Callable) -> Callable:
        @functools.wraps(run)
        def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            release_others(owner)
            try:
                yield from run(batches)
            finally:
                give_back()

        return wrapped

    return wrap


def texts_of(batch: pa.RecordBatch, column: int, at_once: int = 256) -> Iterator[tuple[int, list[str | None]]]:
    """The texts of a batch, a few at a time."""
    for at in range(0, batch.num_rows, at_once):
        yield at, batch.column(column).slice(at, at_once).to_pylist()
