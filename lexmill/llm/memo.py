"""A bounded memo for pieces of texts, which mostly recur."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import weakref
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa

AT_ONCE = 25_000
_HELD: weakref.WeakSet = weakref.WeakSet()


def release() -> None:
    """Empties all memos of this worker, which may have come from an earlier stage, and gives free memory back to the system."""
    for memo in _HELD:
        memo.known, memo.old = {}, {}
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which its worker, which Spark keeps for later stages, holds no more memory than before."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        yield from run(batches)
        release()

    return inner


class Memo:
    """Values by piece, in two generations of half of ``most`` each: what is used moves to the younger, and when that is full the older goes."""

    def __init__(self, learn: Callable[[list[str]], list[bytes]], most: int):
        self.learn, self.most = learn, most
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        _HELD.add(self)

    def values(self, pieces: list[str]) -> list[bytes]:
        """The value of each piece; what isn't known is learnt first."""
        collects = gc.isenabled()
        gc.disable()  # many small lists without cycles
        try:
            got = list(map(self.known.get, pieces))
            missing = {x for x, y in zip(pieces, got) if y is None}
            if not missing:
                return got
            if len(self.known) + len(missing) > self.most // 2:
                self.old, self.known = self.known, {x: y for x, y in zip(pieces, got) if y is not None}
            known, before = self.known, self.old.get
            known.update((x, y) for x in missing if (y := before(x)) is not None)
            new = [x for x in missing if x not in known]
            for at in range(0, len(new), AT_ONCE):
                part = new[at : at + AT_ONCE]
                known.update(zip(part, self.learn(part)))
            return [known[x] if y is None else y for x, y in zip(pieces, got)]
        finally:
            if collects:
                gc.enable()

    def joined(self, rows: list[list[str]]) -> list[bytes]:
        """For each row the values of its pieces, one after the other."""
        values = iter(self.values([x for row in rows for x in row]))
        return [next(values) if len(row) == 1 else b"".join(islice(values, len(row))) for row in rows]


def gathered(values: list[bytes], codes: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """For each stretch of ``codes`` between ``bounds`` the 4-byte ids in ``values[code]``, one after the other."""
    flat = np.frombuffer(b"".join(values), "<u4")
    sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
    starts = np.cumsum(sizes) - sizes
    n = sizes[codes]
    ends = np.concatenate([[0], np.cumsum(n)])
    data = flat[np.repeat(starts[codes] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
    at = (ends[bounds] * 4).tolist()
    return [data[i:j] for i, j in zip(at, at[1:])]


def divided(lists: pa.ListArray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct pieces of lists of strings, the code of each piece in order and the lists' bounds."""
    bounds = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), bounds - bounds[0]
