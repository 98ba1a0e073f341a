"""Periodic runs of words, found by block convolution (operator 11).

A run is a stretch of consecutive words with smallest period q and at least
``max(SHORTEST, POWER * q)`` words that no neighbouring word extends. At scale B = 1, 2, 4, ...
the words are cut into blocks of B. A run with B <= q < 2 B holds a whole block that begins
among its first B words, and that block comes again q words later, so it lies without a
mismatch in the window of the two following blocks. The sums of squared differences of a block and
all its places in that window come from one number theoretic transform, modulo as many primes as make them
exact; a zero gives a distance, and the stretch around it is followed word by word.

Only blocks that can begin such a run are transformed: each of the first 2 B words must come
again less than 2 B words later, and no known run of a smaller period p may cover p + q words from
there (two runs of different periods p and q share fewer than p + q words: Fine and Wilf 1965).
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomlog.llm.common import id_and_text, release_memory, slices

#: A run has at least this many words, and this many times its period.
SHORTEST, POWER = 6, 4
#: Numbers that one transform works on at a time.
TRANSFORM_CELLS = 1 << 18

# Primes k * 2^m + 1 below 2^31, each with a generator of its units.
PRIMES = ((998244353, 3), (1004535809, 3), (469762049, 3))


def _roots(prime: int, generator: int, half: int, inverse: bool) -> np.ndarray:
    """Powers 0 .. half-1 of a primitive root of order 2 * half."""
    root = pow(generator, (prime - 1) // (2 * half), prime)
    if inverse:
        root = pow(root, prime - 2, prime)
    out = np.ones(half, dtype=np.uint64)
    step, power = 1, root
    while step < half:  # doubling: the second half is the first times root^step
        out[step : 2 * step] = out[:step] * np.uint64(power) % np.uint64(prime)
        step, power = 2 * step, power * power % prime
    return out


def _forward(x: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """Transform of each row, its values in bit-reversed order."""
    p, (rows, n) = np.uint64(prime), x.shape
    half = n // 2
    while half:
        y = x.reshape(rows, -1, 2, half)
        a, b = y[:, :, 0], y[:, :, 1]
        x = np.stack([(a + b) % p, (a + (p - b)) % p * _roots(prime, generator, half, False) % p], axis=2)
        half //= 2
    return x.reshape(rows, n)


def _backward(x: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """Inverse of :func:`_forward`."""
    p, (rows, n) = np.uint64(prime), x.shape
    half = 1
    while half < n:
        y = x.reshape(rows, -1, 2, half)
        a, b = y[:, :, 0], y[:, :, 1] * _roots(prime, generator, half, True) % p
        x = np.stack([(a + b) % p, (a + (p - b)) % p], axis=2)
        half *= 2
    return x.reshape(rows, n) * np.uint64(pow(n, prime - 2, prime)) % p


def squared_differences_vanish(rows: np.ndarray) -> np.ndarray:
    """For rows of 3 B words, B a power of two: whether the first B words equal those from B + e on, for e < B.

    Words are numbered within their row, so that a sum is below B * (3 B)^2; with more than
    one prime, a sum is 0 if it is 0 modulo each.
    """
    n, width = rows.shape
    b = width // 3
    order = np.argsort(rows, axis=1, kind="stable")
    ordered = np.take_along_axis(rows, order, axis=1)
    rank = np.zeros((n, width), dtype=np.int64)
    rank[:, 1:] = np.cumsum(ordered[:, 1:] != ordered[:, :-1], axis=1)
    number = np.empty_like(rank)
    np.put_along_axis(number, order, rank, axis=1)
    block, window = number[:, :b], number[:, b:]
    total = np.zeros((n, 2 * b + 1), dtype=np.int64)
    np.cumsum(window * window, axis=1, out=total[:, 1:])
    squares = (block * block).sum(axis=1)[:, None] + total[:, b : 2 * b] - total[:, :b]
    zero, modulus = np.ones((n, b), dtype=bool), 1
    for prime, generator in PRIMES:
        p = np.uint64(prime)
        reverse = np.zeros((n, 2 * b), dtype=np.uint64)
        reverse[:, 0] = block[:, 0]
        reverse[:, b + 1 :] = block[:, :0:-1]  # index -i modulo 2 B
        product = _forward(reverse, prime, generator) * _forward(window.astype(np.uint64), prime, generator) % p
        cross = _backward(product, prime, generator)[:, :b]
        zero &= squares.astype(np.uint64) % p == 2 * cross % p
        modulus *= prime
        if modulus > b * width * width:
            break
    return zero


def _next_place(x: np.ndarray) -> np.ndarray:
    """How many places later each value comes again; the length of ``x`` if it does not."""
    order = np.argsort(x, kind="stable")
    out = np.full(len(x), len(x), dtype=np.int64)
    same = x[order[1:]] == x[order[:-1]]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def _matching(x: np.ndarray, i: int, d: int, step: int) -> int:
    """How many places from ``i`` on, in direction ``step``, equal those ``d`` later."""
    n, size = 0, 64
    while True:
        if step > 0:
            stop = min(i + n + size, len(x) - d)
            differ = x[i + n : stop] != x[i + n + d : stop + d]
        else:
            stop = max(i - n - size + 1, 0)
            differ = (x[stop : i - n + 1] != x[stop + d : i - n + 1 + d])[::-1]
        if differ.any():
            return n + int(differ.argmax())
        n += len(differ)
        if len(differ) < size:
            return n
        size *= 2


def _has_smaller_period(x: np.ndarray, start: int, end: int, q: int) -> bool:
    """Whether a stretch with period ``q``, at least twice as long, has one that divides it."""
    left, factor = q, 2
    while left > 1:
        if factor * factor > left:
            factor = left
        if left % factor == 0:
            d = q // factor
            if np.array_equal(x[start : end - d], x[start + d : end]):
                return True
            while left % factor == 0:
                left //= factor
        factor += 1
    return False


def find_runs(x: np.ndarray) -> np.ndarray:
    """Runs of a sequence of numbers as rows ``start, length, period``, ordered by start, then period.

    Sequences can be searched together if a number that occurs once stands between them.
    """
    n, found = len(x), set()
    if n < SHORTEST:
        return np.zeros((0, 3), dtype=np.int64)
    farthest = _next_place(x)  # the largest distance to the next place in each block
    reach = np.zeros(n, dtype=np.int64)  # end and period of a run that begins here, as end * (n + 1) + period
    b = 1
    while POWER * b <= n and farthest.size > 1:
        starts = np.flatnonzero(np.maximum(farthest[:-1], farthest[1:]) < 2 * b) * b
        starts = starts[starts + 3 * b <= n]
        ends, periods = np.divmod(np.maximum.accumulate(reach)[starts], n + 1)
        too_long = ends - starts - periods  # a run from this block with at most this period would be that run itself
        starts, too_long = starts[too_long < 2 * b - 1], too_long[too_long < 2 * b - 1]
        followed: dict[int, list[tuple[int, int]]] = defaultdict(list)
        group = max(1, TRANSFORM_CELLS // (2 * b))
        for at in range(0, len(starts), group):
            part = starts[at : at + group]
            zero = squared_differences_vanish(x[part[:, None] + np.arange(3 * b)])
            zero &= b + np.arange(b) > too_long[at : at + group, None]
            for row, e in zip(*np.nonzero(zero)):
                s, q = int(part[row]), b + int(e)
                seen = followed[q]
                if seen and seen[-1][0] <= s < seen[-1][1]:
                    continue
                start = s - _matching(x, s - 1, q, -1) if s else 0
                end = s + _matching(x, s, q, 1) + q
                seen.append((start, end - q))
                if end - start >= max(SHORTEST, POWER * q) and not _has_smaller_period(x, start, end, q):
                    found.add((start, end - start, q))
                    reach[start] = max(reach[start], end * (n + 1) + q)
        if len(farthest) % 2:
            farthest = np.append(farthest, n)
        farthest = farthest.reshape(-1, 2).max(axis=1)
        b *= 2
    return np.array(sorted(found, key=lambda r: (r[0], r[2])), dtype=np.int64).reshape(-1, 3)


def _dropped(length: int, runs: np.ndarray) -> np.ndarray:
    """Words that a run holds after its first period."""
    depth = np.zeros(length + 1, dtype=np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(depth[:-1]) > 0


def _search(texts: list[str]) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """Number of words, runs and collapsed text of each text."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    words = [t.encode().split() for t in texts]
    begins = np.cumsum([0, *(len(w) + 1 for w in words)])
    x = np.empty(begins[-1], dtype=np.int64)
    for i, (w, at) in enumerate(zip(words, begins)):
        x[at : at + len(w)] = np.fromiter(map(number.__getitem__, w), dtype=np.int64, count=len(w))
        x[at + len(w)] = -1 - i  # between two texts
    runs = find_runs(x)
    cuts = np.searchsorted(runs[:, 0], begins)
    for i, w in enumerate(words):
        own = runs[cuts[i] : cuts[i + 1]] - [begins[i], 0, 0]
        if len(own):
            w = [w[k] for k in np.flatnonzero(~_dropped(len(w), own)).tolist()]
        yield int(begins[i + 1] - begins[i] - 1), own, b" ".join(w)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every whole text, without a shuffle.

    Words are separated by ``\\x20`` and ``\\x09-\\x0D``. ``runs`` is an array of ``start, length,
    period``, by start, then period, starts counted from 0; ``collapsed`` are the words that no run
    holds after its first period, joined by one blank. A null or empty text has no words, no runs and an
    empty ``collapsed``; null ids and repeated rows stay; other columns are not read.
    """
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in slices(batch):
                n, runs, collapsed = zip(*_search(texts))
                flat = np.concatenate(runs)
                offsets = np.cumsum([0, *map(len, runs)])
                structs = pa.StructArray.from_arrays([pa.array(c) for c in flat.T], fields=list(run))
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id"), pa.array(n, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs),
                        pa.array([c.decode() for c in collapsed], pa.string()),
                    ],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )
        release_memory()

    return id_and_text(docs, id_col, text_col).mapInArrow(
        search, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    )
