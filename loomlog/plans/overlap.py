"""The comparison step of large similarity joins, as array arithmetic over the rows of a key.

A key with ``m`` left and ``n`` right texts has ``m * n`` candidates, of which few are pairs. Counted a tile at a time
with numpy a candidate costs some 20 ns, where a joined row costs fifty times that. The rows of a key lie side by side
in a sorted partition, so a task holds one key, whose rows are bounded by the blocks of ``plans.simjoin``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from loomlog.functions.similarity import length_bound
from loomlog.plans.tokens import EPS, MASKS

# Rows of a tile on the left and the right: its words stay in the processor's cache.
TILE = (128, 1024)
# Pairs handed on at a time.
MOST_PAIRS = 20_000
GROUP = ["k", "p", "turn", "lb", "rb"]
PAIRS = pa.schema([("left_id", pa.int64()), ("right_id", pa.int64()), ("similarity", pa.float64())])


class Rows:
    """The rows of one key and side, by ``b``."""

    def __init__(self, table: pa.RecordBatch, at: np.ndarray, columns: dict[str, np.ndarray]):
        self.table, self.at = table, at
        self.id, self.b, self.nbytes, self.words, self.extra = (columns[c][..., at] for c in ("id", "b", "nbytes", "words", "extra"))

    def lists(self, name: str, i: int) -> list:
        return self.table.column(name)[int(self.at[i])].as_py()

    def group(self, i: np.ndarray) -> list:
        return self.table.column("g").take(pa.array(self.at[i])).to_pylist()


def _candidates(short: Rows, long: Rows, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of pairs that may reach the threshold, from the bit words and lengths alone; ``short`` has the text that is no longer."""
    met = np.bitwise_or.reduce(short.words, axis=1) & np.bitwise_or.reduce(long.words, axis=1)
    used = np.flatnonzero(met)
    longest = (2.0 - threshold) / threshold
    for i in range(0, len(short.b), TILE[0]):
        sb, left = short.b[i : i + TILE[0]], short.words[used, i : i + TILE[0]]
        first = int(np.searchsorted(long.b, sb[0]))
        last = int(np.searchsorted(long.b, int(sb[-1] * longest + 1.0), side="right"))
        for j in range(first, last, TILE[1]):
            stop = min(j + TILE[1], last)
            shared = np.zeros((len(sb), stop - j), np.uint16)
            for x, y in zip(left, long.words[used, j:stop]):
                shared += np.bitwise_count(x[:, None] & y[None, :])
            # a bit of hashes may stand for as many tokens more as the shorter text has beyond its bits
            least = np.ceil(threshold * (sb + long.b[j]) / 2.0 - EPS) - short.extra[i : i + TILE[0]]
            s, t = np.nonzero(shared >= np.clip(least, 0, 1 << 15).astype(np.uint16)[:, None])
            reach = 2.0 * (shared[s, t] + short.extra[s + i]) >= threshold * (sb[s] + long.b[t + j]) - EPS
            if reach.any():
                yield s[reach] + i, t[reach] + j


def _exact(short: Rows, long: Rows, s: np.ndarray, t: np.ndarray, key: int, threshold: float, metric: str, wide: bool, self_join: bool, equal: bool, by: bool):
    """Which of the candidates are pairs that are looked at under this key, and their similarity."""
    sb, tb = short.b[s], long.b[t]
    keep = (sb < tb) | ((sb == tb) & (short.id[s] < long.id[t] if self_join else equal))
    if metric == "dice_bigrams":
        x, y = short.nbytes[s], long.nbytes[t]
        keep &= np.minimum(x, y) / np.maximum(np.maximum(x, y), 1).astype(np.float64) >= length_bound(threshold)
    s, t = s[keep], t[keep]
    common = short.words[: len(MASKS), s] & long.words[: len(MASKS), t]
    place = min(max(key, 0), 64 * len(MASKS))
    below = np.array([(1 << min(max(place - 64 * i, 0), 64)) - 1 for i in range(len(MASKS))], np.uint64)
    first = ~np.any(common & below[:, None], axis=0)
    s, t, common = s[first], t[first], common[:, first]
    shared = np.bitwise_count(common).sum(axis=0, dtype=np.int64)
    first = np.ones(len(s), bool)
    if wide:
        for n in np.flatnonzero((short.words[-1, s] & long.words[-1, t]) != 0):
            mine = dict(zip(short.lists("rest", s[n]), short.lists("places", s[n])))
            both = mine.keys() & set(long.lists("rest", t[n]))
            shared[n] += len(both)
            first[n] = all(mine[token] >= key for token in both)
    total = short.b[s] + long.b[t]
    value = np.where(total == 0, 1.0, 2.0 * shared / np.maximum(total, 1))
    value[(total > 0) & ((short.b[s] == 0) | (long.b[t] == 0))] = 0.0
    keep = first & (value >= threshold)
    s, t, value = s[keep], t[keep], value[keep]
    if by and len(s):
        same = np.array([x == y for x, y in zip(short.group(s), long.group(t))])
        s, t, value = s[same], t[same], value[same]
    return s, t, value


def _pairs_of_keys(batch: pa.RecordBatch, threshold: float, metric: str, wide: bool, self_join: bool, left_first: bool, by: bool):
    """The pairs of whole keys, in sorted rows."""
    number = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
    names = [*MASKS, "h"] if wide else MASKS
    columns = {c: number(c).astype(np.int64) for c in ("id", "b", "nbytes")}
    columns["words"] = np.stack([number(c).view(np.uint64) for c in names])
    extra = np.zeros(len(batch), np.int64)
    if wide:
        extra = number("n_rest").astype(np.int64) - np.bitwise_count(columns["words"][-1])
    columns["extra"] = extra
    starts = np.append(_starts(batch), len(batch))
    side = number("side")
    lefts = np.add.reduceat((side == 0).astype(np.int64), starts[:-1]) if len(batch) else []
    found, size = [], 0
    for at, stop, n in zip(starts, starts[1:], lefts):
        if not 0 < n < stop - at:
            continue
        rows = np.arange(at, stop)
        mine, theirs = (Rows(batch, rows[side[at:stop] == x], columns) for x in (0, 1))
        key, turn = (batch.column(c)[int(at)].as_py() for c in ("p", "turn"))
        short, long = (mine, theirs) if turn == 0 else (theirs, mine)
        for s, t in _candidates(short, long, threshold):
            s, t, value = _exact(short, long, s, t, key, threshold, metric, wide, self_join, turn == 0, by)
            left, right = (short.id[s], long.id[t]) if turn == 0 else (long.id[t], short.id[s])
            if self_join:
                left, right = np.minimum(left, right), np.maximum(left, right)
            if left_first:
                keep = left < right
                left, right, value = left[keep], right[keep], value[keep]
            if len(left):
                found.append((left, right, value))
            size += len(left)
            if size > MOST_PAIRS:
                yield _batch(found)
                found, size = [], 0
    if found:
        yield _batch(found)


def _batch(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*found)], schema=PAIRS)


def _starts(batch: pa.RecordBatch) -> np.ndarray:
    new = np.zeros(len(batch), bool)
    new[:1] = True
    for c in GROUP:
        values = batch.column(c).to_numpy(zero_copy_only=False)
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def compare_sorted(threshold: float, metric: str, wide: bool, self_join: bool, left_first: bool, by: bool):
    """A function for ``mapInArrow`` over rows that are together by ``GROUP`` and in order of ``b`` there; ``turn`` 0 has the text that is
    no longer on the left (``side`` 0), 1 the one that is longer."""
    options = (threshold, metric, wide, self_join, left_first, by)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            last = int(_starts(batch)[-1])
            head = pa.concat_batches([held[0].slice(0, 1).select(GROUP), batch.slice(len(batch) - 1).select(GROUP)])
            if len(_starts(head)) == 1:
                continue  # all rows held are of one key
            if last == 0:
                whole, held = held[:-1], [batch]
            else:
                whole, held = [*held[:-1], batch.slice(0, last)], [batch.slice(last)]
            yield from _pairs_of_keys(pa.concat_batches(whole), *options)
        if held:
            yield from _pairs_of_keys(pa.concat_batches(held), *options)

    return compare
