"""K-means for many starts and many k at once: every scan of the rows serves all of them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tabscope.operators.sums import DENSE_WIDTH, Rows, Vectors, by_value

# The odd multipliers of a 64-bit mixing function.
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def uniform(rows: np.ndarray, seed: int) -> np.ndarray:
    """Numbers in (0, 1) that follow from row numbers and the seed."""
    with np.errstate(over="ignore"):
        x = rows.astype(np.uint64) * _MIX[0] + np.uint64((seed * 0x2545F4914F6CDD1D) % (1 << 64))
        for shift, factor in ((30, _MIX[1]), (27, _MIX[2])):
            x = (x ^ (x >> np.uint64(shift))) * factor
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


@dataclass(frozen=True)
class Start:
    """One run: its number, its centres (k x width), whether they have come to rest, and its cost once measured."""

    number: int
    centres: np.ndarray
    resting: bool = False
    cost: float = float("inf")
    rounds: int = 0

    @property
    def k(self) -> int:
        return len(self.centres)


def middle(data: Vectors) -> np.ndarray:
    """The mean of the rows, which distances are taken from for the sake of digits; 0 for wide sparse rows."""
    if data.width > DENSE_WIDTH:
        return np.zeros(data.width)

    def task(batches: Iterator[Rows]) -> np.ndarray:
        total = np.zeros(data_width + 1)
        for rows in batches:
            total[:-1] += rows.weighted(np.ones((len(rows), 1)))[0]
            total[-1] += len(rows)
        return total

    data_width = data.width
    total = data.summed(task, data_width + 1)
    return total[:-1] / max(total[-1], 1)


def moved(rows: Rows, shift: np.ndarray) -> Rows:
    return rows if rows.dense is None else replace(rows, dense=rows.dense - shift)


def distances(rows: Rows, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    squares = np.einsum("ij,ij->i", centres, centres)
    return np.maximum(rows.squares()[:, None] - 2.0 * rows.dot(centres.T) + squares, 0.0)


def seeds(data: Vectors, k: int, starts: Sequence[int], seed: int, shift: np.ndarray) -> dict[int, np.ndarray]:
    """``k`` centres of each start by squared-distance sampling over all rows: one scan a centre for all starts.

    A row's key is an exponential draw over its weight, the squared distance to the nearest centre so far; the least key
    of all is a draw in proportion to the weights. The first centres of a start serve a smaller k as well.
    """
    width, spark = data.width, data.table.sparkSession
    chosen: dict[int, list[np.ndarray]] = {number: [] for number in starts}
    for turn in range(k):
        given = {number: np.array(own) for number, own in chosen.items()}

        def task(batches: Iterator[Rows]) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple[float, int, np.ndarray]] = {}
            for rows in batches:
                rows = moved(rows, shift)
                numbers = rows.others["row"]
                for number, centres in given.items():
                    weight = distances(rows, centres).min(1) if turn else np.ones(len(rows))
                    with np.errstate(divide="ignore"):
                        keys = -np.log(uniform(numbers, seed + 7919 * number + 104729 * turn)) / weight
                    at = int(keys.argmin())
                    if number not in best or (keys[at], numbers[at]) < best[number][:2]:
                        one = np.zeros((len(rows), 1))
                        one[at] = 1.0
                        best[number] = (float(keys[at]), int(numbers[at]), rows.weighted(one)[0])
            columns = [pa.array(best, pa.int32()), *zip(*best.values())] if best else [[], [], [], []]
            names = ("start", "key", "row", "centre")
            types = (pa.int32(), pa.float64(), pa.int64(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)

        drawn = data.batches(task, "start int, key double, row long, centre array<double>")
        least = drawn.groupBy("start").agg(F.min_by("centre", F.struct("key", "row")).alias("centre"))
        for row in least.collect():
            chosen[row["start"]].append(np.array(row["centre"]))
    return {number: np.array(own).reshape(len(own), width) for number, own in chosen.items()}


def _labels(found: np.ndarray, sizes: Sequence[int]) -> np.ndarray:
    """Rows x runs: the column of ``found`` (rows x all centres, run after run) that is nearest in each run."""
    ends = np.cumsum(sizes)
    return np.stack([found[:, end - n : end].argmin(1) + end - n for n, end in zip(sizes, ends)], 1)


def _round(data: Vectors, runs: Sequence[Start], shift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One scan for all runs: per centre the sum and number of its rows, and per run the cost."""
    stacked = np.concatenate([run.centres for run in runs])
    sizes, width = [run.k for run in runs], data.width

    def task(batches: Iterator[Rows]) -> np.ndarray:
        sums, counts, costs = np.zeros((len(stacked), width)), np.zeros(len(stacked)), np.zeros(len(sizes))
        for rows in batches:
            rows = moved(rows, shift)
            found = distances(rows, stacked)
            labels = _labels(found, sizes)
            own = np.zeros(found.shape)
            np.put_along_axis(own, labels, 1.0, 1)
            rows.add_to(sums, own)
            counts += own.sum(0)
            costs += np.take_along_axis(found, labels, 1).sum(0)
        return np.concatenate([sums.ravel(), counts, costs])

    total = data.summed(task, len(stacked) * (width + 1) + len(sizes))
    cells = len(stacked) * width
    return total[:cells].reshape(stacked.shape), total[cells : cells + len(stacked)], total[cells + len(stacked) :]


def lloyd(data: Vectors, runs: Sequence[Start], shift: np.ndarray, max_iter: int = 300, tolerance: float = 1e-4) -> list[Start]:
    """All runs until their centres rest: no centre moves by more than ``tolerance``, or ``max_iter`` rounds are done.

    One scan a round for all runs that still move; a run that rests is left out of the next scans, and so is one whose
    centres equal those of an earlier run of its k, as it would go the same way. A last scan takes the cost of all.
    A centre without rows stays. The tasks and the driver hold the centres and one sum of each.
    """
    runs, twins = list(runs), {}
    for _ in range(max_iter):
        active = [i for i, run in enumerate(runs) if not run.resting and i not in twins]
        if not active:
            break
        sums, counts, _ = _round(data, [runs[i] for i in active], shift)
        at, seen = 0, {}
        for i in active:
            run, span = runs[i], slice(at, at + runs[i].k)
            at += run.k
            filled = counts[span] > 0
            centres = np.where(filled[:, None], sums[span] / np.maximum(counts[span], 1)[:, None], run.centres)
            resting = float(np.square(centres - run.centres).sum(1).max()) <= tolerance**2
            runs[i] = replace(run, centres=centres, resting=resting, rounds=run.rounds + 1)
            order = np.lexsort(centres.T[::-1])
            same = seen.setdefault((run.k, np.round(centres[order], 9).tobytes()), i)
            if same != i:
                twins[i] = same

    def leader(i: int) -> int:
        return leader(twins[i]) if i in twins else i

    alone = [i for i in range(len(runs)) if i not in twins]
    costs = dict(zip(alone, _round(data, [runs[i] for i in alone], shift)[2].tolist()))
    return [replace(runs[leader(i)], number=run.number, cost=costs[leader(i)]) for i, run in enumerate(runs)]


by_value(__name__)
