"""Small groups of rows (a question's nearest cases), worked on many at a time.

A group is one record with its rows as a list, so a task gets thousands of
groups as arrays; groups of equal size are stacked and go through numpy
together. No Python call is made per group where numpy can take the stack.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROUP_ROWS = 10_000  # rows of groups in one task: about a second of the costliest fit
CELLS = 1_000_000  # pairs of rows of stacked groups


def dealt_groups(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """``rows``, about ``n`` of them, with those of equal keys together and about ``GROUP_ROWS`` to a task.

    The work on a group far outweighs its bytes, by which Spark would put all groups into a few tasks.
    """
    return rows.repartition(max(1, -(-n // GROUP_ROWS)), *keys)


def stacks(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(groups, places)``: numbers of groups of one size and the places (groups x rows) of their rows, at most ``CELLS`` pairs of rows or one group."""
    starts = np.cumsum(sizes) - sizes
    for n in np.unique(sizes):
        mine = np.flatnonzero(sizes == n)
        step = max(1, CELLS // max(1, int(n) * int(n)))
        for lo in range(0, len(mine), step):
            part = mine[lo:lo + step]
            yield part, starts[part][:, None] + np.arange(n)


def numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(float)


def stacked(flat: list[pa.Array], places: np.ndarray) -> np.ndarray:
    """Features ``flat`` of stacked groups (groups x rows x features), 0 where a value is missing. Each feature of a group lies together."""
    x = np.stack([numbers(c)[places] for c in flat], axis=1)
    return np.where(np.isnan(x), 0.0, x).transpose(0, 2, 1)


def map_groups(rows: DataFrame, keys: list[str], cols: dict[str, Column], work: Callable, out: dict[str, str]) -> DataFrame:
    """``(keys, out)``: ``work`` on stacks of groups of ``rows`` by ``keys``; ``out`` gives names and types.

    A group's rows are ordered by ``cols``. ``work(flat, places)`` gets the columns of all rows and the places (groups x rows) of a stack, and
    returns the number of the group within the stack of each of its output rows and their columns.
    """
    fields = {k: rows.schema[k].dataType.simpleString() for k in keys} | out
    packed = rows.select(*keys, F.struct(*[c.alias(name) for name, c in cols.items()]).alias("_row")).groupBy(*keys).agg(
        F.sort_array(F.collect_list("_row")).alias("_rows"))

    def run(batches):
        for b in batches:
            lists = b.column("_rows")
            flat = lists.flatten().flatten()
            for groups, places in stacks(lists.value_lengths().to_numpy(zero_copy_only=False)):
                of, columns = work(flat, places)
                at = pa.array(groups[of], pa.int64())
                yield pa.RecordBatch.from_arrays([*[b.column(k).take(at) for k in keys], *columns], list(fields))

    return packed.mapInArrow(run, ", ".join(f"`{name}` {kind}" for name, kind in fields.items()))
