"""What the two vector operators share: vectors of integers, exact distances, and sums of a fixed number of cells."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components after scaling stay below this, so that squared distances of up to 4,096 components fit into 64 bits.
MOST = 1 << 24


def is_whole(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector.cast("array<double>"), bad)


def scaled(vector: Column, by: int) -> Column:
    """floor(by * x) of each component as array<int>. Components of 2^24 or more after scaling raise an error: the
    distances asked for as long would not hold."""
    error = F.raise_error(F.lit(f"a component times {by} is {MOST} or more")).cast("int")
    return F.transform(vector.cast("array<double>"), lambda x: F.when(F.abs(x) * by < MOST, F.floor(x * by).cast("int")).otherwise(error))


def matrix(lists, width: int):
    """A list column of equal lengths as an int64 matrix."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype("int64").reshape(len(lists), width)


def gaps(a, b):
    """Exact squared distances of the rows of a and b, or of the rows of a and the one row b."""
    d = a - b
    return (d * d).sum(axis=-1)


def all_gaps(x, entries):
    """Exact squared distances of every row of x to every entry, as int64. Products of floats are exact while all sums
    stay below 2^53; beyond that integers are used."""
    import numpy as np

    peak = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * peak * peak * max(1, x.shape[1]) < 1 << 53:
        xf, ef = x.astype("float64"), entries.astype("float64")
        return ((xf * xf).sum(axis=1)[:, None] - 2.0 * (xf @ ef.T) + (ef * ef).sum(axis=1)[None, :]).astype("int64")
    return np.stack([gaps(x, e) for e in entries], axis=1)


def root_up(squares):
    """No less than the square root."""
    import numpy as np

    return np.nextafter(np.sqrt(np.asarray(squares, dtype="float64")), np.inf)


def root_down(squares):
    """No more than the square root."""
    import numpy as np

    return np.maximum(np.nextafter(np.sqrt(np.asarray(squares, dtype="float64")), -np.inf), 0.0)


def summed(df: DataFrame, cells: int, add: Callable):
    """Sums of `cells` integers over a DataFrame: add(total, batch) adds up a batch within its task, so each task hands
    on `cells` rows at most, which one grouped sum brings together. The driver gets an array of `cells` numbers."""
    import numpy as np

    def run(batches: Iterator):
        import pyarrow as pa

        total = np.zeros(cells, dtype="int64")
        for b in batches:
            add(total, b)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["cell", "value"])

    out = np.zeros(cells, dtype="int64")
    for r in df.mapInArrow(run, "cell long, value long").groupBy("cell").agg(F.sum("value").alias("value")).collect():
        out[r["cell"]] = r["value"]
    return out
