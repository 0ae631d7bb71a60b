"""Non-dominated sorting of candidates within groups; all objectives are minimised."""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def first_front(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Rows that no row of their group dominates in two objectives; rows with a null objective go.

    A row is dominated if a smaller x has no larger y, or the same x a smaller y.  One sort per group
    of distinct x values tells that; rows are never compared in pairs.
    """
    rows = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    best = rows.groupBy(*by, x).agg(F.min(y).alias("_best"))
    before = Window.partitionBy(*by).orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    best = best.withColumn("_before", F.min("_best").over(before)).filter("_before IS NULL OR _before > _best")
    return rows.join(best, [*by, x]).filter(F.col(y) == F.col("_best")).drop("_best", "_before")


def _place(tails: list, y) -> int:
    """The front of the next distinct point by (x, y); ``tails`` has the smallest y of each front so far, which never fall."""
    k = bisect.bisect_right(tails, y)  # a front whose y is no larger has a point that dominates this one
    tails[k : k + 1] = [y]
    return k + 1


def front_numbers(points: np.ndarray) -> np.ndarray:
    """The front of each point, from 1: one more than the last front with a point that dominates it.

    Equal points share a front.  Distinct ones are taken by their first objective, then the next, so
    that none is dominated by a later one.  Two objectives need one search among the fronts for each
    point; with more, a front's points are compared at once, and the front is found by halving.
    """
    if not len(points):
        return np.zeros(0, int)
    p, own = np.unique(points, axis=0, return_inverse=True)
    out, own = np.zeros(len(p), int), own.reshape(-1)
    if p.shape[1] == 2:
        tails: list[float] = []
        for i, y in enumerate(p[:, 1].tolist()):
            out[i] = _place(tails, y)
        return out[own]
    found: list[np.ndarray] = []  # each front's points, with room for more
    size: list[int] = []
    for i, point in enumerate(p):
        low, high = 0, len(found)
        while low < high:
            k = (low + high) // 2
            if (found[k][: size[k]] <= point).all(axis=1).any():
                low = k + 1
            else:
                high = k
        if low == len(found):
            found.append(np.empty((4, p.shape[1])))
            size.append(0)
        elif size[low] == len(found[low]):
            found[low] = np.concatenate([found[low], np.empty_like(found[low])])
        found[low][size[low]] = point
        size[low] += 1
        out[i] = low + 1
    return out[own]


def fronts(rows: DataFrame, by: list[str], objectives: list[str]) -> DataFrame:
    """Adds front; rows with a null objective or one that is no number have none.

    Only a group's distinct points are ordered.  With two objectives they are sorted by Spark and
    pass by one after the other, while a task holds one value a front; with any other number the
    distinct points of a group fit in one task.
    """
    values = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in objectives]
    keys = [f"_by{i}" for i in range(len(by))]
    names = [f"_objective{i}" for i in range(len(objectives))]
    marked = rows.select("*", *(v.alias(n) for v, n in zip(values, names)))
    points = marked.select(*(F.col(c).alias(k) for c, k in zip(by, keys)), *names).dropna(subset=names).distinct()
    kept = T.StructType([*points.schema.fields, T.StructField("front", T.IntegerType())])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tails: list[float] = []
        for batch in batches:
            number = []
            for first, y in zip(batch.column("_first").to_pylist(), batch.column(names[1]).to_pylist()):
                if first:
                    tails = []
                number.append(_place(tails, y))
            columns = [*(batch.column(c) for c in kept.names[:-1]), pa.array(number, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=kept.names)

    def work(group: pa.Table) -> pa.Table:
        number = front_numbers(np.column_stack([group.column(n).to_numpy() for n in names]))
        return group.append_column("front", pa.array(number, pa.int32()))

    if len(objectives) == 2:
        first = F.row_number().over(Window.partitionBy(*keys).orderBy(*names)) == 1
        found = points.withColumn("_first", first).mapInArrow(stream, kept)
    else:
        found = points.groupBy(*keys).applyInArrow(work, kept)
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, keys)]
    found = found.withColumnsRenamed({n: f"_{n}" for n in names})
    same += [F.col(n) == F.col(f"_{n}") for n in names]
    return marked.join(found, reduce(and_, same), "left").select(*rows.columns, "front")


def ranked(rows: DataFrame, by: list[str], objective: str, tie_break: str) -> DataFrame:
    """One objective: its rank, equal ones in the order of ``tie_break``."""
    w = Window.partitionBy(*by).orderBy(F.col(objective).asc(), tie_break)
    return rows.filter(F.col(objective).isNotNull()).withColumn("front", F.row_number().over(w))
