"""Exact nearest-neighbour join by pivots.

Rows are dealt to the cell of their nearest pivot, and a cell is cut by distance from its pivot into rings, a ring with many rows into parts of a
bounded size. With a pivot p, a ring's rows lie between ``lo`` and ``hi`` from p, so that by the triangle inequality none is nearer to a query q
than max(lo - d(q, p), d(q, p) - hi); nor, as p is the nearest pivot of its rows, than (d(q, p) - d(q, p')) (d(q, p) + d(q, p')) / 2 d(p, p') for any other pivot p'.

1. A query's first bound: the k rows of the cells with the least d(q, p) + hi are no farther than the last of these.
2. Queries meet the ring of their own cell that is nearest; the k-th distance there is the second bound.
3. Queries meet the rings that neither inequality rules out. Rings and queries meet by key, in groups of a bounded size.

Rows and queries are never all paired, unless the vectors leave no ring that can be ruled out.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A bound counts as reached if it is this share nearer or farther, as sums of doubles are rounded.
SLACK = 1e-9


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """(rows, points): Euclidean distances in double precision, a point at a time."""
    return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in points], axis=1) if len(points) else np.empty((len(x), 0))


#: Points that meet the rows at once.
POINTS = 512


def k_nearest(x: np.ndarray, points: np.ndarray, k: int, most: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point, row, distance): the ``k`` rows of ``x`` nearest to each point, nearest first, ties by the row's place. Of a point with a bound ``most``, rows farther than it may be missing.

    All distances are estimated by one product of matrices. Pairs that the estimate's rounding leaves in doubt are few; these alone are summed, component by component in order.
    """
    most = np.full(len(points), np.inf) if most is None else most
    eps, columns, out = 8 * (x.shape[1] + 8) * np.finfo(np.float64).eps, np.ascontiguousarray(x.T), []
    with np.errstate(all="ignore"):  # what is not finite is never ruled out
        xx = (x * x).sum(axis=1)
        for i in range(0, len(points) if len(x) else 0, POINTS):
            p = points[i : i + POINTS]
            size = (p * p).sum(axis=1)[:, None] + xx
            about = size - 2 * (p @ columns)
            size = size * eps + 1e-300
            upto = most[i : i + POINTS] ** 2
            if len(x) > k and not np.isfinite(upto).all():
                high = np.partition(about + size, k - 1, axis=1)[:, k - 1]
                upto = np.fmin(upto, np.where(np.isnan(high), np.inf, high))
            a, b = np.nonzero(~(about - size > upto[:, None]))
            d = np.zeros(len(a))
            for c, y in zip(columns, p.T):
                e = c[b] - y[a]
                d += e * e
            d = np.sqrt(d)
            order = np.lexsort((b, d, a))
            n = np.bincount(a, minlength=len(p))
            keep = order[np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) < k]
            keep = keep[~(d[keep] > most[i : i + POINTS][a[keep]])]
            out.append((a[keep] + i, b[keep], d[keep]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(z) for z in zip(*out))


def spread(sample: np.ndarray, n: int) -> np.ndarray:
    """``n`` of the sample's points (fewer if they are equal), each the farthest from those before."""
    chosen, far = [0], distances(sample, sample[:1])[:, 0]
    while len(chosen) < n and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


@dataclass
class PivotJoin:
    """The ``k`` nearest ``vectors`` of each of ``queries``, both (key, vector); see ``result``.

    Vectors that are null, empty, hold null or non-finite components, or are of another length than most of the sample take no part, nor do rows without a key. ``pivots`` are
    chosen among ``sample`` rows that come first by the hash of their key; both are bounds whatever the number of rows. A ring's part has about
    ``block`` rows, and at most about ``meet`` queries meet it in one group.
    """

    vectors: DataFrame
    queries: DataFrame
    k: int = 3
    key: str = "vec_id"
    vector: str = "embedding"
    pivots: int = 48
    sample: int = 1024
    block: int = 2048
    meet: int = 2048
    points: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        drawn = self._clean(self.vectors).orderBy(F.xxhash64("id"), "id").limit(self.sample).select("v").collect()  # ``sample`` rows
        sizes = [len(r["v"]) for r in drawn]
        self.size = max(set(sizes), key=lambda n: (sizes.count(n), n)) if sizes else 0
        held = np.array([r["v"] for r in drawn if len(r["v"]) == self.size], np.float64).reshape(-1, max(self.size, 1))
        self.points = spread(np.unique(held, axis=0), self.pivots) if len(held) else held
        own = distances(held, self.points).min(axis=1) if len(held) else np.zeros(1)
        if not len(held):
            self.points = np.empty((0, 1))
        self.width = max(float(own.max()) / 64, 1e-300)  # of the bins that rings are made of
        self.dealt = self._dealt(self._clean(self.vectors))
        self.bins = self.dealt.groupBy("cell", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi"))
        if len(self.points):
            self.rings = self._rings().persist()  # small beside the rows, and read by each step
            self.asked = self._bounded().persist()

    def _clean(self, df: DataFrame) -> DataFrame:
        v = F.col(self.vector).cast("array<double>")
        sound = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        out = df.select(F.col(self.key).alias("id"), v.alias("v")).where(sound & (F.size(v) > 0) & F.col("id").isNotNull())
        return out.where(F.size("v") == self.size) if hasattr(self, "size") else out

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """(id, v, cell, d, bin): the nearest pivot, the distance from it and its bin."""
        points = self.points

        @F.pandas_udf("cell int, d double")
        def nearest(v: pd.Series) -> pd.DataFrame:
            d = distances(np.stack(v.to_numpy()), points) if len(v) else np.zeros((0, 1))
            return pd.DataFrame({"cell": d.argmin(axis=1), "d": d.min(axis=1)})

        at = rows.withColumn("p", nearest("v"))
        return at.select("id", "v", "p.cell", "p.d", F.least(F.floor(F.col("p.d") / self.width), F.lit(1 << 20)).cast("int").alias("bin"))

    def _rings(self) -> DataFrame:
        """(cell, bin, ring, n, lo, hi, parts): bins joined to rings of about ``block`` rows, and those numbers of the whole ring."""
        upto = F.sum("n").over(Window.partitionBy("cell").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        r = self.bins.withColumn("ring", F.floor((upto - F.col("n")) / self.block).cast("int"))
        w = Window.partitionBy("cell", "ring")
        r = r.select("cell", "bin", "ring", F.sum("n").over(w).alias("n"), F.min("lo").over(w).alias("lo"), F.max("hi").over(w).alias("hi"))
        return r.withColumn("parts", F.ceil(F.col("n") / self.block).cast("int"))

    def _bounded(self) -> DataFrame:
        """(query_id, q, theta, cells): each query's first bound, and (cell, d, least, own) of the cells that may hold nearer rows."""
        cells = self.rings.select("cell", "ring", "n", "hi").distinct().groupBy("cell").agg(F.sum("n").alias("n"), F.max("hi").alias("hi")).collect()  # a row a pivot
        n, hi = np.zeros(len(self.points)), np.zeros(len(self.points))
        for r in cells:
            n[r["cell"]], hi[r["cell"]] = r["n"], r["hi"]
        points, k, apart = self.points, self.k, distances(self.points, self.points)

        @F.pandas_udf("theta double, cells array<struct<cell:int,d:double,least:double,own:boolean>>")
        def bound(v: pd.Series) -> pd.DataFrame:
            d = distances(np.stack(v.to_numpy()), points)
            reach = np.where(n > 0, d + hi, np.inf)
            order = np.argsort(reach, axis=1)
            enough = np.cumsum(n[order], axis=1) >= k
            last = np.where(enough.any(axis=1), enough.argmax(axis=1), len(points) - 1)
            theta = np.where(enough.any(axis=1), np.take_along_axis(reach, np.take_along_axis(order, last[:, None], 1), 1)[:, 0], np.inf)
            out = []
            for x, t in zip(d, theta):
                home = int(np.argmin(np.where(n > 0, x, np.inf)))
                with np.errstate(divide="ignore", invalid="ignore"):
                    half = np.where(apart > 0, (x[:, None] - x[None, :]) * (x[:, None] + x[None, :]) / (2 * apart), 0).max(axis=1)
                least = np.maximum(np.maximum(x - hi, half), 0) * (1 - SLACK) - SLACK
                may = np.flatnonzero((n > 0) & (least <= t))
                out.append([{"cell": int(c), "d": float(x[c]), "least": float(least[c]), "own": int(c) == home} for c in may])
            return pd.DataFrame({"theta": theta, "cells": out})

        q = self._clean(self.queries)
        return q.withColumn("b", bound("v")).select(F.col("id").alias("query_id"), F.col("v").alias("q"), "b.theta", "b.cells")

    def first(self) -> DataFrame:
        """(query_id, q, cell, ring): the ring of the query's own cell that is nearest to it."""
        own = self.asked.select("query_id", "q", F.explode("cells").alias("c")).where("c.own").select("query_id", "q", F.col("c.cell").alias("cell"), F.col("c.d").alias("x"))
        gap = F.greatest(F.col("lo") - F.col("x"), F.col("x") - F.col("hi"), F.lit(0.0))
        r = self.rings.select("cell", "ring", "lo", "hi").distinct()
        near = own.join(r, "cell").groupBy("query_id", "cell").agg(F.min_by("q", F.struct(gap, "ring")).alias("q"), F.min_by("ring", F.struct(gap, "ring")).alias("ring"))
        return near.select("query_id", "q", "cell", "ring")

    def rest(self, met: DataFrame, first: DataFrame) -> DataFrame:
        """(query_id, q, cell, ring): the other rings that may hold one of the query's ``k`` nearest, given those ``met`` (query_id, id, distance)."""
        known = met.groupBy("query_id").agg(F.get(F.array_sort(F.collect_list("distance")), F.lit(self.k - 1)).alias("t"))  # k of each part
        q = self.asked.join(known, "query_id", "left").withColumn("t", F.least("theta", F.coalesce("t", F.lit(float("inf")))))
        q = q.select("query_id", "q", "t", F.explode("cells").alias("c")).where("c.least <= t")
        r = self.rings.select("cell", "ring", "lo", "hi").distinct()
        j = q.join(r, F.col("c.cell") == F.col("cell"))
        least = F.greatest(F.col("lo") - F.col("c.d"), F.col("c.d") - F.col("hi")) * (1 - SLACK) - SLACK
        return j.where(least <= F.col("t")).join(first.select("query_id", "cell", "ring"), ["query_id", "cell", "ring"], "left_anti").select("query_id", "q", "cell", "ring")

    def nearest(self, pairs: DataFrame) -> DataFrame:
        """(query_id, id, distance): of each part of the rings that a query meets (``pairs``) its ``k`` nearest rows."""
        k = self.k
        r = self.rings
        groups = pairs.groupBy("cell", "ring").agg(F.ceil(F.count(F.lit(1)) / self.meet).cast("int").alias("shares"))
        parts = r.select("cell", "ring", "parts").distinct().join(groups, ["cell", "ring"])
        rows = self.dealt.join(r.select("cell", "bin", "ring"), ["cell", "bin"]).join(parts, ["cell", "ring"])
        rows = rows.withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")))
        rows = rows.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).select("cell", "ring", "part", "share", "id", "v")
        q = pairs.join(parts, ["cell", "ring"]).withColumn("share", F.pmod(F.xxhash64("query_id", F.lit(2)), F.col("shares")).cast("int"))
        q = q.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1))).select("cell", "ring", "part", "share", "query_id", "q")
        on = ["cell", "ring", "part", "share"]
        kind = self.vectors.schema[self.key].dataType.simpleString()

        def met(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            if own.empty or asked.empty:
                return pd.DataFrame({"query_id": asked["query_id"][:0], "id": own["id"][:0], "distance": np.empty(0)})
            own = own.sort_values("id", kind="stable")
            a, b, d = k_nearest(np.stack(own["v"].to_numpy()), np.stack(asked["q"].to_numpy()), k)
            return pd.DataFrame({"query_id": asked["query_id"].to_numpy()[a], "id": own["id"].to_numpy()[b], "distance": d})

        return rows.groupBy(*on).cogroup(q.groupBy(*on)).applyInPandas(met, f"query_id {kind}, id {kind}, distance double")

    def result(self) -> DataFrame:
        """(query_id, key, distance, rank): ranks from 1, ties by the smaller key; fewer rows where there are fewer than ``k``. Rows that share a key each count."""
        if not len(self.points):
            return self.dealt.select(F.col("id").alias("query_id"), F.col("id").alias(self.key), F.col("d").alias("distance"), F.lit(0).alias("rank")).limit(0)
        first = self.first()
        met = self.nearest(first).persist()
        both = met.unionByName(self.nearest(self.rest(met, first)))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
        return both.withColumn("rank", rank).where(F.col("rank") <= self.k).select("query_id", F.col("id").alias(self.key), "distance", "rank")

    def compared(self) -> DataFrame:
        """One row: n, the pairs of a query and a row that are compared, and every, those there are."""
        first = self.first()
        pairs = first.unionByName(self.rest(self.nearest(first), first))
        sizes = self.rings.select("cell", "ring", F.col("n").alias("rows")).distinct()
        n = pairs.join(sizes, ["cell", "ring"]).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n"))
        every = self._clean(self.queries).agg(F.count(F.lit(1)).alias("a")).crossJoin(self._clean(self.vectors).agg(F.count(F.lit(1)).alias("b")))  # two single rows
        return n.crossJoin(every.select((F.col("a") * F.col("b")).alias("every")))


def knn_join(vectors: DataFrame, queries: DataFrame, k: int = 3, key: str = "vec_id", vector: str = "embedding", **sizes: int) -> DataFrame:
    """The ``k`` nearest rows of each query, exactly; see ``PivotJoin``. Without vectors no rows."""
    return PivotJoin(vectors, queries, k, key, vector, **sizes).result()

