"""Exact k-nearest-neighbour join.

The reference rows are cut into box-shaped cells of about equal size. A query is
answered from its own cell first; the distance of its k-th neighbour there then
tells which other cells can hold something nearer, and only those are visited.

A reference set whose row count is checked to be small is broadcast and searched
where the queries lie, without any shuffle. A larger one stays distributed:
queries and rows meet in co-grouped tasks by region, a run of neighbouring cells
that fills a task, however small its cells are; a busy region is split over several
tasks. Both give the same rows.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyflow.functions import cells as cell_helpers
from tallyflow.functions.cells import (
    LEAF,
    QUERIES,
    Cells,
    Index,
    Rows,
    build_cells,
    depth_for,
)
from tallyflow.schemas import FEATURES, NEIGHBORS
from tallyflow.session import materialize

# Tasks get these helpers by value, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(cell_helpers)
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NEIGHBOR_TYPE = T.ArrayType(
    T.StructType(
        [
            T.StructField("dist", T.DoubleType()),
            T.StructField("id", T.LongType()),
            T.StructField("label", T.LongType()),
        ]
    )
)
def usable(features: list[str] = FEATURES) -> Column:
    """Whether every feature is a finite number."""
    finite = [F.abs(F.col(f).cast("double")) < F.lit(float("inf")) for f in features]  # NaN is above infinity
    return F.coalesce(reduce(lambda a, b: a & b, finite), F.lit(False))


def unusable(reference: DataFrame, features: list[str] = FEATURES) -> int:
    """Reference rows that ``NeighborModel.fit`` leaves out."""
    return reference.filter(~usable(features)).count()


ROOM = 4  # times its aimed rows that a region may hold, and so many queries, before it is cut
SLICE = 256  # queries whose cells in reach a task holds at once
NO_GROUP, ANY_GROUP = -1, -2  # apart value of queries and of rows when nothing is excluded


def _neighbor_lists(n: int, query, dist, ids, labels) -> pa.ListArray:
    """One list of neighbours per query from flat arrays sorted by query."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(query, minlength=n))]).astype(np.int32)
    entries = pa.StructArray.from_arrays(
        [pa.array(dist), pa.array(ids), pa.array(labels)], names=["dist", "id", "label"]
    )
    return pa.ListArray.from_arrays(pa.array(offsets), entries)


def _matrix(columns: list) -> np.ndarray:
    """Feature columns as doubles, NULL as NaN (which is near nothing)."""
    return np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in columns])


def _rows(table: pa.Table, features: list[str]) -> Rows:
    columns = {n: table.column(n).combine_chunks() for n in [*features, "id", "label", "apart"]}
    whole = {n: columns[n].to_numpy(zero_copy_only=False) for n in ("id", "label", "apart")}
    return Rows(_matrix([columns[f] for f in features]), **whole)


class NeighborModel:
    """Stored reference rows of a nearest-neighbour classifier.

    ``cell_rows`` is the aimed size of a distributed cell, ``broadcast_rows`` the largest row count
    that is broadcast, ``max_depth`` bounds the number of cells (and with it all
    that the driver ever holds of a distributed model), ``slot_rows`` the queries and ``block_rows``
    the reference rows that meet at once. ``region_rows`` is the aimed size of a region: smaller cells travel
    together, so a query goes once to a region and not to each of its cells. A region with more than ``slot_rows``
    queries or ``block_rows`` rows, and more than ``ROOM`` times ``region_rows``, is cut over tasks on both sides;
    below that a task goes through its rows and queries by so many at a time.
    """

    def __init__(
        self,
        rows: DataFrame,
        cells: Cells,
        k: int,
        features: list[str],
        broadcast_rows: int = 200_000,
        slot_rows: int = 20_000,
        block_rows: int = 200_000,
        region_rows: int = 4096,
    ):
        self.rows, self.cells, self.k, self.features = rows, cells, k, features
        self.slot_rows, self.block_rows = slot_rows, block_rows
        self.spark: SparkSession = rows.sparkSession
        own = F.when(F.col("apart") < 0, 0).otherwise(F.count(F.lit(1))).alias("own")
        groups = rows.groupBy("cell", "apart").agg(
            F.count(F.lit(1)).alias("n"),
            own,
            *[F.min(f).alias(f"low_{f}") for f in features],
            *[F.max(f).alias(f"high_{f}") for f in features],
        )
        boxes = (
            groups.groupBy("cell")
            .agg(
                F.sum("n").alias("n"),
                F.max("own").alias("most"),
                *[F.min(f"low_{f}").alias(f"low_{f}") for f in features],
                *[F.max(f"high_{f}").alias(f"high_{f}") for f in features],
            )
            .toArrow()  # one row per cell, at most 2 ** max_depth
        )
        cell, size, most = (boxes.column(c).to_numpy().astype(np.int64) for c in ("cell", "n", "most"))
        self.count = int(size.sum())
        low = _matrix([boxes.column(f"low_{f}").combine_chunks() for f in features])
        high = _matrix([boxes.column(f"high_{f}").combine_chunks() for f in features])
        self.cells.set_boxes(cell, low, high, size, most)
        self.shift = max(0, cells.depth - depth_for(self.count, region_rows))  # a cell's number without these bits is its region's
        self.task_queries, self.task_rows = max(slot_rows, ROOM * region_rows), max(block_rows, ROOM * region_rows)
        region, own = np.unique(cell >> self.shift, return_inverse=True)
        held = np.bincount(own, size, len(region)).astype(np.int64)
        crowded = held > self.task_rows
        self.crowded = list(zip(region[crowded].tolist(), (-(-held[crowded] // self.task_rows)).tolist()))
        self.index = None
        if self.count <= broadcast_rows:
            held = Index.build(_rows(rows.toArrow(), features))
            self.index = self.spark.sparkContext.broadcast(held.state())
        else:
            self.shared_cells = self.spark.sparkContext.broadcast(self.cells.state())

    # ---- fit, save, load ----

    @classmethod
    def fit(
        cls,
        reference: DataFrame,
        k: int = NEIGHBORS,
        features: list[str] = FEATURES,
        id: str = "id",
        label: str = "prediction",
        apart: str | None = None,
        cell_rows: int = 16_384,
        max_depth: int = 17,
        sample_per_cell: int = 16,
        **limits: int,
    ) -> "NeighborModel":
        """Store the labelled rows. With ``apart``, a query skips rows of its own group.

        Of rows with equal features only the k smallest ids can ever be among the
        k nearest (ties go to the smaller id), so just those are kept. The limit is
        applied map-side too, so a vector shared by very many rows is no hot spot.
        Rows with a NULL, NaN or infinite feature are near nothing and are left out;
        ``unusable(reference)`` counts them.
        """
        rows = reference.select(
            *[F.col(f).cast("double").alias(f) for f in features],
            F.col(id).cast("bigint").alias("id"),
            F.col(label).cast("bigint").alias("label"),
            (F.col(apart).cast("bigint") if apart else F.lit(ANY_GROUP).cast("bigint")).alias("apart"),
        )
        same = Window.partitionBy(*features, "apart").orderBy("id")
        rows = rows.filter(usable(features))
        rows = rows.withColumn("copy", F.row_number().over(same)).filter(F.col("copy") <= k).drop("copy")
        rows = materialize(rows, "neighbor-rows")
        count = rows.count()
        depth = min(max_depth, depth_for(count, cell_rows))
        if depth == 0:
            empty = Cells(0, np.zeros(0, dtype=np.int64), np.zeros(0))
            return cls(rows.withColumn("cell", F.lit(0).cast("bigint")), empty, k, features, **limits)
        share = min(1.0, sample_per_cell * (1 << depth) / count)
        sample = (rows if share == 1.0 else rows.sample(share, seed=1)).select(*features).toArrow()
        cells = build_cells(_matrix([sample.column(f).combine_chunks() for f in features]), depth)
        assign = _assigner(rows.sparkSession.sparkContext.broadcast(cells.state()))
        celled = rows.withColumn("cell", assign(*features))
        return cls(materialize(celled, "neighbor-cells"), cells, k, features, **limits)

    def save(self, path: str) -> None:
        """Rows as a table, cuts and settings as one more row."""
        self.rows.write.mode("overwrite").parquet(f"{path}/rows")
        meta = [(self.k, self.features, self.cells.depth, self.cells.dims.tolist(), self.cells.cuts.tolist())]
        schema = "k int, features array<string>, depth int, dims array<bigint>, cuts array<double>"
        frame = self.spark.createDataFrame(meta, schema)
        frame.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str, **limits: int) -> "NeighborModel":
        meta = spark.read.parquet(f"{path}/meta").first()
        cells = Cells(meta.depth, np.array(meta.dims, dtype=np.int64), np.array(meta.cuts))
        return cls(spark.read.parquet(f"{path}/rows"), cells, meta.k, list(meta.features), **limits)

    # ---- search ----

    def neighbors(
        self, df: DataFrame, k: int | None = None, apart: str | None = None, answer: Callable[[Column], Column] | None = None
    ) -> DataFrame:
        """``df`` with an array ``neighbors`` of its k nearest reference rows, nearest first.

        With ``answer``, an array worked out from the neighbours takes their place. It must be empty for no neighbours; in the
        distributed plan it is worked out once for every different vector.
        """
        k = self.k if k is None else k
        if k > self.k:
            raise ValueError(f"fitted for up to {self.k} neighbours, asked for {k}")
        group = F.col(apart).cast("bigint") if apart else F.lit(NO_GROUP).cast("bigint")
        if self.index is not None:
            found = df.withColumn("neighbors", self._search_in_place(k, group))
            return found.withColumn("neighbors", answer(F.col("neighbors"))) if answer else found
        return self._search_by_cell(df, k, group, answer or (lambda neighbors: neighbors))

    def _search_in_place(self, k: int, group: Column) -> Column:
        shared = self.index

        @F.arrow_udf(NEIGHBOR_TYPE)
        def search(*columns: pa.Array) -> pa.Array:
            index = Index.restore(shared.value)
            apart = columns[-1].to_numpy(zero_copy_only=False)
            both = np.column_stack([_matrix(columns[:-1]), apart])
            distinct, back = np.unique(both, axis=0, return_inverse=True)
            query, row, dist = index.search(distinct[:, :-1], distinct[:, -1].astype(np.int64), k)
            lists = _neighbor_lists(len(distinct), query, dist, index.rows.id[row], index.rows.label[row])
            return lists.take(pa.array(back.ravel()))

        # marked so that no filter on the result is pushed down and searches a second time
        once = search.asNondeterministic()
        return once(*[F.col(f).cast("double") for f in self.features], group)

    def _search_by_cell(self, df: DataFrame, k: int, group: Column, answer: Callable[[Column], Column]) -> DataFrame:
        """Two co-grouped passes over distinct query vectors: own region, then other regions with cells in reach."""
        keyed = df.withColumn("apart", group)
        vectors = [F.col(f).cast("double").alias(f) for f in self.features]
        points = keyed.select(*vectors, "apart").dropna().distinct()
        points = points.withColumn("query", F.monotonically_increasing_id())
        points = points.withColumn("cell", _assigner(self.shared_cells)(*self.features))
        points = materialize(points, "neighbor-queries")

        home = self._meet(points.withColumns({"radius": F.lit(None).cast("double"), "region": self._region(F.col("cell"))}), k)
        if self.crowded:  # otherwise every query has met its region in one task
            home = home.groupBy("query").agg(_best("neighbors", k).alias("neighbors"))
        home = materialize(points.join(home, "query", "left"), "neighbor-home")
        kth = F.get("neighbors", F.lit(k - 1))["dist"].alias("kth")
        reach = materialize(_visits(home.select(*points.columns, kth), self.shared_cells, self.features, k, self.shift), "neighbor-reach")
        reach = reach.select(*self.features, "apart", "query", "radius", F.explode("regions").alias("region"))
        far = self._meet(reach, k)
        every = home.filter("neighbors IS NOT NULL").select("query", "neighbors").unionByName(far)
        # at most k entries per visited region and block
        lists = every.groupBy("query").agg(_best("neighbors", k).alias("neighbors"))
        answers = home.select(*self.features, "apart", "query").join(lists, "query").drop("query")
        answers = answers.select(
            *[F.col(f).alias(f"_{f}") for f in self.features], F.col("apart").alias("_apart"), answer(F.col("neighbors")).alias("neighbors")
        )
        kind = answers.schema["neighbors"].dataType
        match = [F.col(f).cast("double") == F.col(f"_{f}") for f in self.features]
        joined = keyed.join(answers, [*match, F.col("apart") == F.col("_apart")], "left")
        neighbors = F.coalesce("neighbors", F.array().cast(kind)).alias("neighbors")
        return joined.select(*[keyed[c] for c in df.columns], neighbors)

    def _region(self, cell: Column) -> Column:
        return F.shiftright(cell, self.shift)

    def _meet(self, queries: DataFrame, k: int) -> DataFrame:
        """Neighbour lists of queries (vector, apart, query, radius, region) in their regions, one per block that has any.

        Queries and rows are co-grouped by region; the queries of a busy region go to several slots, the rows of a crowded
        region to several blocks, and every slot meets every block.
        """
        most = self.task_queries
        busy = queries.groupBy("region").count().filter(F.col("count") > most)
        slots = F.broadcast(busy.select("region", F.ceil(F.col("count") / most).alias("slots")))  # at most one row per region
        blocks = F.broadcast(self.spark.createDataFrame(self.crowded, "region long, blocks long"))  # likewise
        slot_count, block_count = F.coalesce(F.col("slots"), F.lit(1)), F.coalesce(F.col("blocks"), F.lit(1))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))
        used = [*self.features, "apart", "query", "radius", "region"]
        left = queries.join(slots, "region", "left").withColumn("slot", F.pmod(F.xxhash64("query"), slot_count))
        left = left.join(blocks, "region", "left").select(*used, "slot", every(block_count).alias("block"))
        held = [*self.features, "id", "label", "apart", "region"]
        right = self.rows.withColumn("region", self._region(F.col("cell"))).join(blocks, "region", "left")
        right = right.withColumn("block", F.pmod(F.xxhash64("id", "apart"), block_count))
        right = right.join(slots, "region", "left").select(*held, "block", every(slot_count).alias("slot"))
        key = ["region", "slot", "block"]
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(self._search_task(k), T.StructType(_QUERY_FIELDS))

    def _search_task(self, k: int):
        features, at_once, block_rows = self.features, min(QUERIES, self.slot_rows), self.block_rows

        def run(queries: pa.Table, reference: pa.Table) -> pa.Table:
            n = queries.num_rows
            if n == 0 or reference.num_rows == 0:
                none = np.zeros(0, np.int64)
                return pa.table({"query": pa.array([], pa.int64()), "neighbors": _neighbor_lists(0, none, np.zeros(0), none, none)})
            index = Index.build(_rows(reference, features), min(LEAF, block_rows), block_rows)
            rows = index.rows
            x = _matrix([queries.column(f).combine_chunks() for f in features])
            order = np.argsort(index.cells.assign(x), kind="stable")  # those that meet at once lie together
            x, queries = x[order], queries.take(pa.array(order))
            radius = queries.column("radius").to_numpy()
            apart = queries.column("apart").to_numpy()
            query, row, dist = index.search(x, apart, k, None if np.isnan(radius).all() else radius, at_once)
            lists = _neighbor_lists(n, query, dist, rows.id[row], rows.label[row])
            found = pa.table({"query": queries.column("query").combine_chunks(), "neighbors": lists})
            return found.filter(pa.array(np.bincount(query, minlength=n) > 0))

        return run


def _best(lists: str, k: int) -> Column:
    return F.slice(F.sort_array(F.flatten(F.collect_list(lists))), 1, k)


def _visits(home: DataFrame, shared, features: list[str], k: int, shift: int) -> DataFrame:
    """Queries (vector, apart, query) with the ``radius`` within which they have their neighbours, and the other ``regions`` with cells in it.

    ``kth`` is the k-th distance that a query has found in its own region, if any. A task works through ``SLICE``
    queries at a time and hands them on, so what it holds does not grow with the cells.
    """
    kept = [*features, "apart", "query"]

    def visits(batches):
        cells = Cells(*shared.value)
        for whole in batches:
            for begin in range(0, len(whole), SLICE):
                batch = whole.slice(begin, SLICE)
                x, n = _matrix([batch.column(f) for f in features]), len(batch)
                apart, own, radius = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("apart", "cell", "kth"))
                radius = radius.astype(float)
                short = np.flatnonzero(np.isnan(radius))
                radius[short] = cells.reach(x[short], own[short], apart[short] >= 0, k)
                near, cell = cells.within(x, radius)
                region = cell >> shift
                other = region != own[near] >> shift
                near, region = np.divmod(np.unique(near[other] * cells.leaves + region[other]), cells.leaves)
                offsets = np.concatenate([[0], np.cumsum(np.bincount(near, minlength=n))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(region))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(radius), lists], [*kept, "radius", "regions"])

    found = [T.StructField("radius", T.DoubleType()), T.StructField("regions", T.ArrayType(T.LongType()))]
    return home.mapInArrow(visits, T.StructType([home.schema[c] for c in kept] + found))


_QUERY_FIELDS = [T.StructField("query", T.LongType()), T.StructField("neighbors", NEIGHBOR_TYPE)]


def _assigner(shared):
    @F.arrow_udf(T.LongType())
    def assign(*columns: pa.Array) -> pa.Array:
        return pa.array(Cells(*shared.value).assign(_matrix(columns)))

    return assign
