"""Exact top-k search by inner product: a ball tree per shard, searched by branch and bound.

Rows are dealt to the nearest of some pivot vectors, and the rows of a pivot's ball to shards of a bounded size by a hash, so equal vectors
spread. The balls are a small table that bounds what a query can find in each. A query goes to its most promising ball first, then to a
few more, then to the rest, in rounds: after each its kth score so far is shared, and balls whose bound stays below it aren't visited. In a shard
the nodes are visited by falling upper bound of the inner product (centre product plus query norm times radius), each with
the queries whose current kth score the bound still reaches.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import cut_lineage

SHARD_ROWS, BLOCK_QUERIES, LEAF_ROWS = 16_384, 32_768, 64
NONE = np.iinfo(np.int64).min
LAST = np.iinfo(np.int64).max
HITS = "query_row long, vec_id long, score long"
#: Most balls of vectors of one length, and the places, by falling bound, of the balls that a query visits in each round.
BALLS, ROUNDS = 1024, ((0, 1), (1, 8), (8, None))
#: Whole numbers below this are exact as floating-point numbers.
EXACT = 2**53


class BallTree:
    """Nodes over rows that are reordered so that each node owns a range of them."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        """rows: a number of its own for each row; vectors: whole numbers."""
        self.order = np.arange(len(ids))
        self.nodes: list[tuple] = []  # (low, high, centre, radius, smallest id, children)
        self.far = int(max(vectors.max(initial=0), -vectors.min(initial=0)))
        self.vectors, self.ids = vectors.astype(float), ids
        self._build(0, len(ids))
        self.rows, self.ids, self.whole = rows[self.order], ids[self.order], vectors[self.order]
        self.vectors = self.vectors[self.order]

    def _build(self, low: int, high: int) -> int:
        rows = self.order[low:high]
        points = self.vectors[rows]
        centre = points.mean(axis=0)
        away = np.linalg.norm(points - centre, axis=1)
        node, radius = len(self.nodes), float(away.max()) if (points != points[0]).any() else 0.0
        if not radius:
            centre = points[0]
        self.nodes.append(())
        children: tuple = ()
        if high - low > LEAF_ROWS:
            one = points[away.argmax()]
            other = points[np.linalg.norm(points - one, axis=1).argmax()]
            self.order[low:high] = rows[np.lexsort((self.ids[rows], points @ (other - one)))]
            middle = (low + high) // 2
            children = self._build(low, middle), self._build(middle, high)
        self.nodes[node] = (low, high, centre, radius, int(self.ids[rows].min()), children)
        return node

    def search(self, query_rows: np.ndarray, whole: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores), each (queries, k), best first, NONE where fewer; rows below a query's floor may be left out.

        Products that may pass 2^53 are taken in 64-bit whole numbers, whose overflows cancel out where the sum fits; bounds then get some slack.
        """
        queries = whole.astype(float)
        small = whole.shape[1] * self.far * int(max(whole.max(initial=0), -whole.min(initial=0))) < EXACT
        ids = np.full((len(queries), k), LAST)
        scores = np.full((len(queries), k), NONE)
        norms = np.linalg.norm(queries, axis=1)
        count = 0
        heap = [(0.0, count, 0, np.arange(len(queries)))]
        while heap:
            _, _, node, active = heapq.heappop(heap)
            low, high, centre, radius, least, children = self.nodes[node]
            bound = queries[active] @ centre
            slack = 0.0 if small else norms[active] * float(np.linalg.norm(centre)) * 1e-9
            bound += norms[active] * radius * (1 + 1e-9) + (abs(bound) * 1e-9 + 1e-3) * (radius > 0) + slack
            kth = np.maximum(scores[active, -1], floor[active]).astype(float)
            tied = (bound == kth) & ((least < ids[active, -1]) | (scores[active, -1] < floor[active]))
            go = (bound > kth) | tied
            active, bound = active[go], bound[go]
            if not len(active):
                continue
            if children:
                for child in children:
                    _, _, c, r, _, _ = self.nodes[child]
                    count += 1
                    heapq.heappush(heap, (-float((queries[active] @ c + norms[active] * r).max()), count, child, active))
                continue
            found = np.rint(queries[active] @ self.vectors[low:high].T).astype(np.int64) if small else whole[active] @ self.whole[low:high].T
            found[query_rows[active][:, None] == self.rows[low:high]] = NONE
            better = np.flatnonzero(found.max(axis=1) >= np.maximum(scores[active, -1], floor[active]))
            rows = active[better]
            all_scores = np.concatenate([scores[rows], found[better]], axis=1)
            all_ids = np.concatenate([ids[rows], np.where(found[better] == NONE, LAST, self.ids[low:high])], axis=1)
            first = np.lexsort((all_ids, ~all_scores), axis=-1)[:, :k] if k else all_ids[:, :0]
            ids[rows] = np.take_along_axis(all_ids, first, axis=1)
            scores[rows] = np.take_along_axis(all_scores, first, axis=1)
        return ids, scores


def _matrix(rows: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    values = np.asarray(pc.list_flatten(rows.column(name)), dtype=np.int64)
    n = rows.num_rows
    return values.reshape(n, -1) if n else values.reshape(0, 0)


def _searched(k: int) -> Callable:
    """Search of one group: its rows with a null floor are the shard, the others are queries."""

    def run(group: pa.Table) -> pa.Table:
        asks = group.column("floor").is_valid()
        rows, queries = group.filter(pc.invert(asks)), group.filter(asks)
        names = [x.split()[0] for x in HITS.split(", ")]
        if not len(rows) or not len(queries):
            return pa.table([pa.array([], pa.int64())] * 3, names)
        tree = BallTree(rows.column("row").to_numpy(), rows.column("id").to_numpy(), _matrix(rows, "vector"))
        keys = queries.column("row").to_numpy()
        ids, scores = tree.search(keys, _matrix(queries, "vector"), queries.column("floor").to_numpy(), k)
        row, at = np.nonzero(scores > NONE)
        return pa.table([keys[row], ids[row, at], scores[row, at]], names)

    return run


class Balls:
    """Pivots of the vectors of one length, and the radius of the ball around each, null while it isn't known."""

    def __init__(self, pivots: np.ndarray, radius: np.ndarray | None = None):
        self.pivots, self.radius = pivots, radius

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ball, distance) of each vector."""
        at, away = np.zeros(len(vectors), dtype=np.int32), np.zeros(len(vectors))
        squares = (self.pivots**2).sum(axis=1)
        for low in range(0, len(vectors), LEAF_ROWS * 16):
            part = vectors[low : low + LEAF_ROWS * 16]
            at[low : low + len(part)] = (squares - 2 * part @ self.pivots.T).argmin(axis=1)
            away[low : low + len(part)] = np.linalg.norm(part - self.pivots[at[low : low + len(part)]], axis=1)
        return at, away

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """No score of a query with a row of a ball is above this; -inf for balls without rows."""
        norms = np.linalg.norm(queries, axis=1)[:, None]
        sizes = np.linalg.norm(self.pivots, axis=1) + self.radius
        bound = queries @ self.pivots.T + norms * self.radius
        return np.where(self.radius >= 0, bound + norms * np.maximum(sizes, 0) * 1e-9 + 1e-3, -np.inf)


def _placed(balls: dict[int, Balls]):
    """Rows with the ball that they lie in and their distance from its pivot; lengths without pivots are one ball."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            cell, away = np.zeros(batch.num_rows, dtype=np.int32), np.zeros(batch.num_rows)
            for size in set(sizes.tolist()) & set(balls):
                at = np.flatnonzero(sizes == size)
                cell[at], away[at] = balls[size].nearest(_matrix(batch.take(pa.array(at)), "vector").astype(float))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(away)], [*batch.schema.names, "cell", "away"])

    return run


def _visits(balls: dict[int, Balls], low: int, high: int | None):
    """Each query with the balls that it visits in a round: those at these places by falling bound, as far as the bound reaches its floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                sizes, floor = part.column("size").to_numpy(), part.column("floor").to_numpy().astype(float)
                single = np.flatnonzero(~np.isin(sizes, list(balls))) if low == 0 else np.zeros(0, dtype=np.int64)
                rows, cells = [single], [np.zeros(len(single), dtype=np.int64)]
                for size in set(sizes.tolist()) & set(balls):
                    at = np.flatnonzero(sizes == size)
                    bound = balls[size].bounds(_matrix(part.take(pa.array(at)), "vector").astype(float))
                    order = np.argsort(-bound, axis=1, kind="stable")[:, low:high]
                    goes = np.take_along_axis(bound, order, axis=1)
                    i, j = np.nonzero((goes > -np.inf) & (goes >= floor[at][:, None]))
                    rows.append(at[i])
                    cells.append(order[i, j])
                chosen = part.take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([*chosen.columns, pa.array(np.concatenate(cells), pa.int32())], [*part.schema.names, "cell"])

    return run


def _matrix_of(rows: list) -> np.ndarray:
    """Different vectors of a list, as floating-point numbers."""
    return np.unique(np.array(rows, dtype=float), axis=0)


def usable(column: str) -> Column:
    """Vectors without a null, infinite or undefined component, and not null themselves."""
    return F.coalesce(F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "vector") -> DataFrame:
    """(query_id, rank, vec_id, score, query_copy): the k best rows for each query row, by inner product, ties to the smaller id.

    vectors: an id and an array of whole numbers. Rows with a null id or an unusable vector take no part, nor do vectors whose squared length
    reaches 2^62; all products of the others are exact. A query meets only vectors of its own length. Only the query's own row is no candidate:
    each repeated row counts, and so do other rows of the query's id. query_copy tells query rows of one id apart, from 0 by rising vector.
    A query with fewer than k candidates gets all; without any it has no row. A null is_query is false.
    """
    vector = F.col(vector_col)
    fits = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) < 2.0**62
    rows = vectors.where(F.col(id_col).isNotNull() & usable(vector_col)).where(fits)
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector, lambda x: x.cast("long")).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    rows = cut_lineage(rows.withColumn("size", F.size("vector")).withColumn("row", F.monotonically_increasing_id()))
    sizes = rows.groupBy("size").agg(F.count("*").alias("n"), F.count_if("is_query").alias("q"))
    balls, rows, subs = _balls(rows, sizes)
    rows = rows.join(F.broadcast(subs), ["size", "cell"], "left").withColumn("subs", F.coalesce("subs", F.lit(1)))
    blocks = sizes.select("size", F.ceil(F.greatest("q", F.lit(1)) / BLOCK_QUERIES).cast("int").alias("blocks"))
    stored = rows.withColumn("sub", F.pmod(F.xxhash64("row"), F.col("subs")).cast("int")).join(F.broadcast(blocks), "size")
    asked = rows.where("is_query").select("size", "vec_id", "row", "vector")
    hits = rows.sparkSession.createDataFrame([], HITS)
    for low, high in ROUNDS:
        visits = visited(asked, hits, balls, k, low, high).join(F.broadcast(subs), ["size", "cell"], "left").join(F.broadcast(blocks), "size")
        places = F.sequence(F.lit(0), F.coalesce("subs", F.lit(1)) - 1)
        block = F.pmod(F.xxhash64("row", F.lit(1)), F.col("blocks")).cast("int")
        sent = visits.withColumn("block", block).withColumn("sub", F.explode(places))
        wanted = sent.select("size", "cell", "block").distinct()
        dealt = stored.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(wanted, ["size", "cell", "block"], "left_semi")
        columns = ["size", "cell", "sub", "block", F.col("vec_id").alias("id"), "row", "vector", "floor"]
        both = dealt.withColumn("floor", F.lit(None).cast("long")).select(*columns).union(sent.select(*columns))
        found = both.groupBy("size", "cell", "sub", "block").applyInArrow(_searched(k), HITS)
        best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
        hits = cut_lineage(hits.unionByName(found).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank"))
    ranked = hits.withColumn("rank", F.row_number().over(best))
    copy = F.row_number().over(Window.partitionBy("vec_id").orderBy("size", "vector", "row")) - 1
    asking = rows.where("is_query").select(F.col("vec_id").alias("query_id"), F.col("row").alias("query_row"), copy.alias("query_copy"))
    return ranked.join(asking, "query_row").select("query_id", "rank", "vec_id", "score", "query_copy")


def visited(asked: DataFrame, hits: DataFrame, balls: dict[int, Balls], k: int, low: int, high: int | None) -> DataFrame:
    """(size, vec_id, row, vector, floor, cell): the balls that each query (size, vec_id, row, vector) visits in a round, given its hits so far."""
    none = F.lit(int(NONE))
    floors = hits.groupBy(F.col("query_row").alias("row")).agg(F.when(F.count("*") >= k, F.min("score")).otherwise(none).alias("kth"))
    informed = asked.join(floors, "row", "left").select("size", "vec_id", "row", "vector", F.coalesce("kth", none).alias("floor"))
    return informed.mapInArrow(_visits(balls, low, high), "size int, vec_id long, row long, vector array<long>, floor long, cell int")


def _balls(rows: DataFrame, sizes: DataFrame) -> tuple[dict[int, Balls], DataFrame, DataFrame]:
    """(balls by length, rows with cell and away, shards of each ball). Lengths whose rows fit one shard have none.

    Pivots are the rows of the smallest hashes, as many as there are shards, `BALLS` of a length at most; they and the balls' radii reach the driver.
    """
    many = sizes.where(F.col("n") > SHARD_ROWS).select("size", F.least(F.ceil(F.col("n") / SHARD_ROWS), F.lit(BALLS)).alias("pivots"))
    place = F.row_number().over(Window.partitionBy("size").orderBy(F.xxhash64("vector"), "row"))
    picked = rows.join(F.broadcast(many), "size").withColumn("_place", place).where(F.col("_place") <= F.col("pivots"))
    by_size: dict[int, list] = {}
    for r in picked.select("size", "vector").collect():
        by_size.setdefault(r["size"], []).append(r["vector"])
    balls = {size: Balls(_matrix_of(v)) for size, v in by_size.items()}
    schema = "vec_id long, vector array<long>, is_query boolean, size int, row long, cell int, away double"
    placed = cut_lineage(rows.select("vec_id", "vector", "is_query", "size", "row").mapInArrow(_placed(balls), schema))
    known = cut_lineage(placed.join(F.broadcast(many.select("size")), "size").groupBy("size", "cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")))
    for ball in balls.values():
        ball.radius = np.full(len(ball.pivots), -1.0)
    for r in known.collect():
        balls[r["size"]].radius[r["cell"]] = r["radius"] * (1 + 1e-9)
    return balls, placed, known.select("size", "cell", F.ceil(F.col("n") / SHARD_ROWS).cast("int").alias("subs"))
