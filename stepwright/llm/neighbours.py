"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, results of shards merged."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_batches, stash, table

TOP = 10
EVERY = 100  # rows whose vec_id this divides are queries
SHARD_NODES = 8192  # distinct vectors of a shard, about
LINKS = 16  # neighbours of a node; twice as many on the lowest level
BEAM_BUILD, BEAM_SEARCH = 96, 192  # nodes that a search keeps
BATCH = 256  # nodes that are inserted, or queries that are searched, together
STEP = 4  # nodes of each search that are expanded at once
BLOCK_BYTES = 8 << 20  # of query vectors that are sent to the executors together

_NO = np.inf


class Graph:
    """Nodes are ordered by descending level, so that a level's nodes are the first `sizes[level]`; links[level] is an array
    (nodes, neighbours), unused places -1."""

    def __init__(self, vectors: np.ndarray, sizes: list[int], links: list[np.ndarray]) -> None:
        self.x = vectors
        self.norm = np.einsum("ij,ij->i", self.x, self.x)
        self.sizes, self.links = sizes, links

    def distances(self, q: np.ndarray, row: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Squared distances of pairs (query row, node)."""
        d = self.x[node]
        d -= q[row]
        return np.einsum("ij,ij->i", d, d)

    def descend(self, q: np.ndarray, level: int) -> np.ndarray:
        """A near node on `level` for each query, by greedy steps from the topmost level down."""
        at = np.zeros(len(q), np.int64)
        best = self.distances(q, np.arange(len(q)), at)
        for links in self.links[:level - 1:-1] if level else self.links[::-1]:
            moving = np.arange(len(q))
            while len(moving):
                near = links[at[moving]]
                row, place = np.nonzero(near >= 0)
                d = np.full(near.shape, _NO)
                d[row, place] = self.distances(q, moving[row], near[row, place])
                j = d.argmin(1)
                better = d[np.arange(len(moving)), j] < best[moving]
                moving, near, j, d = moving[better], near[better], j[better], d[better]
                at[moving], best[moving] = near[np.arange(len(moving)), j], d[np.arange(len(moving)), j]
        return at

    def beam(self, q: np.ndarray, entries: np.ndarray, links: np.ndarray, width: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(distances, nodes), ascending, of the `width` best of the first n nodes that a best-first search from the entries meets; free places have node -1."""
        rows = np.arange(len(q))[:, None]
        seen = np.zeros((len(q), n + 1), bool)  # the last place takes the unused ones
        seen[:, n] = True
        best_d, best_i = np.full((len(q), width), _NO), np.full((len(q), width), -1, np.int64)
        spent = np.ones((len(q), width), bool)
        new = entries
        while True:
            new = np.sort(np.where(new < 0, n, new), axis=1)
            fresh = ~seen[rows, new]
            fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
            row, place = np.nonzero(fresh)
            node = new[row, place]
            seen[row, node] = True
            d = np.full(new.shape, _NO)
            d[row, place] = self.distances(q, row, node)
            best_d, best_i = np.concatenate([best_d, d], 1), np.concatenate([best_i, np.where(fresh, new, -1)], 1)
            spent = np.concatenate([spent, ~fresh], 1)
            keep = np.argpartition(best_d, width - 1, axis=1)[:, :width]
            best_d, best_i, spent = best_d[rows, keep], best_i[rows, keep], spent[rows, keep]
            open_d = np.where(spent, _NO, best_d)
            next_ = np.argpartition(open_d, min(STEP, width) - 1, axis=1)[:, : min(STEP, width)]
            going = open_d[rows, next_] < _NO
            if not going.any():
                order = np.argsort(best_d, axis=1, kind="stable")
                return best_d[rows, order], best_i[rows, order]
            spent[rows, next_] = True
            nodes = best_i[rows, next_]
            new = np.where(going[:, :, None], links[np.where(going, nodes, 0)], -1).reshape(len(q), -1)

    def chosen(self, d: np.ndarray, i: np.ndarray, most: int) -> np.ndarray:
        """Of ascending candidates (distances, nodes, -1 unused) the neighbours to keep, `most` places: first those nearer to the node
        than to any kept before them, then the nearest of the rest."""
        n, width = i.shape
        v, norm = self.x[np.maximum(i, 0)], self.norm[np.maximum(i, 0)]
        between = norm[:, :, None] + norm[:, None, :] - 2 * (v @ v.transpose(0, 2, 1))
        out, there = np.zeros((n, width), bool), i >= 0
        shadowed, count = ~there, np.zeros(n, np.int64)
        for c in range(width):
            ok = ~shadowed[:, c] & (count < most)
            out[:, c] = ok
            count += ok
            shadowed |= ok[:, None] & (between[:, c] < d)
        place = np.where(out, 0, np.where(there, 1, 2)) * width + np.arange(width)
        order = np.argsort(place, axis=1)[:, :most]
        kept = np.take_along_axis(np.where(there, i, -1), order, 1)
        return np.pad(kept, ((0, 0), (0, most - kept.shape[1])), constant_values=-1)

    def insert(self, links: np.ndarray, first: int, last: int, d: np.ndarray, i: np.ndarray) -> None:
        """Link the nodes first..last to the best of their candidates, and these back to them."""
        most = links.shape[1]
        links[first:last, :LINKS] = self.chosen(d[:, : 4 * LINKS], i[:, : 4 * LINKS], LINKS)
        row, place = np.nonzero(links[first:last] >= 0)
        target, source = links[first:last][row, place], row + first
        order = np.lexsort((source, target))
        target, source = target[order], source[order]
        nodes, begin, count = np.unique(target, return_index=True, return_counts=True)
        at = np.arange(len(target)) - np.repeat(begin, count)
        for low in range(0, len(nodes), BATCH):
            own = nodes[low : low + BATCH]
            part = slice(begin[low], begin[low] + count[low : low + BATCH].sum())
            both = np.full((len(own), most + int(count[low : low + BATCH].max())), -1, np.int64)
            both[:, :most] = links[own]
            both[np.repeat(np.arange(len(own)), count[low : low + BATCH]), most + at[part]] = source[part]
            # a batch's nodes may have chosen each other
            both.sort(axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            r, p = np.nonzero(both >= 0)
            far = np.full(both.shape, _NO)
            far[r, p] = self.distances(self.x[own], r, both[r, p])
            order = np.argsort(far, axis=1, kind="stable")
            far, both = np.take_along_axis(far, order, 1), np.take_along_axis(both, order, 1)
            full = (both >= 0).sum(1) > most
            links[own[~full]] = np.pad(both[~full], ((0, 0), (0, max(0, most - both.shape[1]))), constant_values=-1)[:, :most]
            if full.any():
                links[own[full]] = self.chosen(far[full][:, : 2 * most], both[full][:, : 2 * most], most)

    def build(self) -> None:
        """Levels from the topmost down; each level's nodes in batches, whose entries come from the levels above."""
        made: list[np.ndarray] = []
        for level in range(len(self.sizes) - 1, -1, -1):
            n, above = self.sizes[level], self.sizes[level + 1] if level + 1 < len(self.sizes) else 0
            links = np.full((n, LINKS * (1 if level else 2)), -1, np.int64)
            first = 0
            while first < n:
                last = min(first + max(1, min(BATCH, max(first, 32))), n)
                if first < above:
                    last = min(last, above)
                q = self.x[first:last]
                own = np.arange(first, last)
                if first == 0:
                    d, i = np.empty((len(q), 0)), np.empty((len(q), 0), np.int64)
                else:
                    if first < above:
                        near = made[0][first:last]
                        entries = np.concatenate([np.where(near < first, near, -1), np.zeros((len(q), 1), np.int64)], 1)
                    elif above:
                        self.links = made
                        entries = self.descend(q, 0)[:, None]
                    else:
                        entries = np.zeros((len(q), 1), np.int64)
                    d, i = self.beam(q, entries, links, BEAM_BUILD, first)
                among = np.nan_to_num(np.maximum(self.norm[own][:, None] + self.norm[own] - 2 * (q @ q.T), 0), nan=_NO, posinf=_NO)
                np.fill_diagonal(among, _NO)
                d = np.concatenate([d, among], 1)
                i = np.concatenate([i, np.where(np.eye(len(q), dtype=bool), -1, own)], 1)
                order = np.argsort(d, axis=1, kind="stable")
                self.insert(links, first, last, np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1))
                first = last
            made.insert(0, links)
        self.links = made

    def nearest(self, q: np.ndarray, width: int) -> np.ndarray:
        """Nodes (queries, width), -1 unused, that a search of the whole graph keeps."""
        n = self.sizes[0]
        if n <= width:  # the beam holds all nodes
            return np.tile(np.arange(n), (len(q), 1))
        parts = [q[k : k + BATCH] for k in range(0, len(q), BATCH)]
        return np.concatenate([self.beam(p, self.descend(p, 1)[:, None], self.links[0], width, n)[1] for p in parts])


def draw_levels(n: int, seed: int) -> list[int]:
    """How many nodes have a level of 0, 1, ... or more: a node's level is the whole part of -ln(u) / ln(LINKS)."""
    levels = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / math.log(LINKS)).astype(int)
    return [int((levels >= k).sum()) for k in range(levels.max() + 1)] if n else []


_GRAPH = "shard long, dim int, sizes array<int>, vectors binary, links array<binary>, ids array<array<long>>"


def nodes(vectors: DataFrame, top: int) -> DataFrame:
    """v array<double>, ids: each distinct vector that takes part, with the least top + 1 ids of its rows, ascending, null last."""
    order = Window.partitionBy("v").orderBy(F.asc_nulls_last("vec_id"))
    few = vectors.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top + 1)
    return few.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id"))).alias("ids")).select("v", F.col("ids.vec_id").alias("ids"))


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, v (doubles) of the rows whose vector is whole, finite and not zero."""
    v = F.col("embedding").cast("array<double>")
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    # -0.0 is 0.0, so that equal vectors are one
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: x + F.lit(0.0)).alias("v")).where(whole)


def graphs(distinct: DataFrame, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """A written table with a row per shard: its graph in flat arrays. Shards are dealt by hash and hold vectors of one length."""
    distinct = stash(distinct)
    parts = max(1, -(-distinct.count() // shard_nodes))

    def of(rows):
        import pyarrow as pa

        v = np.stack([np.array(x, np.float64) for x in rows.column("v").to_pylist()])
        ids, shard, dim = rows.column("ids").to_pylist(), rows.column("shard")[0].as_py(), v.shape[1]
        order = np.lexsort(v.T[::-1])  # the same graph however rows arrive
        order = order[np.random.default_rng(dim).permutation(len(v))]
        v, ids = v[order], [ids[k] for k in order]
        g = Graph(v, draw_levels(len(v), dim), [])
        with np.errstate(over="ignore", invalid="ignore"):  # distances beyond doubles are infinite
            g.build()
        row = {"shard": shard, "dim": dim, "sizes": g.sizes, "vectors": v.tobytes(), "links": [x.astype("<i4").tobytes() for x in g.links], "ids": ids}
        kind = pa.schema([("shard", pa.int64()), ("dim", pa.int32()), ("sizes", pa.list_(pa.int32())), ("vectors", pa.binary()), ("links", pa.list_(pa.binary())), ("ids", pa.list_(pa.list_(pa.int64())))])
        return pa.Table.from_pylist([row], kind)

    dealt = distinct.select("v", "ids", F.pmod(F.xxhash64("v"), F.lit(parts)).alias("shard"), F.size("v").alias("dim"))
    return stash(dealt.groupBy("shard", "dim").applyInArrow(of, _GRAPH))


def search(built: DataFrame, queries: DataFrame, top: int = TOP, beam: int = BEAM_SEARCH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query (number of the row), query_id, rank, vec_id, score: what the graphs find nearest to each row of queries (vec_id, v)."""
    spark = queries.sparkSession
    asked = queries.withColumn("bytes", 8 * F.size("v").cast("long"))
    blocks = max(1, -(-(asked.agg(F.sum("bytes")).first()[0] or 0) // block_bytes))
    asked = stash(asked.repartition(blocks).select("vec_id", "v", F.spark_partition_id().alias("block"), F.monotonically_increasing_id().alias("query")))
    out = "query long, query_id long, vec_id long, score double"
    results = spark.createDataFrame([], out)
    for block in range(blocks):
        part = asked.where(F.col("block") == block).select("query", "vec_id", "v").toArrow()  # block_bytes, about
        if part.num_rows:
            with arrow_batches(spark, 1):
                results = results.unionByName(stash(built.mapInArrow(_searcher(spark, part, top, beam), out)))
    order = Window.partitionBy("query").orderBy("score", F.asc_nulls_last("vec_id"))
    return results.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query", "query_id", "rank", "vec_id", "score")


def _searcher(spark: SparkSession, part, top: int, beam: int):
    sent = spark.sparkContext.broadcast((part.column("query").to_pylist(), part.column("vec_id").to_pylist(), part.column("v").to_pylist()))

    def of(batches: Iterator) -> Iterator:
        import pyarrow as pa

        numbers, own_ids, vectors = sent.value
        by_length: dict[int, list[int]] = {}
        for k, v in enumerate(vectors):
            by_length.setdefault(len(v), []).append(k)
        for batch in batches:
            for row in batch.to_pylist():
                mine = by_length.get(row["dim"], [])
                if not mine:
                    continue
                x = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"])
                links = [np.frombuffer(b, "<i4").astype(np.int64).reshape(n, -1) for b, n in zip(row["links"], row["sizes"])]
                g = Graph(x, row["sizes"], links)
                q = np.array([vectors[k] for k in mine])
                with np.errstate(over="ignore", invalid="ignore"):
                    found = g.nearest(q, max(beam, top + 1))
                rows = []
                for k, at, v in zip(mine, found, q):
                    at = at[at >= 0]
                    d = np.sqrt(((x[at] - v) ** 2).sum(1))
                    # no vector farther than the nearest top + 1 can give one of the best top + 1 rows
                    enough = np.flatnonzero(d <= np.sort(d)[min(top, len(d) - 1)])
                    near = sorted((float(d[j]), i is None, i or 0) for j in enough for i in row["ids"][at[j]])
                    own = (0.0, own_ids[k] is None, own_ids[k] or 0)
                    if own in near:
                        near.remove(own)  # one row, the query's own
                    rows += [(numbers[k], own_ids[k], None if no else i, s) for s, no, i in near[:top]]
                columns = list(zip(*rows)) if rows else [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.float64())], names=["query", "query_id", "vec_id", "score"])

    return of


def nearest_neighbours(rows: DataFrame, every: int = EVERY, top: int = TOP, shard_nodes: int = SHARD_NODES, beam: int = BEAM_SEARCH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id `every` divides, the `top` rows that the graphs find nearest, itself left out.

    Nearness is the Euclidean distance in doubles, computed anew on the given vectors (vec_id, embedding) for what the graphs find; ties
    go by ascending vec_id, null ids last. All rows are indexed; no sample is fitted. Equal vectors are one node with the least top + 1
    ids of its rows, which is all that a result can show, so copies neither crowd a task nor a graph. Null and zero vectors, and those
    with null or non-finite components, take no part; vectors meet those of the same length. Rows are told apart though ids
    repeat: each is a query and a candidate. Null ids are no queries. Very long vectors make shards larger in bytes, not in nodes. An empty table gives
    an empty one; extra columns are ignored. Queries go to the executors in blocks of block_bytes.
    """
    vectors = usable(rows)
    built = graphs(nodes(vectors, top), shard_nodes)
    return search(built, vectors.where(F.col("vec_id") % every == 0), top, beam, block_bytes).drop("query")


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


#: Brute force over all rows, which the graphs' results equal on the small tables (recall 1 there).
ORACLE = f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % {EVERY} = 0),
n AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score FROM d)
SELECT query_id, rank, vec_id, score FROM n WHERE rank <= {TOP}
"""
