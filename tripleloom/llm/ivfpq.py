"""Approximate nearest neighbours: an inverted file with product-quantised residuals (5).

Coarse centroids (about twice the root of the number of vectors) and the codebooks of the residuals
are fitted on a bounded sample (SAMPLE vectors of the smallest id hash, SAMPLE_BYTES at most); every
vector is indexed. Vectors are made unit length, so that the largest cosine is the smallest distance.
How many lists a query probes, and what share of the vectors is scored exactly, are measured on the
sample: the least that hold LISTS_RECALL and CODES_RECALL of its own nearest neighbours (and so many
lists that a query sees LEAST_PROBED vectors for each neighbour asked for). So vectors
in clusters are probed in few lists; nearly isotropic ones, which no index can sort, in many.

Lists that are near each other share a block (a 16th of the vectors, within LEAST_BLOCK and MOST_BLOCK)
and a longer list has several; a query goes once to each block that holds a list it probes, in groups of about BLOCK_QUERIES.
So no list and no crowd of equal vectors lands in one task. A task has one block and one group. The
squared distance of a query q to a code r in the list of centroid c is |q - c|^2 + (|r|^2 + 2 c.r) -
2 q.r: the second term is the vector's own, the last comes from one asymmetric table a query. The
nearest of the block (with all of equal distance among the nearest, smaller ids first) are scored
exactly from the original vectors; a query's best few of each block are merged at the end.

Defined cases: null and zero vectors and those with null or non-finite components take no part;
vectors of each length are indexed by themselves, as there is no cosine between two lengths; repeated
ids are candidates each, but never for a query of the same id; scores are summed in one order for
every row, so equal vectors tie exactly, and ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripleloom.llm.common import lean, table

SUBSPACES, CODES, SAMPLE, SAMPLE_BYTES, MOST_LISTS = 16, 256, 16_384, 32 << 20, 1024
LISTS_RECALL, CODES_RECALL, ASKED = 0.97, 0.98, 512
LEAST_BLOCK, MOST_BLOCK, BLOCK_QUERIES, LEAST_RERANK, LEAST_PROBED = 1_024, 20_000, 2_000, 64, 32


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, v (array of double) of the vectors that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).dropna()
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite & F.exists("v", lambda x: x != 0))


def unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of unit rows with one: each row is summed alone, so that equal rows have equal values whatever stands around them."""
    return np.clip((np.ascontiguousarray(x) * y).sum(1), -1.0, 1.0)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(1) / 2
    return np.concatenate([np.argmax(x[k : k + 4096] @ centres.T - half, 1) for k in range(0, len(x), 4096)]) if len(x) else np.empty(0, np.int64)


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    centres = x[np.random.default_rng(seed).permutation(len(x))[: min(k, len(x))]].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        n = np.bincount(near, minlength=len(centres))
        for d in range(x.shape[1]):
            total = np.bincount(near, x[:, d], len(centres))
            centres[n > 0, d] = total[n > 0] / n[n > 0]
    return centres


def chained(centres: np.ndarray) -> np.ndarray:
    """The centroids in an order in which each follows the nearest one left."""
    left, order = np.ones(len(centres), bool), [0]
    left[0] = False
    while left.any():
        d = ((centres - centres[order[-1]]) ** 2).sum(1)
        d[~left] = np.inf
        order.append(int(d.argmin()))
        left[order[-1]] = False
    return np.array(order)


class Index:
    """Coarse centroids, codebooks of the residuals; codes, distances, and how far to look."""

    def __init__(self, sample: np.ndarray, rows: int, k: int):
        x = unit(sample)
        dim = x.shape[1]
        lists = max(1, min(MOST_LISTS, round(2 * math.sqrt(rows)), len(x) // 16))
        centres = k_means(x, lists)
        self.coarse = centres[chained(centres)]
        at = nearest(x, self.coarse)
        residual = x - self.coarse[at]
        bounds = np.linspace(0, dim, min(SUBSPACES, dim) + 1).round().astype(int)
        self.parts = list(zip(bounds[:-1], bounds[1:], strict=True))
        self.books = [k_means(residual[:, a:b], CODES) for a, b in self.parts]
        self._measure(x, at, k)

    def _measure(self, x: np.ndarray, at: np.ndarray, k: int) -> None:
        """probe: lists a query looks into; share: of the vectors that are scored exactly."""
        asked = np.linspace(0, len(x) - 1, min(ASKED, len(x))).astype(int)
        codes = self.codes(x, at)
        own, lists, places = self.own(at, codes), [], []  # places in the order of distance
        for i in asked.tolist():
            true = x @ x[i]
            true[i] = -np.inf
            near = np.argsort(-true, kind="stable")[: min(k, len(x) - 1)]
            lists.append(np.argsort(self.order(x[i : i + 1])[0])[at[near]])
            d = self.distances(x[i : i + 1], at, codes, own)[0]
            places.append(np.searchsorted(np.sort(d), d[near]))
        lists, places = np.sort(np.concatenate(lists)), np.sort(np.concatenate(places))
        held = lambda v, recall: int(v[min(len(v) - 1, math.ceil(recall * len(v)))]) + 1 if len(v) else 1
        self.probe, self.share = held(lists, LISTS_RECALL), held(places, CODES_RECALL) / len(x)

    def codes(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        residual = x - self.coarse[at]
        return np.stack([nearest(residual[:, a:b], book) for (a, b), book in zip(self.parts, self.books, strict=True)], 1).astype(np.uint8)

    def own(self, at: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """|r|^2 + 2 c.r of each vector's code and centroid."""
        out = np.zeros(len(at))
        for n, ((a, b), book) in enumerate(zip(self.parts, self.books, strict=True)):
            r = book[codes[:, n]]
            out += ((r + 2 * self.coarse[at, a:b]) * r).sum(1)
        return out

    def order(self, q: np.ndarray) -> np.ndarray:
        """The lists by the distance of their centroids, for each query."""
        score = q @ self.coarse.T - (self.coarse * self.coarse).sum(1) / 2
        return np.argsort(-score, axis=1, kind="stable")

    def probed(self, q: np.ndarray, sizes: np.ndarray, least: int) -> np.ndarray:
        """Which lists each query looks into: the nearest `probe`, and more until they hold `least` vectors."""
        order, out = self.order(q), np.zeros((len(q), len(self.coarse)), bool)
        nearer = np.cumsum(sizes[order], 1) - sizes[order]
        np.put_along_axis(out, order, (np.arange(len(self.coarse)) < self.probe) | (nearer < least), 1)
        return out

    def distances(self, q: np.ndarray, at: np.ndarray, codes: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Squared distance of each query to each code, but for |q|^2, through a table of each query with each codebook."""
        out = ((self.coarse * self.coarse).sum(1) - 2 * q @ self.coarse.T).astype(np.float32)[:, at]
        out += own.astype(np.float32)
        for n, ((a, b), book) in enumerate(zip(self.parts, self.books, strict=True)):
            out += (-2 * q[:, a:b] @ book.T).astype(np.float32)[:, codes[:, n]]
        return out


INDEXED = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.float64())), ("list", pa.int32()), ("codes", pa.binary())])
ASKS = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.float64())), ("bin", pa.int32())])
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
RESULT_DDL = "query_id long, rank int, vec_id long, score double"


def _matrix(column, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def bins_of(sizes: np.ndarray, most: int) -> np.ndarray:
    """The bin of each list: neighbours share one up to so many vectors; a longer list has its own."""
    out, held, bin_ = [], 0, 0
    for n in sizes.tolist():
        if held and held + n > most:
            bin_, held = bin_ + 1, 0
        out.append(bin_)
        held += n
    return np.array(out, np.int32)


def _found(good: DataFrame, dim: int, rows: int, k: int, every: int) -> DataFrame:
    """query_id, vec_id, score: candidates for the nearest, among vectors of one length."""
    spark = good.sparkSession
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
    sample = good.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(most).select("v").toArrow()["v"]
    index = Index(_matrix(sample, dim), rows, k)
    shared = spark.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]):
        ix = shared.value
        for b in batches:
            x = unit(_matrix(b.column("v"), dim)) if b.num_rows else np.empty((0, dim))
            at = nearest(x, ix.coarse)
            codes = ix.codes(x, at) if len(x) else []
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("v"), pa.array(at, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())],
                schema=INDEXED
            )

    indexed = table(good.mapInArrow(assign, "vec_id long, v array<double>, list int, codes binary"), "lists")
    sizes = np.zeros(len(index.coarse), np.int64)
    for r in indexed.groupBy("list").count().collect():  # MOST_LISTS rows at most
        sizes[r["list"]] = r["count"]
    in_block = max(LEAST_BLOCK, min(MOST_BLOCK, rows // 16))  # 16 blocks at least, if they are not too small
    bin_of, least = bins_of(sizes, in_block), LEAST_PROBED * k + 1

    def ask(batches: Iterator[pa.RecordBatch]):
        ix = shared.value
        for b in batches:
            probed = ix.probed(unit(_matrix(b.column("v"), dim)), sizes, least) if b.num_rows else np.empty((0, len(bin_of)), bool)
            row, at = probed.nonzero()
            hit = np.unique(np.stack([row, bin_of[at]], 1), axis=0) if len(row) else np.empty((0, 2), np.int64)
            take = pa.array(hit[:, 0])
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(take), b.column("v").take(take), pa.array(hit[:, 1], pa.int32())], schema=ASKS)

    asks = table(indexed.where(F.col("vec_id") % every == 0).select("vec_id", "v").mapInArrow(ask, "vec_id long, v array<double>, bin int"), "asks")
    asked = {r["bin"]: r["count"] for r in asks.groupBy("bin").count().collect()}  # a row a bin, of which there are no more than lists
    held = np.bincount(bin_of, sizes)
    plan = [(b, max(1, math.ceil(held[b] / in_block / 1.25)), math.ceil(n / BLOCK_QUERIES)) for b, n in sorted(asked.items()) if held[b]]
    plan = F.broadcast(spark.createDataFrame(plan, "bin int, blocks int, groups int"))
    lists = F.broadcast(spark.createDataFrame([(i, int(b)) for i, b in enumerate(bin_of)], "list int, bin int"))
    deal = lambda n: F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["bin", "block", "group", "is_query", "vec_id", "v", "list", "codes"]
    have = indexed.join(lists, "list").join(plan, "bin").withColumns({"block": deal("blocks"), "is_query": F.lit(False)}).withColumn(
        "group", each("groups")
    ).select(columns)
    want = asks.join(plan, "bin").withColumns(
        {"group": deal("groups"), "is_query": F.lit(True), "list": F.lit(None).cast("int"), "codes": F.lit(None).cast("binary")}
    ).withColumn("block", each("blocks")).select(columns)

    def rank(t: pa.Table) -> pa.Table:
        ix = shared.value
        asks, have = t.filter(t["is_query"]), t.filter(pc.invert(t["is_query"])).sort_by("vec_id")
        if not asks.num_rows or not have.num_rows:
            return FOUND.empty_table()
        ids, x, at = have["vec_id"].to_numpy(), unit(_matrix(have["v"], dim)), have["list"].to_numpy()
        codes = np.frombuffer(b"".join(have["codes"].to_pylist()), np.uint8).reshape(len(ids), -1)
        own, asked, q = ix.own(at, codes), asks["vec_id"].to_numpy(), unit(_matrix(asks["v"], dim))
        most = max(LEAST_RERANK, 8 * k, math.ceil(ix.share * len(ids)))
        out = [], [], []
        for s in range(0, len(q), 64):
            y = q[s : s + 64]
            near = ix.distances(y, at, codes, own)
            near[~ix.probed(y, sizes, least)[:, at]] = np.inf
            for row, i, z in zip(near, asked[s : s + 64].tolist(), y, strict=True):
                if len(ids) > most:
                    worst = np.partition(row, most - 1)[most - 1]
                    pick = np.concatenate([np.flatnonzero(row < worst), np.flatnonzero(row == worst)[:most]])
                else:
                    pick = np.arange(len(ids))
                pick = np.sort(pick[(ids[pick] != i) & (row[pick] < np.inf)])
                score = cosines(x[pick], z)
                best = np.argsort(-score, kind="stable")[:k]
                out[0].append(np.full(len(best), i))
                out[1].append(ids[pick[best]])
                out[2].append(score[best])
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in out], schema=FOUND)

    return have.unionByName(want).groupBy("bin", "block", "group").applyInArrow(lean(rank), "query_id long, vec_id long, score double")


def search(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each vector whose id is divisible by `every`."""
    spark, good = vectors.sparkSession, usable(vectors, id_col, vec_col)
    lengths = sorted((r["dim"], r["count"]) for r in good.groupBy(F.size("v").alias("dim")).count().collect())  # a row a length
    if not lengths:
        return spark.createDataFrame([], RESULT_DDL)
    found = reduce(DataFrame.unionByName, [_found(good.where(F.size("v") == dim), dim, n, k, every) for dim, n in lengths])
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
