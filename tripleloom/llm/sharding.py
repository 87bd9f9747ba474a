"""Extendible hashing into shards (1).

A document's place is 60 bits of the md5 of its key. The directory starts with one bucket; only a
bucket whose texts together exceed the byte limit is split on another bit. All levels of the
directory come from one sum of bytes by hash prefix, made before any shuffle, so neither the texts
nor the rows of a frequent key travel. A bucket of several rows with one hash cannot be split: its
rows are dealt to overflow pages, filled in turn by each task, so that a hot key is never in one
task. Every shard fits the limit, but for a single row that is longer by itself.

Defined cases: a null text has 0 bytes; a null key has a hash of its own; repeated rows share a
bucket; a text longer than the limit has a shard or page to itself, at most with others that share
its whole hash; keys cannot tie but by equal hashes; an empty table gives no rows.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.llm.common import batch, table

BITS, LIMIT, FINER = 60, 8 << 20, 6


def places(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", *carried) -> DataFrame:
    """key, place (the hash), n_bytes, and the carried columns."""
    key = F.col(key_col).cast("string")
    place = F.conv(F.substring(F.md5(F.coalesce(key, F.lit("null")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")
    return docs.select(
        F.col(key_col).alias("key"), place.alias("place"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), *carried
    )


def _cell(bits: int):
    return F.expr(f"shiftright(place, {BITS - bits})")


def directory(rows: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """prefix, depth, bucket_bytes, bucket_rows, one_hash of each bucket; and the depth of the deepest."""
    total = rows.agg(F.sum("n_bytes").alias("s"), F.count(F.lit(1)).alias("n")).first()
    depth, done, pending, deepest = 0, None, rows, 0
    finer = max(1, math.ceil(math.log2(max(1.0, (total["s"] or 0) / limit)))) + FINER
    while True:
        to = min(BITS, depth + finer)
        cells = pending.groupBy(_cell(to).alias("cell")).agg(
            F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n"), F.min("place").alias("lo"), F.max("place").alias("hi")
        )
        level = F.explode(F.sequence(F.lit(depth), F.lit(to))).alias("depth")
        levels = cells.select("*", level).withColumn("prefix", F.expr(f"shiftright(cell, {to} - depth)"))
        levels = levels.groupBy("depth", "prefix").agg(
            F.sum("b").alias("bucket_bytes"), F.sum("n").alias("bucket_rows"), (F.min("lo") == F.max("hi")).alias("one_hash")
        )
        levels = table(levels, "levels")
        fits = (F.col("bucket_bytes") <= limit) | F.col("one_hash")
        parent = levels.where(~fits).select((F.col("depth") + 1).alias("d"), F.col("prefix").alias("p"))
        # a bucket is what fits below a prefix that doesn't; each one above was too large
        inner = levels.where(fits).join(parent, (F.col("depth") == F.col("d")) & (F.expr("shiftright(prefix, 1)") == F.col("p")), "left_semi")
        root = levels.where(fits & (F.col("depth") == depth)) if depth == 0 else levels.limit(0)
        found = inner.unionByName(root).select("prefix", "depth", "bucket_bytes", "bucket_rows", "one_hash")
        done = found if done is None else done.unionByName(found)
        deep = levels.where(~fits & (F.col("depth") == to)).select(F.col("prefix").alias("cell"))
        if deep.isEmpty():
            done = table(done, "directory")
            return done, done.agg(F.max("depth")).first()[0] or deepest
        pending = pending.join(deep.withColumnRenamed("cell", "_cell"), _cell(to) == F.col("_cell"), "left_semi")
        depth, finer = to, 12


def _assigned(rows: DataFrame, limit: int, carried: list[str]) -> DataFrame:
    """The columns of assign() and the carried ones, of rows from places()."""
    buckets, deepest = directory(rows.select("place", "n_bytes"), limit)
    # a row's bucket is the one whose prefix it has: all depths in use are tried in one join on depth and prefix
    depths = sorted(r["depth"] for r in buckets.select("depth").distinct().collect())  # at most 61
    if not depths:
        return rows.select(
            "key", F.lit("").alias("shard"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("page"), "n_bytes",
            F.lit(0).cast("long").alias("bucket_bytes"), F.lit(0).cast("long").alias("bucket_rows"), *carried
        )
    tries = F.explode(F.array(*(F.struct(F.lit(d).alias("depth"), _cell(d).alias("prefix")) for d in depths)))
    joined = rows.select("key", "n_bytes", *carried, tries.alias("t")).select(
        "key", "n_bytes", *carried, "t.depth", "t.prefix"
    ).join(buckets, ["depth", "prefix"])
    shard = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    joined = joined.withColumn("shard", shard)
    over = (F.col("bucket_bytes") > limit) & (F.col("bucket_rows") > 1)
    columns = ["key", "shard", "depth", "page", "n_bytes", "bucket_bytes", "bucket_rows", *carried]
    plain = joined.where(~over).withColumn("page", F.lit(0).cast("long")).select(columns)
    if buckets.where(over).isEmpty():
        return plain
    crowded = joined.where(over).withColumn("page", F.lit(0).cast("long")).select(columns).repartition(F.rand(7))
    schema = pa.schema([f for f in crowded.limit(0).toArrow().schema])

    def pages(batches):
        base = (TaskContext.get().partitionId() << 32) + 1
        at, used = {}, {}
        for b in batches:
            page = []
            for shard, n in zip(b.column("shard").to_pylist(), b.column("n_bytes").to_pylist(), strict=True):
                if used.get(shard, 0) + n > limit and used.get(shard, 0):
                    at[shard], used[shard] = at[shard] + 1, 0
                used[shard] = used.get(shard, 0) + n
                page.append(base + at.setdefault(shard, 0))
            yield batch(schema, *(page if c == "page" else b.column(c) for c in columns))

    return plain.unionByName(table(crowded.mapInArrow(pages, crowded.schema), "pages"))


def assign(docs: DataFrame, limit: int = LIMIT, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, shard (the bucket's bits, as text), depth, page (0, or the overflow page), n_bytes, bucket_bytes, bucket_rows."""
    return _assigned(places(docs, key_col, text_col), limit, [])


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT, key_col: str = "doc_id", text_col: str = "text") -> tuple[str, str]:
    """Write the documents with all their columns, one folder a shard (and page): each row goes to its own.

    Returns the names of the two folder columns: _shard (b and the bucket's bits) and _page, with
    further underscores where the input has such columns.
    """
    rows = _assigned(places(docs, key_col, text_col, F.struct("*").alias("_row")), limit, ["_row"])
    names = []
    for name in ("_shard", "_page"):
        while name.lower() in (c.lower() for c in docs.columns):
            name = f"_{name}"
        names.append(name)
    rows = rows.select("_row.*", F.concat(F.lit("b"), "shard").alias(names[0]), F.col("page").alias(names[1]))
    rows.repartition(*names).write.partitionBy(*names).parquet(path)
    return names[0], names[1]
