"""What the operators of this package share: words, shared tables and Arrow helpers.

Every operator selects the columns it names and returns columns of its own, so further columns of
the input, whatever they are called, never clash with a result.
"""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-cases A-Z and leaves every other byte of UTF-8 alone.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def words(raw: bytes) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of lower-cased UTF-8: exactly what bytes.split() splits at."""
    return raw.translate(LOWER).split()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session, as in tests, may leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
    return found.rstrip("/")


#: Smaller row groups than the default's 128 MB bound what a task holds while it writes or reads.
WRITING = {"compression": "zstd", "parquet.block.size": str(32 << 20)}


def table(df: DataFrame, name: str, options: dict[str, str] = WRITING) -> DataFrame:
    """Write a frame to the shared folder and read it again: cuts the lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove a written table() that nothing reads any more."""
    spark = df.sparkSession
    places = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    own = shared_dir(spark).split("://", 1)[-1].split(":", 1)[-1].lstrip("/")
    for place in places:
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        if own in path.toUri().getPath():  # only what table() wrote
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def dealt(df: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """Rows gathered by key into the session's shuffle partitions, or into `tasks` where that is more.

    So tasks grow in number with the input instead of in size, whatever the session's setting is.
    """
    if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df.repartition(tasks, *keys)
    return df.repartition(*keys)


def raw_text(text_col: str = "text"):
    """The text as UTF-8 bytes: a null one is empty, bytes that aren't UTF-8 become replacement characters."""
    return F.coalesce(F.make_valid_utf8(F.col(text_col).cast("string")).cast("binary"), F.lit(b""))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and raw_text()."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), raw_text(text_col).alias("text"))


def texts_of(column: pa.Array) -> list[str | None]:
    """An Arrow column of texts; bytes that aren't UTF-8 become replacement characters."""
    return [None if t is None else t.decode(errors="replace") for t in column.cast(pa.binary()).to_pylist()]


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def chunks(batches, column: str, most_bytes: int = 16 << 20):
    """Arrow batches cut so that one holds at most about most_bytes of a column (or one row); the worker's free memory goes back at the end."""
    tune()
    for b in batches:
        at, size, sizes = 0, 0, [n or 0 for n in pc.binary_length(b.column(column)).to_pylist()] if b.nbytes > most_bytes else []
        for i, n in enumerate(sizes):
            if size + n > most_bytes and i > at:
                yield b.slice(at, i - at)
                at, size = i, 0
            size += n
        if at < b.num_rows:
            yield b.slice(at)
    trim()


def _libc():
    try:
        return ctypes.CDLL(None)
    except (OSError, TypeError):  # no C library to load by name
        return None


def tune() -> None:
    """Have a Python worker give large arrays back to the system as soon as they are freed."""
    libc = _libc()
    if hasattr(libc, "mallopt"):
        libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD, which would otherwise grow
        libc.mallopt(-1, 4 << 20)  # M_TRIM_THRESHOLD


def trim() -> None:
    """Give a Python worker's free memory back to the system."""
    pa.default_memory_pool().release_unused()
    libc = _libc()
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def lean(of_group: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """A group's function that leaves no free memory behind in its worker."""

    def run(t: pa.Table) -> pa.Table:
        tune()
        out = of_group(t)
        trim()
        return out

    return run


def held_out(modulus: int, id_col: str = "doc_id"):
    """Whether crc32 of the id's decimal text leaves no remainder; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == 0, F.lit(True))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
