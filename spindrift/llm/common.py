"""What several corpus operators share: tables, Arrow batches, written intermediate results."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


TEXTS = 1_000  # whole texts that a worker turns into columns at a time


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset: a temporary folder on a single machine, on a cluster one
    in the default file system.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    made = spark.sparkContext._jsc.sc().getCheckpointDir()
    if made.isDefined():
        return made.get()
    if spark.sparkContext.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="spindrift-")
    else:
        home = spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jsc.hadoopConfiguration()).getHomeDirectory()
        if home.toUri().getScheme() == "file":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"{home.toString()}/.spindrift-{uuid.uuid4().hex}"
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again.

    It cuts the lineage, survives lost executors, and is removed when the
    driver's JVM ends (``discard`` removes it earlier).
    """
    spark = df.sparkSession
    folder = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    path, fs = _path(spark, folder)
    fs.deleteOnExit(path)
    again = spark.read.schema(df.schema).parquet(folder)
    again._spindrift_folder = folder
    return again


def discard(df: DataFrame) -> None:
    folder = getattr(df, "_spindrift_folder", None)
    if folder:
        path, fs = _path(df.sparkSession, folder)
        fs.delete(path, True)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast.

    Spark would decide by the size of compressed files, which rows that explode
    or repeat outgrow many times, and fill the driver with them.
    """
    return df.hint("merge")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, each with a tail that no column of ``df`` has."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        k = 0
        while f"{name}_{k}" in have:
            k += 1
        out.append(f"{name}_{k}")
    return out


def kept_rows(docs: DataFrame, id_col: str, text_hash: Column, rows: DataFrame, broadcast_rows: int = 2_000_000) -> DataFrame:
    """The rows of ``docs`` that ``rows (id, hash, kept)`` keeps, each (id, text) once; only narrow rows are shuffled.

    rows: one for each row of ``docs``.  What goes is broadcast up to
    ``broadcast_rows`` rows, so the texts stay where they are; beyond that both
    sides are joined by shuffle.
    """
    i, h = fresh(docs, "key", "hash")
    counted = rows.groupBy(F.col("id").alias(i), F.col("hash").alias(h)).agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    gone = written(counted.where("n > 1 OR NOT kept"), "gone")
    n, again = gone.agg(F.count("*"), F.count(F.when(F.col("kept"), 1))).first()
    side = gone.select(i, h)
    hashed = docs.withColumns({i: F.col(id_col).cast("long"), h: text_hash})
    at = lambda df, other: df[i].eqNullSafe(other[i]) & (df[h] == other[h])
    left = F.broadcast(side) if n <= broadcast_rows else shuffled(side)
    stays = hashed.join(left, at(hashed, left), "left_anti")
    if again:  # rows that repeat: these alone are grouped
        twice = gone.where("kept").select(i, h)
        twice = F.broadcast(twice) if again <= broadcast_rows else shuffled(twice)
        stays = stays.unionByName(hashed.join(twice, at(hashed, twice), "left_semi").dropDuplicates([i, h]))
    return stays.select(*docs.columns)


def crc32_mod(column: str, n: int) -> Column:
    """crc32 of a number's decimal text, modulo ``n`` (null where the number is)."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(n))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as none."""
    return [x or b"" for x in column.cast(pa.binary() if column.type != pa.large_string() else pa.large_binary()).to_pylist()]


def release() -> None:
    """Gives freed memory back to the machine: a worker that waits for its next task would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int | None) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most so many rows (None: as they are), without empty ones."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows or max(batch.num_rows, 1)):
            yield batch.slice(at, rows or batch.num_rows)


def by_batch(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict | None]], rows: int | None = None) -> DataFrame:
    """``mapInArrow`` with a function made once per task; it turns a batch (of at most ``rows``) into columns of ``schema``."""
    from pyspark.sql.types import _parse_datatype_string

    struct = _parse_datatype_string(schema)
    arrow = [(f.name, _arrow_type(f.dataType)) for f in struct.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in slices(batches, rows):
            columns = function(batch)
            if columns is None:
                continue
            yield pa.RecordBatch.from_arrays([c if isinstance(c := columns[n], pa.Array) else pa.array(c, type=t) for n, t in arrow], names=[n for n, _ in arrow])
            del columns
        del function
        release()

    return df.mapInArrow(run, struct)


def free_prefix(df: DataFrame) -> str:
    """A beginning that no column's name has."""
    prefix = "_new_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = "_" + prefix
    return prefix


def appended(df: DataFrame, inputs: dict[str, str], schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict]], prefix: str) -> DataFrame:
    """``df`` with the columns that a batch function makes, one value a row, named with ``prefix``, which is free.

    inputs: columns that the function gets, in order, and the types that they are cast to.
    """
    from pyspark.sql.types import StructType, _parse_datatype_string

    added = _parse_datatype_string(schema)
    width, names = len(df.columns), list(inputs)
    struct = StructType([*df.schema.fields, *(type(f)(prefix + f.name, f.dataType) for f in added.fields)])
    kinds = [_arrow_type(f.dataType) for f in added.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in slices(batches, TEXTS):
            out = function(pa.RecordBatch.from_arrays(batch.columns[width:], names=names))
            new = [c if isinstance(c := out[f.name], pa.Array) else pa.array(c, type=t) for f, t in zip(added.fields, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *new], names=[f.name for f in struct.fields])
            del out, new
        del function
        release()

    return df.select("*", *(F.col(c).cast(t).alias(f"{prefix}in_{k}") for k, (c, t) in enumerate(inputs.items()))).mapInArrow(run, struct)


def _arrow_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def unsigned_crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def spread(key: Column, seed: int) -> Column:
    """A number in [0, 1) fixed by ``key``."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def cuts(lengths: np.ndarray) -> np.ndarray:
    """Starts of consecutive runs with these lengths, and the end."""
    out = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    return out
