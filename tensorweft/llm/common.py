"""Shared plumbing of the corpus operators: tables, the shared folder, Arrow maps."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts are handed to Python functions in slices of at most this many bytes (or one row).
SLICE_BYTES = 1 << 20
#: A side of a join is broadcast only if it was written and measured at no more than this.
BROADCAST_BYTES = 32 << 20

_own_dir: str | None = None
_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one of our own only where it is unset, in local mode."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="tensorweft-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return f"file://{_own_dir}"


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, wherever the driver has it from; once for each Spark context."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="tensorweft-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(target := f"{folder}/{root.name}.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    context.addPyFile(target)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tensorweft/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it again: lineage is cut and lost executors lose nothing.

    by: a column to lay the files out by. Shuffle files of the write are released with it, so that a query of several
    phases holds those of one at a time.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(key, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialised tables that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._written_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files behind a materialised table (from the file index, no job)."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint if the materialised table is known to be small; otherwise the planner's shuffle join stays."""
    return F.broadcast(df) if stored_bytes(df) * 4 <= limit else df


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def annotate(df: DataFrame, inputs: Sequence[str], fn: Callable[..., Sequence[Sequence]], ddl: str, keep: Sequence[str] | None = None, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Append the columns of ddl, computed by fn from lists of the values of inputs.

    Strings come as UTF-8 bytes, arrays of longs as numpy arrays, nulls as None.

    fn gets a slice of rows, one list per input, and returns one list per column. keep: the columns of df that stay
    (default all); a kept column with the name of a computed one gives way to it, in either case.
    """
    ship(df.sparkSession)
    made = T._parse_datatype_string(ddl)
    taken = {f.name.lower() for f in made.fields}
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]
    src = df.select(*[quoted(c).alias(f"k{i}") for i, c in enumerate(keep)], *[quoted(c).alias(f"x{i}") for i, c in enumerate(inputs) if c not in keep])
    at = [keep.index(c) if c in keep else f"x{i}" for i, c in enumerate(inputs)]
    names = [f"k{x}" if isinstance(x, int) else x for x in at]
    kinds = {f.name: f.dataType for f in src.schema.fields}
    schema = T.StructType([T.StructField(f"k{i}", kinds[f"k{i}"]) for i in range(len(keep))] + [T.StructField(f"r{i}", f.dataType) for i, f in enumerate(made.fields)])
    types = arrow_types([f.dataType for f in made.fields])
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, names, slice_bytes):
                columns = [values(part.column(part.schema.get_field_index(n))) for n in names]
                out = fn(*columns)
                arrays = [part.column(part.schema.get_field_index(f"k{i}")) for i in range(n_keep)]
                arrays += [pa.array(x, type=t) for x, t in zip(out, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*(f"k{i}" for i in range(n_keep)), *(f"r{i}" for i in range(len(types)))])

    got = src.mapInArrow(run, schema)
    return got.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *[F.col(f"r{i}").alias(f.name) for i, f in enumerate(made.fields)])


def emit(df: DataFrame, inputs: Sequence[str], fn: Callable[..., Sequence], ddl: str) -> DataFrame:
    """Like annotate, but fn returns columns of any length: rows made from a slice of rows."""
    ship(df.sparkSession)
    made = T._parse_datatype_string(ddl)
    names = [f"x{i}" for i in range(len(inputs))]
    src = df.select(*[quoted(c).alias(n) for c, n in zip(inputs, names, strict=True)])
    types, out_names = arrow_types([f.dataType for f in made.fields]), [f.name for f in made.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, names):
                out = fn(*[values(part.column(i)) for i in range(len(names))])
                yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(out, types, strict=True)], names=out_names)

    return src.mapInArrow(run, made)


def arrow_types(kinds: Sequence[T.DataType]) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(k) for k in kinds]


def values(column: pa.Array) -> list:
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary())
    if pa.types.is_list(column.type) and pa.types.is_int64(column.type.value_type):  # as numpy arrays
        flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_pylist()
        return [flat[a:b] if there else None for a, b, there in zip(at, at[1:], column.is_valid().to_pylist())]
    return column.to_pylist()


def slices(batch: pa.RecordBatch, names: Sequence[str], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the strings of a slice hold `most` bytes, one row at least."""
    if batch.num_rows == 0:
        yield batch
        return
    import pyarrow.compute as pc

    sizes = [0] * batch.num_rows
    for n in names:
        column = batch.column(batch.schema.get_field_index(n))
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type):
            sizes = [a + (b or 0) for a, b in zip(sizes, pc.binary_length(column).to_pylist(), strict=True)]
    start = held = 0
    for i, x in enumerate(sizes):
        if i > start and held + x > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += x
    yield batch.slice(start, batch.num_rows - start)
