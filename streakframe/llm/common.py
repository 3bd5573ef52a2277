"""What several operators share: the shared folder, byte views of text columns, fold remainders, word arrays."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streakframe import session
from streakframe.session import ship

#: Bytes of an Arrow batch that Spark sends to a worker, and of the text that the worker turns into Python objects at once.
ARROW_BYTES, BATCH_BYTES = 8 << 20, 4 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local session, which has no other machines, may do without one."""
    return session.shared_root(spark)


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"


def saved(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read back: lineage ends here and lost executors cost nothing."""
    path = new_folder(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder of intermediate files that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def ready(spark: SparkSession) -> None:
    """This package on the executors, and Spark's Arrow batches at ARROW_BYTES at most, the one bound that all operators share.

    Spark's own bound is 64 MB, of which a worker and the JVM each hold a few at once; a lesser bound of the session stays.
    """
    ship(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > ARROW_BYTES:
        spark.conf.set(name, f"{ARROW_BYTES}b")


def bounded(batches: Iterable[pa.RecordBatch], name: str = "text", most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose texts come to `most` bytes or so, so that Python never holds a long batch as objects.

    A single text is never cut, and is a slice of its own from `most` bytes on. Spark bounds its own batches by bytes.
    """
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(size) - size) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
        for start, stop in zip(cuts, cuts[1:], strict=False):
            if stop > start:
                yield b.slice(start, stop - start)


def folder_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def move_files(spark: SparkSession, paths: list[str], folder: str) -> None:
    """Moves files to a new folder, which has its name only when it is whole."""
    Path = spark._jvm.org.apache.hadoop.fs.Path
    target, draft = Path(folder), Path(f"{folder}.{uuid.uuid4().hex}")
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(draft)
    for path in paths:
        if not store.rename(Path(path), draft):
            raise OSError(f"{path} can't be moved")
    if store.exists(target) or not store.rename(draft, target):
        raise OSError(f"{folder} can't be made")


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_file(uri: str, parts: Iterable[bytes | memoryview]) -> None:
    """Written under another name first: a reader never sees half a file, and a repeated task can't spoil one."""
    store, path = open_store(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        for part in parts:
            out.write(part)
    store.move(draft, path)


def map_file(uri: str) -> pa.Buffer:
    """The file's bytes, memory-mapped where the store is a mounted one."""
    store, path = open_store(uri)
    if isinstance(store, pafs.LocalFileSystem):
        with pa.memory_map(path) as source:
            return source.read_buffer()
    with store.open_input_file(path) as source:
        return source.read_buffer()


def fresh(name: str, taken: list[str]) -> str:
    """name, with underscores before it until no column has it."""
    while name.lower() in {c.lower() for c in taken}:
        name = f"_{name}"
    return name


def row_key(name: str = "doc_id", text: str = "text") -> tuple[Column, Column]:
    """Two hashes that tell rows of different id or text apart, nulls included; equal rows share them."""
    parts = [F.col(name).isNull(), F.col(name), F.col(text).isNull(), F.col(text)]
    return F.xxhash64(*parts), F.xxhash64(F.lit(7), *parts)


def remainder(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(doc_id).cast("string")) % n


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The strings of a column; null is the empty text."""
    return [x or "" for x in batch.column(name).to_pylist()]


def raw(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a text column; null is empty."""
    column = batch.column(name)
    column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return [x or b"" for x in column.to_pylist()]


def words(text: Column) -> Column:
    """Lower-case words between ASCII white space; null and blank texts have none."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+")
    return F.array_remove(parts, "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), 0)


def once(df: DataFrame, keep: list[str], **value: Column) -> DataFrame:
    """The columns of keep and one more, behind a generator: the optimizer copies it into no later filter or lambda."""
    ((name, column),) = value.items()
    return df.select(*keep, F.explode(F.array(column)).alias(name))


def shingle_hashes(tokens: Column, size: int) -> Column:
    """The hash of each run of `size` words, in order, repeats included; of all words together if there are fewer; none for none.

    A shingle's hash is XXH64 over the XXH64 of its words, all in the JVM.
    """

    def runs(h: Column) -> Column:
        whole = F.array(F.aggregate(h, F.lit(0).cast("long"), lambda a, x: F.xxhash64(a, x)))
        each = F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(size)]))
        return F.when(F.size(h) >= size, each).when(F.size(h) > 0, whole).otherwise(F.array().cast("array<long>"))

    return let(F.transform(tokens, lambda w: F.xxhash64(w)), runs)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def sampled(labels: DataFrame, label: str, learn: Column, rows: int) -> DataFrame:
    """At most `rows` labelled ids of those to learn from, in the order of a hash of the id: (doc_id, y)."""
    picked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & learn)
    return picked.select("doc_id", F.col(label).cast("string").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(rows)


def examples(docs: DataFrame, picked: DataFrame, read: Callable[[list[bytes]], list], kind: str, rows: int, on: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(y, x): what `read` makes of the texts of the picked ids, `rows` at most, in an order that no task decides.

    picked: (doc_id, y), bounded by `rows`, and so broadcast; joined by `on`. An id with several texts gives an example for each.
    """

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(read(raw(b)), schema.types[1]), b.column("o")], ["y", "x", "o"])

    order = F.struct(F.xxhash64("doc_id"), F.col("doc_id").cast("string"), F.xxhash64("text"), "y").cast("string").alias("o")
    texts = docs.select(*on, "text").join(F.broadcast(picked), list(on)).select("text", "y", order)
    schema = pa.schema([("y", pa.string()), ("x", pa.binary() if kind == "binary" else pa.list_(pa.binary()))])
    return texts.mapInArrow(measured, f"y string, x {kind}, o string").orderBy("o").limit(rows).select("y", "x")
