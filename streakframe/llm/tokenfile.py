"""Token-id files: Arrow's file format with batches of fixed-size lists, read by memory map.

Documents are dealt to partitions by ranges of doc_id and sorted; each partition's ids, one after the other with an end id
after each document, are cut into sequences of equal length. A file has the columns `ids` and `mask`, fixed-size lists of
that length: sequence k of a file lies at a place that its number gives, and no read copies. The mask is true where an id
is; only a file's last sequence has padding. Ids are 16 bits wide where the vocabulary allows it. Encoding looks words up that a
worker has met (tokens.py), which takes a quarter of the time of encoding each text anew. An index table has a row for each document: file, place in it, length.
Workers write its rows as Parquet themselves, beside their token files; the driver moves those of tasks that ended well to the index's folder.

Defined cases: a null text is empty and has just the end id; ids of documents with equal doc_id are ordered by text; null
ids come first; an empty table gives no files; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streakframe.llm.common import bounded, drop_folder, folder_exists, map_file, move_files, new_folder, open_store, ready
from streakframe.llm.tokens import encoder

LENGTH = 2048
#: Sequences in one record batch.
BATCH = 64
#: Text of a file at most, and at least where that leaves no machine idle.
FILE_BYTES, LEAST_BYTES = 256 << 20, 8 << 20
#: Rows of the index that a worker holds.
ROWS = 50_000


def _schema(kind: pa.DataType, length: int) -> pa.Schema:
    return pa.schema({"ids": pa.list_(pa.field("item", kind, False), length), "mask": pa.list_(pa.field("item", pa.bool_(), False), length)})


class Writer:
    """Appends documents' ids to a token file."""

    def __init__(self, uri: str, vocabulary: int, length: int = LENGTH) -> None:
        self.kind, self.length, self.total = (pa.uint16() if vocabulary <= 1 << 16 else pa.uint32()), length, 0
        store, path = open_store(uri)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = store.open_output_stream(path)
        self.file = pa.ipc.new_file(self.out, _schema(self.kind, length))
        self.held: list[np.ndarray] = []
        self.count = 0

    def add(self, ids: np.ndarray) -> int:
        """Place of the first of these ids in the file."""
        at = self.total
        self.held.append(ids)
        self.count += len(ids)
        self.total += len(ids)
        if self.count >= BATCH * self.length:
            self._flush(self.count // (BATCH * self.length) * BATCH)
        return at

    def _flush(self, sequences: int) -> None:
        ids = np.concatenate(self.held).astype(self.kind.to_pandas_dtype())
        n = sequences * self.length
        padded = np.zeros(n, ids.dtype)
        padded[: len(ids)] = ids[:n]
        mask = np.arange(n) < len(ids)
        for k in range(0, n, BATCH * self.length):
            part = slice(k, k + BATCH * self.length)
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(x[part]), type=t.type) for x, t in zip((padded, mask), _schema(self.kind, self.length), strict=True)]
            self.file.write_batch(pa.record_batch(columns, schema=_schema(self.kind, self.length)))
        self.held, self.count = [ids[n:].astype(np.uint32)], max(0, len(ids) - n)

    def close(self) -> None:
        if self.count:
            self._flush(-(-self.count // self.length))
        self.file.close()
        self.out.close()


class IndexWriter:
    """Appends rows of the index to a Parquet file."""

    def __init__(self, uri: str, schema: pa.Schema) -> None:
        store, path = open_store(uri)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = pq.ParquetWriter(path, schema, filesystem=store)
        self.held: list[pa.RecordBatch] = []
        self.count = 0

    def add(self, rows: pa.RecordBatch) -> None:
        # copied: Spark's batch, with its texts, is one buffer
        self.held.append(rows.take(pa.array(np.arange(len(rows)))))
        self.count += len(rows)
        if self.count >= ROWS:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            self.out.write_table(pa.Table.from_batches(self.held))
        self.held, self.count = [], 0

    def close(self) -> None:
        self._flush()
        self.out.close()


class Reader:
    """Random access to a token file without copies of whole sequences."""

    def __init__(self, uri: str) -> None:
        self.file = pa.ipc.open_file(map_file(uri))
        self.length = self.file.schema.field("ids").type.list_size
        self.batch, self.number = None, -1

    def _values(self, k: int, column: str) -> np.ndarray | pa.Array:
        if k != self.number:
            self.batch, self.number = self.file.get_batch(k), k
        return self.batch.column(column).values

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids (a view of the mapped file) and the mask of sequence k."""
        b, row = divmod(k, BATCH)
        part = slice(row * self.length, (row + 1) * self.length)
        return self._values(b, "ids").to_numpy()[part], self._values(b, "mask")[part].to_numpy(zero_copy_only=False)

    def ids(self, start: int, count: int) -> np.ndarray:
        """So many ids from a place in the file, across sequences and batches."""
        size, parts = BATCH * self.length, []
        while count > 0:
            b, at = divmod(start, size)
            part = self._values(b, "ids").to_numpy()[at : at + count]
            parts.append(part)
            start, count = start + len(part), count - len(part)
        return np.concatenate(parts) if len(parts) != 1 else parts[0]


@dataclass(frozen=True)
class TokenFiles:
    """index: (doc_id, part, file, place, n_tokens) for each document; parts are in the order of their ids."""

    folder: str
    index: DataFrame


def write(spark: SparkSession, docs: DataFrame, tokenizer: str, end: int, folder: str | None = None, length: int = LENGTH) -> TokenFiles:
    """Encodes every text, appends `end` to each document, and writes token files in ascending doc_id order."""
    ready(spark)
    folder = folder or new_folder(spark, "tokens")
    volume = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-volume // FILE_BYTES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-volume // LEAST_BYTES)))
    # texts that share an id are dealt by a hash of their text
    order = ["doc_id", F.xxhash64("text"), "text"]
    dealt = docs.select("doc_id", "text").repartitionByRange(parts, *order[:2]).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    path, drafts = f"{folder}/index", f"{folder}/drafts"
    if folder_exists(spark, path):
        raise FileExistsError(path)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer, index, name = encoder(tokenizer), None, None, uuid.uuid4().hex
        for b in bounded(batches):
            if writer is None:
                writer = Writer(f"{folder}/{name}.arrow", encode.tokenizer.get_vocab_size(), length)
            place, count = [], []
            for own in encode.ids(b.column("text")):
                ids = np.append(own, np.uint32(end))
                place.append(writer.add(ids))
                count.append(len(ids))
            rows = pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), pa.array([f"{name}.arrow"] * len(count)), pa.array(place, pa.int64()), pa.array(count, pa.int64())], ["doc_id", "part", "file", "place", "n_tokens"])
            index = index or IndexWriter(f"{drafts}/{name}.parquet", rows.schema)
            index.add(rows)
        if writer:
            writer.close()
            index.close()
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    schema = docs.select("doc_id", F.lit(0).alias("part"), F.lit("").alias("file"), F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("n_tokens")).schema
    # the index keeps only the files of tasks that ended well: a task that is run again writes files of another name
    ended = [r.name for r in dealt.mapInArrow(encoded, "name string").collect()]
    move_files(spark, [f"{drafts}/{n}.parquet" for n in ended], path)
    drop_folder(spark, drafts)
    return TokenFiles(folder, spark.read.schema(schema).parquet(path))


def read(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files.

    start: ids of all documents before it; from a total for each file, of which there are as many as partitions.
    """
    folder = files.folder
    totals = files.index.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    before, base = 0, {}
    for part, n in totals:
        base[part] = before
        before += n

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, reader = None, None
        for b in batches:
            place, count, crc = b.column("place").to_pylist(), b.column("n_tokens").to_pylist(), []
            for file, at, n in zip(b.column("file").to_pylist(), place, count, strict=True):
                if file != name:
                    name, reader = file, Reader(f"{folder}/{file}")
                crc.append(crc32(reader.ids(at, n).astype("<u4").tobytes()))
            start = [base[p] + at for p, at in zip(b.column("part").to_pylist(), place, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(start, pa.int64()), b.column("n_tokens"), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    schema = files.index.select("doc_id", F.lit(0).cast("long").alias("start"), "n_tokens", F.lit(0).cast("long").alias("ids_crc32")).schema
    return files.index.mapInArrow(measured, schema)
