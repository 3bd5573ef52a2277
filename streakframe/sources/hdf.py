"""HDF5 files as a Spark data source and sink, where h5py is installed: one partition for a file's range of rows.

Files go in the order of their names, and a frame's number is its place over all files. A scan opens only the files that hold
wanted frames, reads only the wanted rectangle of pixels, and hands on Arrow batches. The sink writes a file for each task.

A protocol names, for each attribute, the places where files keep it, as patterns, and its kind: stack and sequence have a
row for each frame, frame has one image, scalar one value. The first pattern with a match counts, and its first dataset.
"""

from __future__ import annotations

import configparser
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from importlib.util import find_spec
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from streakframe.session import ship

KINDS = ("scalar", "sequence", "frame", "stack", "none")


@dataclass
class Protocol:
    paths: dict[str, list[str]] = field(default_factory=dict)
    kinds: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.paths = {k: [p.lstrip("/") for p in v] for k, v in self.paths.items()}

    def kind(self, attribute: str) -> str:
        return self.kinds.get(attribute, "none")

    def find_path(self, attribute: str, names: list[str]) -> str | None:
        """names: the datasets of a file, in the order in which a visit meets them."""
        for pattern in self.paths.get(attribute, []):
            for name in names:
                if re.fullmatch(pattern, name.lstrip("/")):
                    return name
        return None

    def common_path(self, attribute: str, files: dict[str, list[str]]) -> str:
        """The one place of an attribute in all files; an error if it is missing somewhere or differs."""
        found = {self.find_path(attribute, names) for names in files.values()}
        if None in found or len(found) != 1:
            raise ValueError(f"{attribute} isn't at one place in all files")
        return found.pop()

    @classmethod
    def read(cls, path: str | Path) -> Protocol:
        """From JSON or INI with the sections `paths` (a name, or a list of names) and `kinds`."""
        text = Path(path).read_text()
        if Path(path).suffix == ".json":
            found = json.loads(text)
        else:
            parser = configparser.ConfigParser(interpolation=None)
            parser.optionxform = str
            parser.read_string(text)
            found = {name: {k: json.loads(v) if v.startswith("[") else v for k, v in parser[name].items()} for name in parser.sections()}
        if wrong := {k for k in found.get("kinds", {}).values() if k not in KINDS}:
            raise ValueError(f"no kinds {sorted(wrong)}")
        return cls({k: [v] if isinstance(v, str) else list(v) for k, v in found.get("paths", {}).items()}, dict(found.get("kinds", {})))

    def write(self, path: str | Path) -> None:
        if Path(path).suffix == ".json":
            Path(path).write_text(json.dumps({"paths": self.paths, "kinds": self.kinds}, indent=2))
            return
        parser = configparser.ConfigParser(interpolation=None)
        parser.optionxform = str
        parser.read_dict({"paths": {k: json.dumps(v) for k, v in self.paths.items()}, "kinds": self.kinds})
        with open(path, "w") as f:
            parser.write(f)


def datasets(file) -> list[str]:
    """The datasets of an open file, in the order in which a visit meets them."""
    out: list[str] = []
    file.visititems(lambda name, item: out.append(name) if hasattr(item, "shape") else None)
    return out


@dataclass
class Rows(InputPartition):
    """Some rows of a file, which are frames from `frame` on."""

    file: str
    rows: list[int]
    frames: list[int]


class HdfReader(DataSourceReader):
    """Options: files (comma-separated), dataset, rows (of a partition), frames (comma-separated numbers, negative ones from the
    end), roi (ss from, ss to, fs from, fs to), values (comma-separated datasets with one number a frame) and scalars (with one).
    """

    def __init__(self, options: dict) -> None:
        listed = lambda name: [x for x in options.get(name, "").split(",") if x]
        self.files, self.path = sorted(listed("files")), options["dataset"]
        self.size, self.frames, self.roi = int(options.get("rows", 64)), list(map(int, listed("frames"))), list(map(int, listed("roi")))
        self.values, self.scalars = listed("values"), listed("scalars")

    def partitions(self) -> list[Rows]:
        import h5py

        sizes = []
        for name in self.files:
            with h5py.File(name) as f:
                sizes.append(len(f[self.path]))
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if sizes else 0
        wanted = np.array([total + k if k < 0 else k for k in self.frames] if self.frames else range(total), np.int64)
        if ((wanted < 0) | (wanted >= total)).any():
            raise IndexError(f"no frames {wanted[(wanted < 0) | (wanted >= total)][:10].tolist()} among {total}")
        out, owner = [], np.searchsorted(ends, wanted, side="right")
        for k, name in enumerate(self.files):
            own = np.sort(wanted[owner == k])
            first = int(ends[k]) - sizes[k]
            out += [Rows(name, (part - first).tolist(), part.tolist()) for part in np.split(own, range(self.size, len(own), self.size)) if len(part)]
        return out

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        import h5py

        with h5py.File(partition.file) as f:
            scalars = [float(np.asarray(f[name][()]).ravel()[0]) for name in self.scalars]
            y0, y1, x0, x1 = self.roi or (None,) * 4
            for row, frame in zip(partition.rows, partition.frames, strict=True):
                image = np.nan_to_num(np.asarray(f[self.path][row, ..., y0:y1, x0:x1], float), posinf=np.inf, neginf=-np.inf)
                image = image.reshape(-1, *image.shape[-2:])
                n, (height, width) = len(image), image.shape[1:]
                pixels = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * height * width, pa.array(image.ravel()))
                whole = lambda x, kind: pa.array(np.full(n, x), kind)
                columns = [pa.array([partition.file] * n), whole(row, pa.int64()), whole(frame, pa.int64()), pa.array(range(n), pa.int32()), whole(height, pa.int32()), whole(width, pa.int32()), pixels]
                columns += [whole(float(f[name][row]), pa.float64()) for name in self.values] + [whole(x, pa.float64()) for x in scalars]
                yield pa.RecordBatch.from_arrays(columns, [f.partition(" ")[0] for f in fields(self.values, self.scalars)])


def column_of(dataset: str) -> str:
    return dataset.rpartition("/")[2]


def fields(values: list[str], scalars: list[str]) -> list[str]:
    return ["file string", "row bigint", "frame bigint", "module int", "n_ss int", "n_fs int", "pixels array<double>", *(f"{column_of(x)} double" for x in (*values, *scalars))]


class HdfSource(DataSource):
    """Options as HdfReader's."""

    @classmethod
    def name(cls) -> str:
        return "frames_hdf5"

    def schema(self) -> str:
        reader = HdfReader(self.options)
        return ", ".join(fields(reader.values, reader.scalars))

    def reader(self, schema) -> HdfReader:
        return HdfReader(self.options)


def _need() -> None:
    if find_spec("h5py") is None:
        raise RuntimeError("HDF5 needs h5py")


def read_hdf(spark: SparkSession, files: list[str], dataset: str, frames: list[int] | None = None, roi: tuple[int, int, int, int] | None = None, values: list[str] | None = None, scalars: list[str] | None = None) -> DataFrame:
    """(file, row, frame, module, n_ss, n_fs, pixels) and a column for each of values and scalars."""
    _need()
    spark.dataSource.register(HdfSource)
    joined = {"files": files, "frames": frames, "roi": roi, "values": values, "scalars": scalars}
    options = {k: ",".join(map(str, v)) for k, v in joined.items() if v}
    return spark.read.format("frames_hdf5").options(dataset=dataset, **options).load()


def read_protocol(spark: SparkSession, files: list[str], protocol: Protocol, **settings) -> DataFrame:
    """read_hdf of every attribute that the protocol names: its one stack, its sequences and scalars, each at one place in all files."""
    _need()
    import h5py

    names = {}
    for name in files:
        with h5py.File(name) as f:
            names[name] = datasets(f)
    places = {a: protocol.common_path(a, names) for a in protocol.paths}
    of = lambda kind: [p for a, p in places.items() if protocol.kind(a) == kind]
    (stack,) = of("stack")
    return read_hdf(spark, files, stack, values=of("sequence"), scalars=of("scalar"), **settings)


def write_part(rows: Iterator[pa.RecordBatch], folder: str, dataset: str) -> tuple[str, int] | None:
    """Writes one task's whole frames (frame, modules) to a file of its own, which gets its name when it is complete."""
    import h5py

    from streakframe.operators.blocks import images

    draft = name = None
    out, count = None, 0
    for batch in rows:
        for frame, _, image in images(batch):
            if out is None:
                name = f"{folder}/{frame:012d}-{uuid.uuid4().hex}.h5"
                draft = h5py.File(f"{name}.draft", "w")
                out = draft.create_dataset(dataset, shape=(0, *image.shape), maxshape=(None, *image.shape), chunks=(1, *image.shape), dtype="f8")
                ids = draft.create_dataset("frames", shape=(0,), maxshape=(None,), dtype="i8")
            out.resize(count + 1, axis=0)
            ids.resize(count + 1, axis=0)
            out[count], ids[count] = image, frame
            count += 1
    if draft is None:
        return None
    draft.close()
    Path(f"{name}.draft").rename(name)
    return name, count


def write_hdf(block: DataFrame, folder: str, dataset: str = "entry/data/data", mode: str = "append", parts: int = 8) -> list[str]:
    """Writes the block layout to files of `folder`, a path that all machines mount; returns the new files.

    append adds files; overwrite and insert write the whole new set first and then remove the old files: all of them, or for
    insert those whose other frames were written anew beside the given ones.
    """
    _need()
    from streakframe.operators.blocks import gathered

    spark = block.sparkSession
    ship(spark)
    Path(folder).mkdir(parents=True, exist_ok=True)
    old = sorted(map(str, Path(folder).glob("*.h5")))
    if mode not in ("append", "overwrite", "insert"):
        raise ValueError(f"mode can't be {mode}")
    if mode == "insert" and old:
        there = read_hdf(spark, old, dataset, values=["frames"]).withColumn("frame", F.col("frames").cast("long"))
        kept = there.join(block.select("frame").distinct(), "frame", "left_anti")
        block = block.unionByName(kept.select(block.columns))

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if found := write_part(batches, folder, dataset):
            yield pa.RecordBatch.from_arrays([pa.array([found[0]]), pa.array([found[1]], pa.int64())], ["file", "frames"])

    dealt = gathered(block).repartitionByRange(parts, "frame").sortWithinPartitions("frame")
    new = [r.file for r in dealt.mapInArrow(written, "file string, frames long").collect()]  # a row for each part
    for name in old if mode != "append" else []:
        Path(name).unlink()
    return sorted(new)
