"""Parameters of the pipelines as dataclasses, and their JSON and INI files.

In a file each field that is itself a dataclass is a section; plain fields of the top class are in the section `parameters`.
"""

from __future__ import annotations

import configparser
import dataclasses
import json
import types
import typing
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from streakframe.kernels.structure import Structure

TOP = "parameters"


@dataclass(frozen=True)
class Roi:
    xmin: int = 0
    xmax: int = 0
    ymin: int = 0
    ymax: int = 0

    def to_roi(self) -> tuple[int, int, int, int]:
        return self.ymin, self.ymax, self.xmin, self.xmax

    def size(self) -> int:
        return max(0, self.ymax - self.ymin) * max(0, self.xmax - self.xmin)


@dataclass(frozen=True)
class StructureConfig:
    radius: int = 1
    connectivity: int = 1

    def to_structure(self, rank: int = 2) -> Structure:
        return Structure((self.radius,) * rank, self.connectivity)


@dataclass(frozen=True)
class Mask:
    method: str = "no-bad"
    vmin: float = 0.0
    vmax: float = 65535.0
    snr_max: float = 3.0
    std_min: float = 0.0
    std_max: float = 0.0


@dataclass(frozen=True)
class Background:
    method: str = "median-poisson"
    r0: float = 0.0
    r1: float = 0.5
    n_iter: int = 12
    lm: float = 9.0


@dataclass(frozen=True)
class Metadata:
    mask: Mask = field(default_factory=Mask)
    background: Background = field(default_factory=Background)
    roi: Roi = field(default_factory=Roi)


@dataclass(frozen=True)
class Scaling:
    method: str = "no-scale"
    good_fields: tuple[int, ...] = (0,)
    r0: float = 0.5
    r1: float = 0.99
    n_iter: int = 3
    lm: float = 9.0


@dataclass(frozen=True)
class Regions:
    structure: StructureConfig = field(default_factory=StructureConfig)
    vmin: float = 1.0
    npts: int = 1


@dataclass(frozen=True)
class RegionFinder:
    regions: Regions = field(default_factory=Regions)
    scaling: Scaling = field(default_factory=Scaling)
    center: tuple[float, float] | None = None
    roi: Roi = field(default_factory=Roi)
    std_min: float = 0.0


@dataclass(frozen=True)
class StreakGrowth:
    structure: StructureConfig = field(default_factory=StructureConfig)
    xtol: float = 1.0
    vmin: float = 1.0
    min_size: float = 1.0
    nfa: int = 0


@dataclass(frozen=True)
class StreakFinder:
    """cross_module: neighbourhoods reach over modules."""

    peaks: Regions = field(default_factory=Regions)
    streaks: StreakGrowth = field(default_factory=StreakGrowth)
    scaling: Scaling = field(default_factory=Scaling)
    center: tuple[float, float] | None = None
    std_min: float = 0.0
    cross_module: bool = True


@dataclass(frozen=True)
class Indexing:
    shape: tuple[int, int, int] = (31, 31, 31)
    width: float = 2.0
    threshold: float = 0.5
    n_max: int = 30
    vicinity: StructureConfig = field(default_factory=StructureConfig)
    connectivity: StructureConfig = field(default_factory=StructureConfig)


@dataclass(frozen=True)
class Run:
    """Where a run's frames are: a folder pattern with {run_id}, and how its files are named."""

    facility: str = "parquet"
    data_dir: str = "run-{run_id}"
    file_pattern: str = r".*\.parquet"
    num_modules: int = 1
    starts_at: int = 0
    geometry_file: str = ""


@dataclass(frozen=True)
class Scan:
    scan_num: int = 0
    image_kind: str = "stacked"
    output_dir: str = "."
    hit_threshold: int = 0
    n_frames: int = 10
    spacing: int = 10
    run: Run = field(default_factory=Run)

    @property
    def apply_geometry(self) -> bool:
        return self.image_kind == "full"

    def file(self, kind: str, first_frame: int | None = None, suffix: str = "") -> str:
        """scan_<number>_<kind>[_f<frame>][_<suffix>] in the output folder."""
        frame = "" if first_frame is None else f"_f{first_frame:04d}"
        return f"{self.output_dir}/scan_{self.scan_num}_{kind}{frame}{'_' + suffix if suffix else ''}"


def _read(kind: Any, value: Any) -> Any:
    """value, from JSON or INI text, as what a field's type says."""
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if dataclasses.is_dataclass(kind):
        return from_dict(kind, value)
    if origin in (typing.Union, types.UnionType):
        if value is None or value in ("", "None"):
            return None
        return _read(next(a for a in args if a is not type(None)), value)
    if origin in (tuple, list):
        parts = json.loads(value.replace("(", "[").replace(")", "]")) if isinstance(value, str) else value
        kinds = [args[0]] * len(parts) if len(args) < 2 or args[1] is Ellipsis else args
        return origin(_read(k, p) for k, p in zip(kinds, parts, strict=True))
    if origin is dict:
        return {k: _read(args[1], v) for k, v in (json.loads(value) if isinstance(value, str) else value).items()}
    if kind is bool and isinstance(value, str):
        if value.lower() not in ("true", "false", "1", "0", "yes", "no", "on", "off"):
            raise ValueError(f"{value} is neither true nor false")
        return value.lower() in ("true", "1", "yes", "on")
    return kind(value)


def from_dict(kind: type, values: dict) -> Any:
    hints = typing.get_type_hints(kind)
    if unknown := values.keys() - hints.keys():
        raise KeyError(f"{kind.__name__} has no {sorted(unknown)}")
    return kind(**{k: _read(hints[k], v) for k, v in values.items()})


def to_dict(config: Any) -> dict:
    return dataclasses.asdict(config)


def replace(config: Any, **values: Any) -> Any:
    return dataclasses.replace(config, **values)


def _sections(config: Any) -> dict[str, dict]:
    plain = {k: v for k, v in to_dict(config).items() if not isinstance(v, dict)}
    return {**({TOP: plain} if plain else {}), **{k: v for k, v in to_dict(config).items() if isinstance(v, dict)}}


def _joined(kind: type, sections: dict[str, dict]) -> Any:
    return from_dict(kind, {**sections.get(TOP, {}), **{k: v for k, v in sections.items() if k != TOP}})


def write(config: Any, path: str | Path) -> None:
    """JSON or INI by the file's ending. A section's own sections are JSON text in INI."""
    if Path(path).suffix == ".json":
        Path(path).write_text(json.dumps(_sections(config), indent=2))
        return
    if Path(path).suffix != ".ini":
        raise ValueError(f"{path}: neither .json nor .ini")
    out = configparser.ConfigParser(interpolation=None)
    text = lambda v: json.dumps(v) if isinstance(v, (dict, list, tuple)) else "None" if v is None else str(v)
    out.read_dict({name: {k: text(v) for k, v in values.items()} for name, values in _sections(config).items()})
    with open(path, "w") as f:
        out.write(f)


def read(kind: type, path: str | Path) -> Any:
    if Path(path).suffix == ".json":
        return _joined(kind, json.loads(Path(path).read_text()))
    if Path(path).suffix != ".ini":
        raise ValueError(f"{path}: neither .json nor .ini")
    source = configparser.ConfigParser(interpolation=None)
    source.read_string(Path(path).read_text())
    sections = {name: {k: json.loads(v) if v.startswith("{") else v for k, v in source[name].items()} for name in source.sections()}
    return _joined(kind, sections)
