"""Detector geometry text files: lines `key = value` and `panel/key = value`, with `;` comments.

A key without a panel is a default for the panels first named after it. Names that begin with `bad` are bad regions (in
pixels or in detector coordinates, of one panel or all); keys mask and mask<N>_... describe masks; groups are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from streakframe.schema import PANELS

#: Factors to metres and to electron volts. Fixed values.
LENGTHS = {"m": 1.0, "mm": 1e-3, "um": 1e-6}
ENERGIES = {"eV": 1.0, "keV": 1e3, "MeV": 1e6}
#: Photon energy in eV of a wavelength of one Angstrom.
EV_ANGSTROM = 12398.4198

_FLOAT = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
_ARROW = re.compile(rf"({_FLOAT}|[+-]?)\s*([xyz])")


@dataclass
class Panel:
    name: str
    values: dict[str, str] = field(default_factory=dict)

    def number(self, key: str, default: float | None = None) -> float:
        if key not in self.values:
            if default is None:
                raise KeyError(f"panel {self.name} has no {key}")
            return default
        return quantity(self.values[key])

    @property
    def dim(self) -> tuple[str | int, ...]:
        """Axes of the data in order: ss, fs, % (frames) or a fixed number."""
        found = sorted((int(k[3:]), v) for k, v in self.values.items() if re.fullmatch(r"dim\d+", k))
        if not found:
            return ("ss", "fs")
        return tuple(int(v) if re.fullmatch(r"-?\d+", v) else v for _, v in found)

    @property
    def module(self) -> int:
        return next((d for d in self.dim if isinstance(d, int)), 0)


@dataclass
class Geometry:
    panels: dict[str, Panel]
    bad: dict[str, dict[str, float | str]]
    masks: dict[int, dict[str, str | int]]
    top: dict[str, str]

    @property
    def shape(self) -> tuple[int, ...]:
        """Extent of the data without the frame axis."""
        out: list[int] = []
        for p in self.panels.values():
            ends = {"ss": int(p.number("max_ss")) + 1, "fs": int(p.number("max_fs")) + 1}
            own = [ends[d] if isinstance(d, str) else d + 1 for d in p.dim if d != "%"]
            out = [max(a, b) for a, b in zip(out or own, own, strict=True)]
        return tuple(out)


def direction(text: str) -> tuple[float, float, float]:
    """`+1.0x -0.2y`: parts along x, y and z."""
    out = dict.fromkeys("xyz", 0.0)
    for number, axis in _ARROW.findall(text.replace(" ", "")):
        out[axis] += float(number + "1" if number in ("", "+", "-") else number)
    return out["x"], out["y"], out["z"]


def quantity(text: str) -> float:
    """A number with an optional unit, in metres or electron volts; a wavelength in A becomes an energy."""
    found = re.match(rf"\s*({_FLOAT})\s*([A-Za-z]*)", text)
    if not found:
        raise ValueError(f"no number in {text!r}")
    value, unit = float(found[1]), found[2]
    if unit == "A":
        return EV_ANGSTROM / value
    return value * (LENGTHS | ENERGIES).get(unit, 1.0)


def parse(text: str) -> Geometry:
    top: dict[str, str] = {}
    defaults: dict[str, str] = {}
    panels: dict[str, Panel] = {}
    bad: dict[str, dict[str, float | str]] = {}
    masks: dict[int, dict[str, str | int]] = {}
    for line in text.splitlines():
        key, equals, value = line.partition(";")[0].partition("=")
        key, value = key.strip(), value.strip()
        if not equals or not key or not value or re.match(r"(rigid_)?group", key):
            continue
        owner, _, name = key.rpartition("/")
        if owner.startswith("bad"):
            bad.setdefault(owner, {})[name] = value if name in ("panel", "is_fsss") else float(value)
        elif owner:
            panels.setdefault(owner, Panel(owner, dict(defaults))).values[name] = value
        elif found := re.fullmatch(r"mask(\d*)(?:_(\w+))?", name):
            what = found[2] or "data"
            masks.setdefault(int(found[1] or 0), {})[what] = int(value, 0) if what in ("good", "goodbits", "bad", "badbits") else value
        else:
            top[name] = defaults[name] = value
    if len(masks) > 8:
        raise ValueError("more than eight masks")
    for region in bad.values():
        if (panel := region.get("panel")) is not None and panel not in panels:
            raise ValueError(f"bad region of an unknown panel {panel}")
    return Geometry(panels, bad, masks, top)


def panel_rows(geometry: Geometry) -> list[tuple]:
    rows = []
    for k, p in enumerate(geometry.panels.values()):
        edges = [int(p.number(f"{end}_{axis}")) for axis in ("ss", "fs") for end in ("min", "max")]
        arrows = [x for key in ("ss", "fs") for x in direction(p.values[key])]
        rows.append((k, p.name, p.module, edges[0], edges[1], edges[2], edges[3], p.number("corner_x"), p.number("corner_y"), *arrows, p.number("coffset", 0.0), p.number("res", 1.0)))
    return rows


def read_geom(spark: SparkSession, path: str) -> DataFrame:
    """The panels table of a geometry file; read by Spark, so that any store will do."""
    text = spark.read.text(path, wholetext=True).first()[0]
    return spark.createDataFrame(panel_rows(parse(text)), PANELS)
