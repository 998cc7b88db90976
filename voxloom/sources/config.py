"""Configuration of a run: read from JSON or TOML (or YAML where its package is installed) and checked before any job."""

from __future__ import annotations

import json
import tomllib
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.operators.tiling import Grid


@dataclass(frozen=True)
class Fit:
    patch: tuple[int, int, int] = (4, 4, 8)
    stride: tuple[int, int, int] = (4, 4, 8)
    experts: tuple[str, ...] = ("e1", "e2")
    ridge: float = 1e-4
    tau: float = 0.3
    edge: float = 0.0
    gradient: float = 0.0
    taper: str = "hann"

    def grid(self, shape: tuple[int, int, int]) -> Grid:
        return Grid(shape, tuple(self.patch), tuple(self.stride))


@dataclass(frozen=True)
class Config:
    data: str = ""
    out: str = ""
    folds: int = 3
    spacings: tuple[str, ...] = ("F", "O", "P")
    pulses: tuple[str, ...] = ("A", "N", "R")
    baseline: str | None = None
    store: str | None = None  # a store of volumes (volume_lines) instead of the tables in data; then spacings and pulses have one entry each
    labels: str | None = None
    fit: Fit = field(default_factory=Fit)

    def problems(self) -> list[str]:
        """What is wrong with it, as sentences; an empty list if nothing is."""
        found = []
        if not self.data and not self.store:
            found.append("data names no folder, and store none either")
        if self.store and (len(self.spacings) != 1 or len(self.pulses) != 1):
            found.append("with a store, spacings and pulses need one entry each")
        if self.folds < 2:
            found.append("folds must be 2 or more")
        if any(n < 1 for n in (*self.fit.patch, *self.fit.stride)) or len(self.fit.patch) != 3 or len(self.fit.stride) != 3:
            found.append("patch and stride need three sides of 1 or more")
        elif any(s > p for s, p in zip(self.fit.stride, self.fit.patch, strict=True)):
            found.append("a stride over the patch leaves voxels without a tile")
        if len(self.fit.experts) < 2 or len(set(self.fit.experts)) < len(self.fit.experts):
            found.append("fit needs two experts or more, each once")
        if self.fit.ridge < 0 or self.fit.edge < 0 or self.fit.gradient < 0 or not 0 <= self.fit.tau <= 1:
            found.append("ridge, edge and gradient can't be negative, and tau is from 0 to 1")
        if self.fit.taper not in ("hann", "flat"):
            found.append("taper is hann or flat")
        return found


def _made(kind: type, given: dict):
    known = {f.name for f in fields(kind)}
    if unknown := sorted(set(given) - known):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def from_dict(given: dict) -> Config:
    config = _made(Config, given | {"fit": _made(Fit, given.get("fit", {}))})
    if found := config.problems():
        raise ValueError("; ".join(found))
    return config


def load(path: str, **changes) -> Config:
    """The configuration in a file, with changes that are not None over it."""
    text, suffix = Path(path).read_text(encoding="utf-8"), Path(path).suffix
    if suffix == ".toml":
        given = tomllib.loads(text)
    elif suffix in (".yaml", ".yml"):
        try:
            import yaml
        except ImportError as e:
            raise ValueError("reading YAML needs the yaml package; use JSON or TOML") from e
        given = yaml.safe_load(text)
    else:
        given = json.loads(text)
    return from_dict(given | {k: v for k, v in changes.items() if v is not None})


def to_json(config: Config) -> str:
    return json.dumps(asdict(config), indent=2, sort_keys=True)


def manifest_problems(manifest: DataFrame, unit: str = "patient_id") -> list[str]:
    """What is wrong with a manifest(fold, split, unit): units on both sides of a fold, folds without a side, and units that no fold or several test."""
    found = []
    sides = manifest.groupBy("fold", unit).agg(F.countDistinct("split").alias("n"))
    if n := sides.where("n > 1").count():
        found.append(f"{n} units train and test in one fold")
    empty = manifest.groupBy("fold").agg(F.countDistinct("split").alias("n")).where("n < 2").count()
    if empty:
        found.append(f"{empty} folds lack a side")
    tested = manifest.select(unit).distinct().join(manifest.where("split = 'test'").groupBy(unit).agg(F.count("*").alias("n")), unit, "left")
    if n := tested.where("coalesce(n, 0) <> 1").count():
        found.append(f"{n} units are not tested exactly once")
    return found
