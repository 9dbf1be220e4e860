"""The detector catalogue: registration, listing and running one or all."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Detector:
    ident: str
    name: str
    description: str
    run: Callable[..., DataFrame]
    params: Mapping[str, object] = field(default_factory=dict)


_DETECTORS: dict[str, Detector] = {}


def register_detector(ident: str, name: str, description: str, **params):
    """Add a function ``(tables, **params) -> DataFrame`` to the catalogue."""
    def add(fn):
        _DETECTORS[ident] = Detector(ident, name, description, fn, params)
        return fn
    return add


def detector(ident: str) -> Detector:
    if ident not in _DETECTORS:
        raise KeyError(f"unknown detector: {ident}")
    return _DETECTORS[ident]


def idents() -> list[str]:
    """The ids of all detectors, in order of registration."""
    return list(_DETECTORS)


def list_detectors(spark: SparkSession) -> DataFrame:
    """The catalogue as a table."""
    rows = [(d.ident, d.name, d.description, {k: str(v) for k, v in d.params.items()})
            for d in _DETECTORS.values()]
    return spark.createDataFrame(
        rows, "id string, name string, description string, params map<string,string>")


def run_detector(ident: str, tables: Mapping[str, DataFrame], **params) -> DataFrame:
    """Run one detector with its default parameters, some of them overridden."""
    d = detector(ident)
    unknown = set(params) - set(d.params)
    if unknown:
        raise TypeError(f"{ident} has no parameter {sorted(unknown)}")
    return d.run(tables, **{**d.params, **params})


def run_all(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """All detectors with default parameters, as lazy frames by ``id_name``."""
    return {f"{d.ident}_{d.name}": run_detector(d.ident, tables) for d in _DETECTORS.values()}
