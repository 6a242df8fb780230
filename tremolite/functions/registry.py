"""Extension points: functions, models and stores that users add by name."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DataType

_MODELS: dict[str, Callable[..., Any]] = {}


def register_function(spark: SparkSession, name: str, function: Callable, returns: DataType | str | None = None) -> None:
    """Make a function callable in SQL: a pandas function as it is, a plain one with its return type."""
    spark.udf.register(name, function, returns) if returns is not None else spark.udf.register(name, function)


def register_model(name: str, build: Callable[..., Any]) -> None:
    """Add a class or builder of a material, element or section model; a name is taken once."""
    if name in _MODELS:
        raise ValueError(f"{name!r} is registered already")
    _MODELS[name] = build


def build_model(name: str, **parameters: Any) -> Any:
    """A model of a registered kind, as when it is read back from a snapshot."""
    if name not in _MODELS:
        raise ValueError(f"unknown model {name!r}; known: {', '.join(sorted(_MODELS))}")
    return _MODELS[name](**parameters)


def load_extension(path: str) -> Any:
    """An object named ``module:attribute``."""
    module, _, attribute = path.partition(":")
    return getattr(importlib.import_module(module), attribute)


class Elastic:
    """A uniaxial model: stress is modulus times strain."""

    def __init__(self, modulus: float):
        self.modulus, self.strain = modulus, 0.0

    def set_strain(self, strain: float) -> None:
        self.strain = strain

    @property
    def stress(self) -> float:
        return self.modulus * self.strain

    @property
    def tangent(self) -> float:
        return self.modulus

    def commit(self) -> None:
        """Nothing to keep."""


class ElasticPlastic(Elastic):
    """Elastic up to a yield stress, then flat."""

    def __init__(self, modulus: float, yield_stress: float):
        super().__init__(modulus)
        self.yield_stress, self.plastic = yield_stress, 0.0

    @property
    def stress(self) -> float:
        return max(-self.yield_stress, min(self.yield_stress, self.modulus * (self.strain - self.plastic)))

    @property
    def tangent(self) -> float:
        return self.modulus if abs(self.modulus * (self.strain - self.plastic)) < self.yield_stress else 0.0

    def commit(self) -> None:
        self.plastic = self.strain - self.stress / self.modulus


register_model("Elastic", Elastic)
register_model("ElasticPP", ElasticPlastic)


def drive_model(strains: DataFrame, by: list[str], order: str, strain: str, model: str, **parameters: Any) -> DataFrame:
    """Step a model through each strain history: adds stress and tangent. Sorted partitions are read as a
    stream, with one model at a time. Models registered by the user must be importable by executors."""
    rows = strains.repartition(*by).sortWithinPartitions(*by, order)
    schema = rows.selectExpr("*", "double(0) as stress", "double(0) as tangent").schema
    build = _MODELS[model]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, None
        for batch in batches:
            stress, tangent = [], []
            for k, e in zip(zip(*(batch[c] for c in by), strict=True), batch[strain], strict=True):
                if k != key:
                    key, held = k, build(**parameters)
                held.set_strain(float(e))
                stress.append(held.stress)
                tangent.append(held.tangent)
                held.commit()
            yield batch.assign(stress=stress, tangent=tangent)

    return rows.mapInPandas(run, schema)
