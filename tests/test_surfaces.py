"""Roots along lines and response surfaces against closed forms."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremolite.operators.surfaces import least_squares, line_root, line_roots, response_surface, roots


def test_line_roots(spark):
    rows = spark.range(200).select("id", ((F.col("id") - 100) / 20.0).alias("v"), F.when(F.col("id") % 50 == 7, None).otherwise(1.0).alias("w"))
    got = rows.select("v", "w", line_root(lambda r: F.col("w") * (F.col("v") - r), -3.0, 4.0).alias("line"), line_root(lambda r: F.exp(r) - 2 - F.abs("v"), 0.0, 10.0).alias("exp"), line_root(lambda r: (r - F.col("v")) * (r - F.col("v")) * (r - F.col("v")), -30.0, 40.0).alias("cube")).collect()
    for r in got:
        if r.w is None or not -3 <= r.v <= 4:
            assert r.line is None
        else:
            assert r.line == pytest.approx(r.v, abs=1e-12)
        assert r.exp == pytest.approx(math.log(2 + abs(r.v)), abs=1e-12) and r.cube == pytest.approx(r.v, abs=1e-4)


def test_least_squares(spark):
    rng = np.random.default_rng(3)
    data = [(int(g), float(x), float(z), float(2 + g - x + 3 * z * z + rng.normal())) for g, x, z in zip(rng.integers(0, 3, 300), rng.normal(size=300), rng.normal(size=300), strict=True)]
    rows = spark.createDataFrame([*data, (0, None, 1.0, 1.0), (1, 1.0, 1.0, None), (9, 2.0, 0.0, 4.0)], "g int, x double, z double, y double")
    got = {r.g: r for r in least_squares(rows, ["g"], [F.lit(1.0), F.col("x"), F.col("z") * F.col("z")], F.col("y")).collect()}
    for g in range(3):
        part = np.array([d for d in data if d[0] == g])
        a = np.column_stack([np.ones(len(part)), part[:, 1], part[:, 2] ** 2])
        assert got[g].n == len(part) and np.allclose(got[g].coefficients, np.linalg.lstsq(a, part[:, 3], rcond=None)[0], atol=1e-9)
    c = got[9].coefficients  # one row: any coefficients that meet it
    assert c[0] + 2 * c[1] == pytest.approx(4.0) and c[2] == 0
    assert least_squares(rows.limit(0), ["g"], [F.lit(1.0)], F.col("y")).count() == 0


def test_surface_finds_its_design_point(spark):
    """A linear state needs one look more; a curved one moves its centre to where it is tangent."""
    rng = np.random.default_rng(5)
    u = rng.normal(scale=2.0, size=(4000, 2))
    rows = [("line", float(a), float(b), float(3 - 0.6 * a - 0.8 * b)) for a, b in u[:1500]] + [("curve", float(a), float(b), float(math.exp(1 - 0.5 * a) - math.exp(0.5 * b))) for a, b in u]
    rows += [("flat", float(a), float(b), 2.0) for a, b in u[:50]]
    got = {r.name: r for r in response_surface(spark.createDataFrame(rows, "name string, a double, b double, g double"), ["name"], ["a", "b"], "g", width=0.5, rounds=8).collect()}
    assert set(got) == {"line", "curve", "flat"}
    assert got["line"].beta == pytest.approx(3.0, abs=1e-6) and got["line"].point == pytest.approx([1.8, 2.4], abs=1e-6) and got["line"].rounds == 2
    assert got["curve"].point == pytest.approx([1.0, 1.0], abs=0.05) and got["curve"].rounds > 2
    assert got["line"].n == 1500 and got["flat"].n == 50


def test_roots_in_lockstep(spark):
    """A few calls of g find simple roots, as many as halving needs find any; a row without one stays null."""
    calls = []

    def g(r, v):
        calls.append(len(r))
        return np.exp(r) - 2 - np.abs(v)

    v = np.linspace(-5, 5, 1000)
    got = roots(lambda r: g(r, v), np.zeros(1000), np.full(1000, 10.0))
    assert got == pytest.approx(np.log(2 + np.abs(v)), abs=1e-12) and len(calls) < 30
    assert roots(lambda r: (r - v) ** 3, np.full(1000, -30.0), np.full(1000, 40.0)) == pytest.approx(v, abs=1e-4)
    steep = roots(lambda r: np.where(r < v, -1e-9, 1e9), np.full(1000, 40.0), np.full(1000, -30.0))
    assert steep == pytest.approx(v, abs=1e-12)
    rows = spark.range(200).select("id", ((F.col("id") - 100) / 20.0).alias("v"), F.when(F.col("id") % 50 == 7, None).otherwise(1.0).alias("w"))
    pair = rows.select("v", "w", line_roots(lambda r, v, w: w * (v - r), -3.0, 4.0, "v", "w").alias("fast"), line_root(lambda r: F.col("w") * (F.col("v") - r), -3.0, 4.0).alias("slow")).collect()
    assert sum(r.fast is None for r in pair) == sum(r.slow is None for r in pair) > 50 and all((r.fast is None) == (r.slow is None) and (r.fast is None or r.fast == pytest.approx(r.v, abs=1e-12)) for r in pair)
