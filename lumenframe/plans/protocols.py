"""Preprocessing pipelines: ordered steps over a points table, and the named protocols."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..operators import baselines, spectral

Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Pipeline:
    """Named steps applied in order; the result carries the pipeline's text in ``protocol``."""

    steps: tuple[tuple[str, Step], ...]

    def apply(self, pts: DataFrame) -> DataFrame:
        for _, step in self.steps:
            pts = pts.transform(step)
        return pts.withColumn("protocol", F.lit(repr(self)))

    def __repr__(self) -> str:
        return " > ".join(name for name, _ in self.steps)


def _step(name: str, f: Callable, **options) -> tuple[str, Step]:
    text = ", ".join(f"{k}={v}" for k, v in options.items())
    return f"{name}({text})", lambda df: f(df, **options)


_CLEAN = (_step("crop", spectral.crop), _step("despike", spectral.despike))
_ARPLS = _step("baseline", baselines.subtract_baseline, method="arpls", lam=1e5)
_AREA = _step("normalise", spectral.normalise, method="area")


def _poly(order: int) -> tuple[str, Step]:
    return _step("baseline", baselines.subtract_baseline, method="poly", order=order)


PROTOCOLS = {
    "minimal": Pipeline(_CLEAN),
    "carbon_dg": Pipeline((*_CLEAN, _ARPLS, _step("savgol", spectral.savgol, window=C.SG_WINDOW), _AREA)),
    "arpls": Pipeline((*_CLEAN, _ARPLS, _step("normalise", spectral.normalise, method="vector"))),
    "chord": Pipeline((*_CLEAN, _poly(1), _AREA)),
    "poly3": Pipeline((*_CLEAN, _poly(3), _AREA)),
}


def protocol(name: str) -> Pipeline:
    """A named protocol; an unknown name is a KeyError."""
    return PROTOCOLS[name]
