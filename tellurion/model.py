"""Schemas and the lazy Survey: points, grid and their recipe.

``points``: survey_id, pid (order of acquisition), track, x, y, value and optional coordinates.
``grid``: survey_id, iy, ix, z. ``grid_info``: survey_id, nx, ny, x_min, x_max, y_min, y_max.
A missing value is NULL; NaN never enters (sources turn it to NULL).
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame

POINTS = "survey_id string, pid bigint, track int, x double, y double, value double, east double, north double, lon double, lat double"
GRID = "survey_id string, iy int, ix int, z double"
GRID_INFO = "survey_id string, nx int, ny int, x_min double, x_max double, y_min double, y_max double"

#: name -> (part of the survey that it works on, function of a DataFrame and parameters)
STEPS: dict[str, tuple[str, Callable[..., DataFrame]]] = {}


def step(name: str, part: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Register a function as a recipe step on 'points' or 'grid'."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        STEPS[name] = (part, f)
        return f

    return register


@dataclass(frozen=True)
class Survey:
    """Immutable and lazy; every step gives a new survey whose recipe is one entry longer."""

    name: str
    points: DataFrame | None = None
    grid: DataFrame | None = None
    grid_info: DataFrame | None = None
    history: tuple[dict[str, Any], ...] = field(default_factory=tuple)

    def apply(self, name: str, **parameters: Any) -> Survey:
        if name not in STEPS:
            raise ValueError(f"unknown step {name!r}; known: {', '.join(sorted(STEPS))}")
        part, f = STEPS[name]
        frame = getattr(self, part)
        if frame is None:
            raise ValueError(f"step {name!r} needs {part}, which this survey lacks")
        entry = {"step": name, "parameters": parameters}
        return replace(self, **{part: f(frame, **parameters)}, history=(*self.history, entry))

    def recipe(self) -> str:
        return json.dumps(list(self.history), indent=1)

    def export_history(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            f.write(self.recipe())

    def replay(self, recipe: str) -> Survey:
        """All steps of a JSON recipe as one lazy plan."""
        out = self
        for entry in json.loads(recipe):
            out = out.apply(entry["step"], **entry["parameters"])
        return out
