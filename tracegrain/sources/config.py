"""The experiment configuration: one JSON object, read on the driver."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tracegrain.model import Poi


def _pairs(events: list) -> list[tuple[str, str]]:
    return [(e[0], e[1]) for e in events]


def _above_zero(n: Any) -> int:
    if int(n) <= 0:
        raise ValueError("not above zero")
    return int(n)


#: For each field of the file: what a case's value is like, its test, and what it becomes.
FIELDS: dict[str, tuple[str, Callable[[Any], bool], Callable[[Any], Any]]] = {
    "ground_truth": ("a list of events with two items or more", lambda v: isinstance(v, list) and all(isinstance(e, list) and len(e) > 1 for e in v), _pairs),
    "poi_events": ("source, target and key", lambda v: isinstance(v, list) and len(v) > 2, lambda v: Poi(v[0], v[1], int(v[2]))),
    "windows": ("a number above zero", lambda v: isinstance(v, int | str | float), _above_zero),
}


def _field(data: dict, name: str) -> dict:
    values = data.get(name, {})
    if not isinstance(values, dict):
        raise ValueError(f"configuration field {name!r} is not an object")
    like, good, become = FIELDS.get(name, ("", lambda v: True, lambda v: v))
    out = {}
    for case, value in values.items():
        try:
            if not good(value):
                raise ValueError(value)
            out[case] = become(value)
        except (TypeError, ValueError) as odd:
            raise ValueError(f"{name}[{case!r}] is not {like}") from odd
    return out


def named_cases(variable: str = "APT_POI_NAMES") -> list[str]:
    """Cases that an environment variable lists, parted by commas."""
    return [x.strip() for x in os.environ.get(variable, "").split(",") if x.strip()]


def data_root() -> str:
    return os.environ.get("APT_DATA_ROOT", "data")


def output_root() -> str:
    return os.environ.get("APT_OUTPUT_ROOT", "output")


@dataclass(frozen=True)
class Config:
    ground_truth: dict[str, list[tuple[str, str]]] = field(default_factory=dict)
    poi: dict[str, Poi] = field(default_factory=dict)
    windows: dict[str, int] = field(default_factory=dict)
    metadata: dict = field(default_factory=dict)

    @classmethod
    def load(cls, path: str | None = None) -> Config:
        """From ``path``, else the file that APT_CONFIG names, else config.json here."""
        where = Path(path or os.environ.get("APT_CONFIG", "config.json")).expanduser()
        data = json.loads(where.read_text(encoding="utf-8"))
        if not isinstance(data, dict):
            raise ValueError("the configuration is not a JSON object")
        return cls(*(_field(data, name) for name in (*FIELDS, "metadata")))

    def check(self) -> None:
        """Every case has both ground truth and an event of interest, and dot files are named by a list."""
        if odd := set(self.ground_truth) ^ set(self.poi):
            raise ValueError(f"cases with ground truth or event of interest only: {', '.join(sorted(odd))}")
        dots = self.metadata.get("dot_file_names", [])
        if not isinstance(dots, list) or not all(isinstance(x, str) for x in dots):
            raise ValueError("metadata.dot_file_names is not a list of names")

    def chosen(self, asked: list[str]) -> list[str]:
        """The cases asked for, else those that the environment names, else all; an error if there are none or unknown ones."""
        cases = asked or named_cases() or sorted(self.poi)
        if not cases:
            raise ValueError("no cases are configured")
        if odd := [c for c in cases if c not in self.ground_truth or c not in self.poi]:
            raise ValueError(f"unknown or incomplete cases: {', '.join(odd)}")
        return cases

    def windows_of(self, case: str) -> int:
        """The case's number of windows, else that of APT_WINDOWS_NUM, else 10."""
        return self.windows.get(case) or _above_zero(os.environ.get("APT_WINDOWS_NUM", "10"))

    def is_dot(self, case: str) -> bool:
        return case in self.metadata.get("dot_file_names", []) or case in named_cases("APT_DOT_FILE_NAMES")

    def graph_path(self, root: str, case: str) -> str:
        return f"{root}/graph/{'dot/back' if self.is_dot(case) else 'back_add'}/{case}"

    def truth(self, spark: SparkSession, case: str) -> DataFrame:
        return spark.createDataFrame([(case, *pair) for pair in self.ground_truth.get(case, [])], "case string, src string, dst string")
