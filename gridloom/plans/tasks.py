"""Feature tasks from a file, and command lists for ablation studies."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators.features import calculate
from ..workspace import FEATURE, Workspace


def _many(value) -> list:
    return [] if value is None else list(value) if isinstance(value, list) else [value]


def load_tasks(path: str) -> list[dict]:
    """tasks of a JSON file: table, method, and optionally case and source; methods and sources may be lists."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)["tasks"]


def _numbered(stem: str, taken: tuple[str, ...]) -> str:
    name, n = stem, 0
    while name in taken:
        n += 1
        name = f"{stem}_{n}"
    return name


def feature_tables(grid: DataFrame, layers: dict[str, DataFrame], tasks: list[dict], free: Callable[[str, tuple[str, ...]], str] = _numbered) -> dict[str, DataFrame]:
    """A feature table for each task and category; tasks on one layer get numbered names.

    free: a name made from a stem that is not among those given.
    """
    out: dict[str, DataFrame] = {}
    for task in tasks:
        for case in _many(task.get("case")) or [None]:
            name = free(FEATURE + task["table"], tuple(out))
            out[name] = calculate(grid, layers[task["table"]], _many(task["method"]), _many(task.get("source")), case)
    return out


def run_tasks(space: Workspace, tasks: list[dict], overwrite: bool = False) -> list[str]:
    """Compute and store the feature tables of the tasks; tables that are there stay, and new ones get the next number,
    unless they are to be overwritten."""
    layers = {t["table"]: space.read(t["table"]) for t in tasks}
    made = feature_tables(space.read("grid"), layers, tasks, _numbered if overwrite else space.unique_name)
    return [space.write(df, name, overwrite, "geohash") for name, df in made.items()]


def ablations(groups: dict[str, str], command: str) -> list[str]:
    """A command for all features and one without each group: {pattern} and {name} in the command are filled in.

    groups: name -> regular expression of the group's features. A group is left out by an inverted selection.
    """
    whole = [command.format(name="all", pattern=".*", invert="")]
    return whole + [command.format(name=f"no_{n}", pattern=p, invert="--invert") for n, p in groups.items()]
