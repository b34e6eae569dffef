"""Stages run in order, with limits, forced or only some of them, and per-item failures that do not stop the others."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.operators import raster


def limit_of(explicit: int | None, preset: int | None) -> int | None:
    """An explicit limit beats the preset's."""
    return explicit if explicit is not None else preset


def run_stages(stages: list[tuple[str, Callable]], first, only: Iterable[str] | None = None, done: Iterable[str] = (), force: bool = False):
    """The result of the named stages in order, each given the one before's; those done are left out unless forced. An unknown name is an error."""
    names = [n for n, _ in stages]
    wanted = set(names if only is None else only)
    if unknown := wanted - set(names):
        raise ValueError(f"unknown stages {sorted(unknown)}: {names}")
    out = first
    for name, stage in stages:
        if name in wanted and (force or name not in set(done)):
            out = stage(out)
    return out


def each(items: Iterable, work: Callable) -> tuple[list[tuple[object, str, str | None]], int]:
    """(item, status, error) for every item, and the exit code: 1 if any failed. One that fails does not stop the others."""
    rows = []
    for item in items:
        try:
            work(item)
            rows.append((item, "ok", None))
        except Exception as e:
            rows.append((item, "erro", str(e)))
    return rows, int(any(s == "erro" for _, s, _ in rows))


def failed_rows(rows: DataFrame, sound, why: str) -> tuple[DataFrame, DataFrame]:
    """Sound rows, and the others with the reason: per-row failures of a distributed step."""
    return rows.where(sound), rows.where(~F.coalesce(sound, F.lit(False))).withColumn("erro", F.lit(why))


def dating_job(series: Callable[[], DataFrame], validate: Callable[[DataFrame], bool], date: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Three phases: the series is made, must be valid, and is dated."""
    s = series()
    if not validate(s):
        raise ValueError("the series is not valid")
    return date(s)


def label_source(source: str, form: str = "raster") -> tuple[str, dict[int, int]]:
    """The path token and class table of a source of labels; a form other than rasters is an error."""
    if form != "raster":
        raise ValueError(f"form {form} is not supported: raster")
    return ("labels-dw" if source == "dynamic_world" else "labels"), raster.remap_table(source)
