"""Timed trials, their records, and reports over them."""

from __future__ import annotations

import itertools
import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def run(name: str, kernel: Callable, trials: int = 3, prepare: Callable | None = None, verify: Callable | None = None, labels: dict | None = None) -> list[dict]:
    """One record a trial: seconds of the kernel, of preparation before it, and of verification after it, each by itself."""
    records = []
    for trial in range(trials):
        start = time.perf_counter()
        ready = prepare() if prepare else None
        prepared = time.perf_counter()
        result = kernel(ready) if prepare else kernel()
        done = time.perf_counter()
        ok = bool(verify(result)) if verify else None
        records.append({"name": name, "trial": trial, "seconds": done - prepared, "prepare_seconds": prepared - start, "verify_seconds": time.perf_counter() - done, "verified": ok, **(labels or {})})
    return records


def write(records: list[dict], path: str) -> None:
    with open(path, "a") as out:
        for r in records:
            out.write(json.dumps(r) + "\n")


def line(record: dict) -> str:
    """A record as one line of text."""
    mark = "" if record["verified"] is None else f" {'PASS' if record['verified'] else 'FAIL'} {record['verify_seconds']:.6f}"
    rest = " ".join(str(v) for k, v in record.items() if k not in ("name", "trial", "seconds", "prepare_seconds", "verify_seconds", "verified"))
    return f"@@@ {record['seconds']:.6f}{mark} {record['prepare_seconds']:.6f} {record['name']} {rest}".rstrip()


def summary(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    """Trials, mean and median seconds, and the speed-up over the first group."""
    rows = spark.read.json(path).groupBy(*by).agg(F.count("*").alias("trials"), F.avg("seconds").alias("mean_seconds"), F.median("seconds").alias("median_seconds"))
    return rows.withColumn("speed_up", F.first("mean_seconds").over(Window.orderBy(*by)) / F.col("mean_seconds"))  # a row per group


def collect_log(spark: SparkSession, path: str) -> DataFrame:
    """(number, parameters, line) of a log: each `@@@` line with the last `@@#` line before it."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("number", "value"))
    told = rows.withColumn("parameters", F.last(F.when(F.col("value").startswith("@@#"), F.trim(F.substring("value", 4, 1 << 20))), True).over(Window.orderBy("number")))
    return told.where(F.col("value").startswith("@@@")).select("number", "parameters", F.trim(F.substring("value", 4, 1 << 20)).alias("line"))


def parameter_grid(parameters: dict) -> list[dict]:
    """All combinations; `start:stop:step` names a range that includes its stop."""

    def values(x):
        if isinstance(x, str) and x.count(":") == 2:
            start, stop, step = map(int, x.split(":"))
            return list(range(start, stop + 1, step))
        return x if isinstance(x, list | tuple) else [x]

    return [dict(zip(parameters, combo)) for combo in itertools.product(*map(values, parameters.values()))]


class Pipeline:
    """Named stages, each a function of what the one before returned, with the seconds each took to build."""

    def __init__(self):
        self.stages: list[tuple[str, Callable]] = []
        self.seconds: dict[str, float] = {}

    def stage(self, name: str, f: Callable) -> Pipeline:
        self.stages.append((name, f))
        return self

    def run(self, value=None):
        for name, f in self.stages:
            start = time.perf_counter()
            value = f(value)
            self.seconds[name] = time.perf_counter() - start
        return value
