"""Scoring throughput: rows and tokens counted by the scoring job itself, wall and task time."""

import time

from pyspark.sql import DataFrame, Observation, functions as F


def task_seconds(spark) -> float:
    """Seconds that tasks of this session have run so far, over all executors."""
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalDuration() for i in range(executors.size())) / 1000


def score_throughput(df: DataFrame, scorer, size, runs: int = 3) -> dict:
    """Mean over ``runs`` of scoring ``df`` after one run that is not counted.

    ``scorer`` maps rows to scored rows; ``size`` is a column of ``df``, the tokens of a row. Nothing is
    collected: rows and tokens are observed as they pass, so a scorer that loses rows shows.
    """
    spark = df.sparkSession

    def once(name: str):
        seen = Observation(name)
        counted = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(size).alias("tokens"))
        wall, tasks = time.perf_counter(), task_seconds(spark)
        scorer(counted).write.format("noop").mode("overwrite").save()
        wall = time.perf_counter() - wall
        return wall, task_seconds(spark) - tasks, seen.get

    once("warm-up")
    found = [once(f"run-{i}") for i in range(runs)]
    rows, tokens = found[0][2]["rows"], found[0][2]["tokens"] or 0
    wall, tasks = (sum(f[i] for f in found) / runs for i in (0, 1))
    return {
        "rows": rows, "tokens": tokens, "rows_per_s": round(rows / wall, 1), "tokens_per_s": round(tokens / wall, 1),
        "ms_per_row": round(1000 * wall / max(rows, 1), 5), "task_ms_per_row": round(1000 * tasks / max(rows, 1), 5),
    }
