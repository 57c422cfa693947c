"""Expected against detected IDs on a stream: state per ID, timers for what never comes.

IDs are dealt over a fixed number of buckets by their hash, and a bucket's IDs are one state with one timer,
at the time of its first ID that waits for one: a call of the state store then serves many IDs, and nothing is gathered. Sent
IDs are in state from the start; a timer at their deadline tells those that were never detected.
"""

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.common import shared_folder
from .detect import CLOSING_TIME, run_to_files

_OUT = "nik string, verdict string, ms long, tp int, fp int, fn int"
# Rate of change of the totals by verdict: (tp, fp, fn). A sent ID that shows up past its deadline takes its miss back.
CHANGES = {"TP": (1, 0, 0), "FP": (0, 1, 0), "FN": (0, 0, 1), "late": (1, 0, -1)}
# Buckets of IDs. A checkpoint goes on with the number it began with.
BUCKETS = 1024
# ``ids``: JSON, by ID the deadline (none: nobody sent it), the flags and the time it waits for. ``timer`` is the one registered.
_STATE = "ids string, timer long"
DETECTED, MISSED = 1, 2


def _rows(told: list[tuple[str, str, int]]) -> Iterator[pd.DataFrame]:
    if told:
        niks, verdicts, times = zip(*told)
        change = zip(*(CHANGES[v] for v in verdicts))
        yield pd.DataFrame({"nik": niks, "verdict": verdicts, "ms": times, **dict(zip(("tp", "fp", "fn"), change))})


class IdVerdicts(StatefulProcessor):
    """TP or FP at the first detection of an ID, FN at its deadline without one, ``late`` at the first
    detection after that, by the times of the rows and not of their arrival. An ID that nobody sent is
    forgotten ``forget_ms`` after its last detection. The key is a bucket of IDs."""

    def __init__(self, forget_ms: int):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", _STATE)

    def _ids(self) -> tuple[dict, int | None]:
        found = self.seen.get()
        return (json.loads(found[0]), found[1]) if found else ({}, None)

    def _keep(self, ids: dict, timer: int | None, fired: bool = False) -> None:
        """``timer`` was registered; one that has fired is deleted by Spark."""
        due = min((x[2] for x in ids.values() if x[2] is not None), default=None)
        if due != timer:
            if timer is not None and not fired:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        if ids:
            self.seen.update((json.dumps(ids, separators=(",", ":")), due))
        else:
            self.seen.clear()

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        ids, timer = self._ids()
        for sent in initialState["sent"]:
            for one in sent:
                deadline = int(one["deadline"])
                ids[one["nik"]] = [deadline, 0, deadline]
        self._keep(ids, timer)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = {}
        for part in rows:
            for nik, ms in zip(part["nik"].tolist(), part["ms"].tolist()):
                old = times.get(nik)
                if old is None or old[0] != old[0]:
                    times[nik] = (ms, ms)
                elif ms < old[0] or ms > old[1]:
                    times[nik] = (min(ms, old[0]), max(ms, old[1]))
        if not times:
            return
        ids, timer = self._ids()
        told = []
        for nik, (first, last) in times.items():
            first, last = int(first), int(last)
            deadline, flags, _ = ids.get(nik) or (None, 0, None)
            if deadline is not None and not flags and first > deadline:  # the timer would have fired, had the batch ended before
                flags = MISSED
                told.append((nik, "FN", deadline))
            if not flags & DETECTED:
                told.append((nik, "late" if flags else "FP" if deadline is None else "TP", first))
            # the time of an ID that nobody sent moves on with each detection
            ids[nik] = [deadline, flags | DETECTED, last + self.forget_ms if deadline is None else None]
        self._keep(ids, timer)
        yield from _rows(told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ids, timer = self._ids()
        fired, passed = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        told = []
        for nik, (deadline, flags, due) in list(ids.items()):
            if due is None or (due > fired and due >= passed):
                continue
            if deadline is None:
                del ids[nik]
            else:
                ids[nik] = [deadline, flags | MISSED, None]
                told.append((nik, "FN", deadline))
        self._keep(ids, timer, fired=True)
        yield from _rows(told)

    def close(self) -> None:
        pass


def validate_log_stream(detections: DataFrame, expected: DataFrame, id_col: str = "nik", time_col: str = "ts", late: str = "1 hour", forget: str = "1 day", buckets: int = BUCKETS) -> DataFrame:
    """A stream of verdicts (nik, verdict, ts, and the change of tp, fp, fn) on IDs from a stream of detections and the table of sent IDs.

    ``expected`` has the ID and ``deadline``, the time by which it must have been detected (of repeated
    IDs the latest). Each ID has one row TP or FP however often it is detected, or FN once the watermark passes its
    deadline, with the deadline as its time; a detection after that gives ``late``. Rows more than ``late`` behind
    the newest are dropped; rows without an ID only move the watermark.
    """
    spark = detections.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = detections.select(F.col(id_col).alias("nik"), F.col(time_col).alias("ts"), F.unix_millis(time_col).alias("ms")).withWatermark("ts", late)
    # names the time, so that it is not pushed below the watermark, which rows without an ID move too
    rows = rows.where("nik is not null or ts < timestamp'0001-01-01'")
    known = expected.select(F.col(id_col).alias("nik"), F.unix_millis("deadline").alias("deadline")).where("nik is not null").groupBy("nik").agg(F.max("deadline").alias("deadline"))
    wait = int(pd.Timedelta(forget).total_seconds() * 1000)
    bucket = F.pmod(F.xxhash64("nik"), F.lit(buckets)).alias("bucket")
    known = known.groupBy(bucket).agg(F.collect_list(F.struct("nik", "deadline")).alias("sent"))
    out = rows.select(bucket, "*").groupBy("bucket").transformWithStateInPandas(IdVerdicts(wait), _OUT, "append", "eventTime", known.groupBy("bucket"))
    return out.select("nik", "verdict", F.timestamp_millis("ms").alias("ts"), "tp", "fp", "fn")


def running_totals(verdicts: DataFrame, width: str = "1 minute") -> DataFrame:
    """Totals after each ``width`` with a verdict: ``window_end, tp, fp, fn, precision, recall``.

    Verdicts are summed per window first; only windows go through the running sum.
    """
    per = verdicts.groupBy(F.window("ts", width).alias("w")).agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")])
    order = Window.orderBy("w.end")
    total = per.select(F.col("w.end").alias("window_end"), *[F.sum(c).over(order).alias(c) for c in ("tp", "fp", "fn")])
    share = lambda part: F.round(F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col(part)), F.lit(0.0)), 6)
    return total.withColumns({"precision": share("fp"), "recall": share("fn")})


def run_to_deadline(detections: DataFrame, time_col: str, build) -> DataFrame:
    """All verdicts of a bounded stream: it is run to its end, then one row without an ID and of a far later
    time is added, so that the watermark passes every deadline."""
    spark = detections.sparkSession
    path = shared_folder(spark)
    spark.createDataFrame([], detections.schema).write.parquet(f"{path}/mark")
    marks = spark.readStream.schema(detections.schema).parquet(f"{path}/mark")
    out = build(detections.unionByName(marks))
    run_to_files(out, path)
    row = [F.lit(CLOSING_TIME if f.name == time_col else None).cast(f.dataType).alias(f.name) for f in detections.schema]
    spark.range(1).select(*row).write.mode("append").parquet(f"{path}/mark")
    run_to_files(out, path)
    return spark.read.schema(out.schema).parquet(f"{path}/out")
