"""Detection logs and load tests: blocks, expected against detected IDs, latency."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fixed import MASK_CONTEXT_WORDS, SEPARATOR
from ..functions.let import let
from ..functions.verdicts import f1, ratio
from .common import checked_join, explode_rows, small_rows
from .selection import percentiles

SIXTEEN = r"(?<![\p{L}\p{N}_])\p{Nd}{16}(?![\p{L}\p{N}_])"


def split_blocks(logs: DataFrame, text: str = "value") -> DataFrame:
    """Log texts to request blocks: cut at runs of 50 or more '=', keep intercepted requests."""
    kept = [c for c in logs.columns if c != text]
    return (
        explode_rows(logs, kept, F.split(text, SEPARATOR, -1), "block", "block_no")
        .withColumn("block", F.regexp_replace("block", r"^\s+|\s+$", ""))
        .where(F.col("block").contains("Intercepted:"))
    )


def parse_log_block(block) -> Column:
    """original_ids, detected_ids, masked, latency_ms of one block."""
    body = F.regexp_extract(block, r"Original body:\s*([^\n]+)", 1)
    block = F.col(block) if isinstance(block, str) else block
    return F.struct(
        F.array_distinct(F.regexp_extract_all(body, F.lit(SIXTEEN), F.lit(0))).alias("original_ids"),
        F.array_distinct(
            F.regexp_extract_all(block, F.lit(r"-\s*NIK:\s*(\p{Nd}{16})\s*->\s*\S+"), F.lit(1))
        ).alias("detected_ids"),
        (block.contains("XXXXXXXXXX") | (block.contains("Total") & block.contains("masked"))).alias("masked"),
        F.regexp_extract(block, r"Time:\s*([\p{Nd}.]+)\s*ms", 1).try_cast("double").alias("latency_ms"),
    )


def parse_blocks(blocks: DataFrame) -> DataFrame:
    kept = [c for c in blocks.columns if c != "block"]
    return blocks.select(*kept, parse_log_block("block").alias("p")).select(*kept, "p.*")


def _expected(expected: DataFrame) -> DataFrame:
    return expected.select(F.col(expected.columns[0]).alias("nik")).distinct()


def per_request_detection(parsed: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """One row per request and expected ID it carried: detected, masked, latency.

    One ID may be in a large share of all requests; the join copes with that.
    """
    carried = explode_rows(parsed, [*keys, "masked", "latency_ms", "detected_ids"], "original_ids", "nik")
    return checked_join(carried, _expected(expected), "nik", "inner").select(
        *keys, "nik", F.array_contains("detected_ids", F.col("nik")).alias("detected"), "masked", "latency_ms"
    )


def mark_relevant(parsed: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``relevant``: the block carries at least one expected ID.

    A list of a checked size is tested inside each row; a longer one is joined by ID, and the
    blocks found are joined back by their keys.
    """
    ids = small_rows(_expected(expected), 10_000)
    if ids is not None:
        wanted = [r["nik"] for r in ids]
        test = F.exists("original_ids", lambda x: x.isin(wanted)) if wanted else F.lit(False)
        return parsed.withColumn("relevant", test)
    carried = explode_rows(parsed, keys, "original_ids", "nik")
    found = checked_join(carried, _expected(expected), "nik", "inner").select(*keys).distinct()
    return parsed.join(found.withColumn("relevant", F.lit(True)), keys, "left").na.fill(False, ["relevant"])


def relevant_blocks(parsed: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks that carry at least one expected ID."""
    return mark_relevant(parsed, expected, keys).where("relevant").drop("relevant")


def expected_vs_detected(relevant: DataFrame, expected: DataFrame) -> DataFrame:
    """(nik, expected, detected): full outer join of two distinct ID sets."""
    detected = explode_rows(relevant, [], "detected_ids", "nik").distinct()
    return (
        _expected(expected)
        .withColumn("expected", F.lit(True))
        .join(detected.withColumn("detected", F.lit(True)), "nik", "full_outer")
        .na.fill(False, ["expected", "detected"])
    )


def undetected_ids(relevant: DataFrame, expected: DataFrame) -> DataFrame:
    detected = explode_rows(relevant, [], "detected_ids", "nik").distinct()
    return _expected(expected).join(detected, "nik", "left_anti").orderBy("nik")


def latency_summary(df: DataFrame, column: str = "latency_ms") -> DataFrame:
    """mean, min, max, n; NULLs do not count, and an empty input gives zeros."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return df.agg(
        F.round(zero(F.avg(column)), 2).alias("mean_ms"),
        F.round(zero(F.min(column)), 2).alias("min_ms"),
        F.round(zero(F.max(column)), 2).alias("max_ms"),
        F.count(column).alias("n"),
    )


def latency_percentiles(df: DataFrame, column: str, by: list[str] = ()) -> DataFrame:
    """Percentiles of a latency column, exact with linear interpolation, for groups of any size."""
    points = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    out = percentiles(df, column, points, by)
    return out.withColumns({c: F.round(c, 4) for c in ("mean", *points)})


def load_test_summary(samples: DataFrame) -> DataFrame:
    """Requests, successes, wall time and rate of a load test."""
    begin, end = F.min("timeStamp"), F.max(F.col("timeStamp") + F.col("elapsed"))
    return samples.agg(
        F.count("*").alias("requests"),
        F.count_if(F.col("responseCode") == 200).alias("ok"),
        (end - begin).alias("wall_ms"),
        F.round(F.try_divide(1000.0 * F.count("*"), end - begin), 4).alias("requests_per_s"),
        F.max("allThreads").alias("max_threads"),
    )


def log_detection_metrics(parsed: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks, counts, precision, recall, F1, detection rate and latency in one row."""
    marked = mark_relevant(parsed, expected, keys)
    c = F.col
    counts = expected_vs_detected(marked.where("relevant"), expected).agg(
        F.count_if(c("expected")).alias("total_ids"),
        F.count_if(c("expected") & c("detected")).alias("tp"),
        F.count_if(c("expected") & ~c("detected")).alias("fn"),
        F.count_if(~c("expected") & c("detected")).alias("fp"),
    )
    latency = F.when(c("relevant"), c("latency_ms"))
    zero = lambda x: F.round(F.coalesce(x, F.lit(0.0)), 2)
    blocks = marked.agg(
        F.count("*").alias("blocks"),
        F.count_if("relevant").alias("blocks_with_id"),
        zero(F.avg(latency)).alias("mean_ms"),
        zero(F.min(latency)).alias("min_ms"),
        zero(F.max(latency)).alias("max_ms"),
        F.count(latency).alias("n_latency"),
    )
    # Two one-row results side by side, by a union that is folded into one row.
    rows = blocks.unionByName(counts, allowMissingColumns=True)
    row = rows.agg(*[F.max(n).alias(n) for n in rows.columns])
    precision, recall = ratio("tp", c("tp") + c("fp")), ratio("tp", "total_ids")
    return row.select(
        "blocks", "blocks_with_id", "total_ids", "tp", "fn", "fp",
        F.round(precision, 4).alias("precision"),
        F.round(recall, 4).alias("recall"),
        F.round(f1(precision, recall), 4).alias("f1"),
        F.round(recall * 100, 2).alias("detection_rate"),
        "mean_ms", "min_ms", "max_ms", "n_latency",
    )


def log_substring_hits(logs: DataFrame, expected: DataFrame, id_col: str, text: str = "value") -> DataFrame:
    """Older check: an expected ID counts if, at its first place in the log, a keyword stands
    within 100 characters.

    Every 16-digit window of every digit run is a candidate; candidates carry only their
    200-character context and meet the expected IDs by an equi-join.
    """
    df = logs.withColumn(
        "_pieces", F.split(text, r"(?<=\p{Nd})(?=\P{Nd})|(?<=\P{Nd})(?=\p{Nd})", -1)
    )
    pieces = F.col("_pieces")
    runs = explode_rows(df, [id_col, "_pieces"], "_pieces", "_run", "_i").where(
        (F.length("_run") >= 16) & F.rlike("_run", F.lit(r"^\p{Nd}"))
    )
    before = F.right(
        F.array_join(F.slice(pieces, F.greatest(F.col("_i") - 99, F.lit(1)), F.least(F.col("_i"), F.lit(100))), ""),
        F.lit(100),
    )
    after = F.left(F.array_join(F.slice(pieces, F.col("_i") + 2, F.lit(100)), ""), F.lit(100))

    def windows(left, run, whole):
        """ID and the 200 characters around its start, for every window of the run. Only these
        pieces are exploded, not the run."""

        def piece(k):
            at = F.length(left) + k
            begin = F.greatest(at - 100, F.lit(0))
            return F.struct(
                k.alias("k"), F.substring(run, k + 1, F.lit(16)).alias("nik"), F.lower(F.substring(whole, begin + 1, at - begin + 100)).alias("context")
            )

        return F.transform(F.sequence(F.lit(0), F.length(run) - 16), piece)

    near = runs.select(id_col, "_i", "_run", before.alias("_left"), F.concat(before, F.col("_run"), after).alias("_whole"))
    near = near.select(id_col, "_i", F.explode(let(windows, "_left", "_run", "_whole")).alias("_w"))
    found = near.select(F.col("_w.nik").alias("nik"), F.struct(id_col, "_i", F.col("_w.k").alias("_k")).alias("_at"), F.col("_w.context").alias("_context"))
    found = checked_join(found, _expected(expected), "nik", "inner")
    first = found.groupBy("nik").agg(F.min_by("_context", "_at").alias("context"))
    hit = F.rlike("context", F.lit("|".join(MASK_CONTEXT_WORDS)))
    return _expected(expected).join(first, "nik", "left").select(
        "nik", F.coalesce(hit, F.lit(False)).alias("hit")
    )


def log_substring_metrics(logs: DataFrame, expected: DataFrame, id_col: str, text: str = "value") -> DataFrame:
    hits = log_substring_hits(logs, expected, id_col, text)
    row = hits.agg(F.count("*").alias("total_ids"), F.count_if("hit").alias("tp"), F.count_if(~F.col("hit")).alias("fn"))
    precision = F.when(F.col("tp") > 0, 1.0).otherwise(0.0)
    recall = ratio("tp", "total_ids")
    return row.select(
        "total_ids", "tp", "fn",
        precision.alias("precision"),
        F.round(recall, 4).alias("recall"),
        F.round(f1(precision, recall), 4).alias("f1"),
        F.round(recall * 100, 2).alias("detection_rate"),
    )
