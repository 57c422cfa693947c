"""Data-quality gates: each report is one aggregate pass that yields (check, value, ok) rows."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fixed import ENTITY_TYPES, STRICT_LABELS
from ..functions.labels import all_outside, order_violations
from ..functions.text import is_json
from .common import explode_rows


def _report(row: DataFrame, checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    items = [
        F.struct(
            F.lit(name).alias("check"),
            value.cast("double").alias("value"),
            F.coalesce(ok, F.lit(False)).alias("ok"),
        )
        for name, (value, ok) in checks.items()
    ]
    return row.select(F.explode(F.array(*items)).alias("c")).select("c.*")


def raw_report(samples: DataFrame, expected_total: int, expected_formats: dict[str, int]) -> DataFrame:
    """Totals, format counts, NULL payloads, completeness of records, JSON validity."""
    c = F.col
    row = samples.agg(
        F.count("*").alias("total"),
        F.count_if(c("payload").isNull()).alias("null_payloads"),
        F.count_if(
            c("pii_data").isNotNull()
            & F.coalesce("pii_data.nik", "pii_data.nama", "pii_data.telepon", "pii_data.jabatan", "pii_data.lokasi").isNull()
        ).alias("empty_records"),
        F.count_if(c("pii_data").isNull()).alias("negatives"),
        F.count_if((c("format") == "json") & ~F.coalesce(is_json("payload"), F.lit(False))).alias("bad_json"),
        *[F.count_if(c("format") == f).alias(f"n_{f}") for f in expected_formats],
    )
    zero = lambda name: (c(name), c(name) == 0)
    checks = {"total": (c("total"), c("total") == expected_total)}
    checks |= {f"format_{f}": (c(f"n_{f}"), c(f"n_{f}") == n) for f, n in expected_formats.items()}
    checks |= {
        "null_payloads": zero("null_payloads"),
        "empty_records": zero("empty_records"),
        "negatives": (c("negatives"), c("negatives") >= 0),
        "bad_json": zero("bad_json"),
    }
    return _report(row, checks)


def tagged_report(tagged: DataFrame, allowed=STRICT_LABELS, min_coverage: float = 0.95) -> DataFrame:
    """Alignment, label set, BIO order, negatives all outside, entity coverage."""
    c = F.col
    negative = c("pii_data").isNull()
    row = tagged.agg(
        F.count_if(F.size("tokens") != F.size("labels")).alias("misaligned"),
        F.sum(
            F.size(F.array_except("labels", F.array(*[F.lit(x) for x in allowed])))
        ).alias("unexpected_labels"),
        F.sum(order_violations("labels")).alias("order_violations"),
        F.count_if(negative & ~all_outside("labels")).alias("labelled_negatives"),
        F.count_if(~negative).alias("positives"),
        *[
            F.count_if(~negative & F.array_contains("labels", f"B-{t}")).alias(f"has_{t}")
            for t in ENTITY_TYPES
        ],
    )
    zero = lambda name: (c(name), c(name) == 0)
    checks = {n: zero(n) for n in ("misaligned", "unexpected_labels", "order_violations", "labelled_negatives")}
    for t in ENTITY_TYPES:
        rate = F.round(F.coalesce(F.try_divide(c(f"has_{t}"), c("positives")), F.lit(0.0)), 6)
        checks[f"coverage_{t}"] = (rate, rate >= min_coverage)
    return _report(row, checks)


def split_report(splits: DataFrame, expected: dict[str, int], tolerance: int = 0) -> DataFrame:
    """Split sizes against the expected ones."""
    c = F.col
    row = splits.agg(*[F.count_if(c("split") == s).alias(s) for s in expected])
    return _report(row, {s: (c(s), F.abs(c(s) - n) <= tolerance) for s, n in expected.items()})


def holdout_report(
    tagged: DataFrame, expected_total: int = 1000, formats: int = 7, min_coverage: float = 0.80
) -> DataFrame:
    c = F.col
    row = tagged.agg(
        F.count("*").alias("total"),
        F.count_if(F.size("tokens") != F.size("labels")).alias("misaligned"),
        F.count_distinct("format").alias("formats"),
        *[F.count_if(F.array_contains("labels", f"B-{t}")).alias(f"has_{t}") for t in ENTITY_TYPES],
    )
    checks = {
        "total": (c("total"), c("total") == expected_total),
        "misaligned": (c("misaligned"), c("misaligned") == 0),
        "formats": (c("formats"), c("formats") == formats),
    }
    for t in ENTITY_TYPES:
        rate = F.round(F.coalesce(F.try_divide(c(f"has_{t}"), c("total")), F.lit(0.0)), 6)
        checks[f"coverage_{t}"] = (rate, rate >= min_coverage)
    return _report(row, checks)


def unexpected_labels(tagged: DataFrame, allowed=STRICT_LABELS) -> DataFrame:
    """Labels seen but not allowed."""
    extra = F.array_except("labels", F.array(*[F.lit(x) for x in allowed]))
    return explode_rows(tagged, [], extra, "label").groupBy("label").agg(F.count("*").alias("samples"))
