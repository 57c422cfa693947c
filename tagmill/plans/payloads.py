"""Render labelled payloads: a person table joined to a template table.

Everything is integer arithmetic on the row id, so the same rows give the same payloads on
any cluster and in any engine.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .catalog import KINDS, QUOTAS, REQUEST_BODIES, TEMPLATES
from ..functions.fixed import (
    FOREIGN_LOCATIONS,
    GOVERNMENT_JOBS,
    HOME_LOCATIONS,
    PERSON_NAMES,
    PRIVATE_JOBS,
    PROVINCES,
)
from ..functions.phone import to_international
from ..functions.text import url_quote

PERSON_FIELDS = ["nik", "nama", "telepon", "jabatan", "lokasi"]


def pick(values: list, index: Column) -> Column:
    """Element of a literal list by index modulo its length. The list is one literal, cut up
    by the optimizer once, rather than one literal per value."""
    items = F.split(F.lit("\x1f".join(str(v) for v in values)), "\x1f")
    return F.get(items, (index % len(values)).cast("int"))


def _digits(value: Column, width: int) -> Column:
    """At least ``width`` digits; longer numbers keep all of theirs."""
    text = value.cast("string")
    return F.concat(F.repeat(F.lit("0"), F.greatest(width - F.length(text), F.lit(0))), text)


def synth_nik(k: Column) -> Column:
    """A structurally valid national ID from a row number."""
    return F.concat(
        _digits(pick(list(PROVINCES), k), 2),
        _digits(k * 7 % 99 + 1, 2),
        _digits(k * 13 % 99 + 1, 2),
        _digits(k % 28 + 1 + 40 * (k % 2), 2),
        _digits(k % 12 + 1, 2),
        _digits((40 + k % 67) % 100, 2),
        _digits(k % 9999 + 1, 4),
    )


def damaged_nik(k: Column) -> Column:
    """IDs with some rows broken on purpose: month 13, province 20, 31 February, 15 or 17 digits."""
    nik = synth_nik(k)
    return (
        F.when(k % 17 == 3, F.concat(F.substring(nik, 1, 8), F.lit("13"), F.substring(nik, 11, 6)))
        .when(k % 19 == 5, F.concat(F.lit("20"), F.substring(nik, 3, 14)))
        .when(k % 23 == 7, F.concat(F.substring(nik, 1, 6), F.lit("3102"), F.substring(nik, 11, 6)))
        .when(k % 29 == 11, F.substring(nik, 1, 15))
        .when(k % 31 == 13, F.concat(nik, F.lit("7")))
        .otherwise(nik)
    )


def person_columns(k: Column, place: Column) -> list[Column]:
    """Person fields of a row number; ``place`` is used for every third row's location."""
    phone = F.concat(pick(["0812", "0813", "0857", "0877", "0896"], k), _digits(k, 8))
    return [
        synth_nik(k).alias("nik"),
        F.concat_ws(
            " ",
            F.split_part(pick(PERSON_NAMES, k), F.lit(" "), F.lit(1)),
            F.split_part(pick(PERSON_NAMES, k * 3 + 1), F.lit(" "), F.lit(2)),
        ).alias("nama"),
        F.when(k % 3 == 0, to_international(phone)).otherwise(phone).alias("telepon"),
        F.when(k % 10 < 7, pick(GOVERNMENT_JOBS, k)).otherwise(pick(PRIVATE_JOBS, k)).alias("jabatan"),
        F.when(k % 3 == 0, place)
        .when(k % 11 == 1, pick(FOREIGN_LOCATIONS, k))
        .otherwise(pick(HOME_LOCATIONS, k))
        .alias("lokasi"),
    ]


def template_table(spark: SparkSession, set_name: str) -> DataFrame:
    """(kind, template_no, format, category, template, fields): a few dozen rows."""
    rows = [
        (kind, i, fmt, cat, has_pii, text, [f for f in PERSON_FIELDS if "{" + f in text] if has_pii else [])
        for s, kind, fmt, cat, has_pii in KINDS
        if s == set_name
        for i, text in enumerate(TEMPLATES[kind])
    ]
    return spark.createDataFrame(
        rows,
        "kind string, template_no bigint, format string, category string, has_pii boolean, "
        "template string, fields array<string>",
    )


def _quota_kind(set_name: str, k: Column) -> Column:
    out, low = None, 0
    for kind, share in QUOTAS[set_name]:
        low += share
        test = k % 100 < low
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out


def _template_no(kind: Column, set_name: str, k: Column) -> Column:
    out = None
    for name, _ in QUOTAS[set_name]:
        n = len(TEMPLATES[name])
        value = F.floor(k / 100) % n
        out = F.when(kind == name, value) if out is None else out.when(kind == name, value)
    return out


def render_payloads(people: DataFrame, set_name: str = "main") -> DataFrame:
    """People (sample_id and the five fields) to payload rows of one set.

    Kinds follow the set's quotas by sample_id; the template table is the fixed catalog of
    at most a few dozen rows, so it is broadcast and no payload row moves.
    """
    spark = people.sparkSession
    k = F.col("sample_id")
    numbered = people.withColumns({"kind": _quota_kind(set_name, k)}).withColumn(
        "template_no", _template_no(F.col("kind"), set_name, k)
    )
    text = F.col("template")
    run = lambda width: _digits(k * 7919 + 10 ** (width - 1), width)
    fills = {f: F.col(f) for f in PERSON_FIELDS}
    fills |= {f + "_q": url_quote(F.col(f)) for f in ("nama", "jabatan", "lokasi")}
    fills |= {
        "nama2": pick(PERSON_NAMES, k * 7 + 5),
        "nik2": synth_nik(k * 3 + 17),
        "num15": run(15),
        "num16": run(16),
        "num17": run(17),
        "amount": F.concat(
            (k % 990 + 10).cast("string"), F.lit(","), _digits(k * 7 % 1000, 3), F.lit(","), _digits(k * 13 % 1000, 3)
        ),
        "rec": (k % 9000 + 1000).cast("string"),
        "ts": F.lit("2026-01-15 10:20"),
        "date": F.lit("2026-01-15"),
        "level": pick(["INFO", "DEBUG", "WARN"], k),
    }
    for name, value in fills.items():
        text = F.replace(text, F.lit("{" + name + "}"), value)
    kept = [
        F.when(F.array_contains("fields", f), F.col(f)).alias(f) for f in PERSON_FIELDS
    ]
    joined = numbered.join(F.broadcast(template_table(spark, set_name)), ["kind", "template_no"])
    return joined.select(
        "sample_id",
        text.alias("payload"),
        "format",
        F.when(F.col("has_pii"), F.struct(*kept)).alias("pii_data"),
        F.lit(set_name).alias("source"),
        "category",
    )


def render_requests(people: DataFrame) -> DataFrame:
    """Request bodies of the live check, four shapes in turn."""
    n = len(REQUEST_BODIES)
    k = F.col("sample_id") % n
    body = pick([b for _, _, b in REQUEST_BODIES], k)
    for f in ("nama", "nik", "telepon"):
        body = F.replace(body, F.lit("{" + f + "}"), F.col(f))
    return people.select(
        (F.col("sample_id") + 1).cast("int").alias("id"),
        pick([f for f, _, _ in REQUEST_BODIES], k).alias("format"),
        F.col("nik").alias("nik_expected"),
        F.col("nama").alias("nama_expected"),
        F.col("telepon").alias("phone_expected"),
        pick([c for _, c, _ in REQUEST_BODIES], k).alias("content_type"),
        body.alias("body"),
    )
