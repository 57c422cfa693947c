"""Queries over rendered payloads: labelling, profiles, quality, splits, metrics, masking."""

from pyspark.sql import functions as F

from ..functions.fixed import ENTITY_TYPES, STRICT_LABELS
from ..functions.labels import entity_spans, entity_tokens, order_violations, spans_with_text
from ..functions.text import join_tokens, sample_code, tokenize
from ..operators import compare, masking, metrics, profile, quality, split
from ..operators.common import explode_rows, order_key
from ..operators.labeling import match_value_span
from .payloads import PERSON_FIELDS, render_requests
from . import base, sqlbase as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def _rendered(set_name):
    sql = S.with_(S.people(), S.samples(set_name)) + (
        "SELECT sample_id, payload, format, source, category, nik, nama, telepon, jabatan, lokasi FROM samples"
    )

    @query(f"render_{set_name}", sql)
    def run(spark, sf):
        return base.samples(spark, sf, set_name).select(
            "sample_id", "payload", "format", "source", "category", "pii_data.*"
        )

    labels = S.with_(*S.main_tagged(set_name)) + (
        "SELECT sample_id, array_to_string(tokens, ' ') AS tokens, array_to_string(labels, ' ') AS labels FROM tagged"
    )

    @query(f"bio_label_{set_name}", labels)
    def label(spark, sf):
        return base.tagged(spark, sf, set_name).select(
            "sample_id", F.array_join("tokens", " ").alias("tokens"), F.array_join("labels", " ").alias("labels")
        )


for _s in ("main", "adversarial", "holdout", "hard"):
    _rendered(_s)

query("render_requests", S.with_(S.people(), S.requests()) + "SELECT * FROM requests")(
    lambda spark, sf: render_requests(base.people(spark, sf))
)

TAGGED = S.main_tagged()


@query(
    "match_value_span",
    S.with_(S.people(), S.samples("holdout"), S.tagged())
    + " UNION ALL ".join(
        f"""SELECT sample_id, '{field}' AS field, CAST(s AS INTEGER) AS start, CAST(s + n - 1 AS INTEGER) AS "end" FROM (
  SELECT sample_id, {S._find('tokens', 'v')} AS s, len(v) AS n FROM (
    SELECT sample_id, tokens, regexp_extract_all({field}, '{S.TOKEN}') AS v FROM tagged)) WHERE s IS NOT NULL"""
        for field in PERSON_FIELDS
    ),
)
def match_span(spark, sf):
    df = base.samples(spark, sf, "holdout").withColumn("j", join_tokens(tokenize("payload")))
    found = [F.struct(F.lit(f).alias("field"), match_value_span(F.col("j"), F.col(f"pii_data.{f}")).alias("m")) for f in PERSON_FIELDS]
    return (
        explode_rows(df, ["sample_id"], F.array(*found))
        .where("x.m is not null")
        .select("sample_id", "x.field", "x.m.start", "x.m.end")
    )


@query(
    "entity_spans",
    S.with_(*TAGGED, S.spans("tagged", "sample_id", "labels", "sp"))
    + """SELECT sample_id, type, array_to_string(tokens[s + 1 : e + 1], ' ') AS text, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end"
FROM sp JOIN tagged USING (sample_id)""",
)
def spans(spark, sf):
    df = base.tagged(spark, sf).select("sample_id", "tokens", entity_spans("labels").alias("s"))
    return explode_rows(df, ["sample_id"], spans_with_text("tokens", "s")).select("sample_id", "x.*")


@query(
    "entity_tokens",
    S.with_(*TAGGED)
    + """SELECT label, lower(token) AS token, count(*) AS n FROM (SELECT unnest(tokens) AS token, unnest(labels) AS label FROM tagged)
WHERE label <> 'O' GROUP BY ALL""",
)
def entity_token_counts(spark, sf):
    return (
        explode_rows(base.tagged(spark, sf), [], entity_tokens("tokens", "labels"), "p")
        .groupBy("p.label", F.lower("p.token").alias("token"))
        .agg(F.count("*").alias("n"))
    )


@query(
    "label_distribution",
    S.with_(*TAGGED)
    + "SELECT label, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM (SELECT unnest(labels) AS label FROM tagged) GROUP BY label",
)
def label_distribution(spark, sf):
    return profile.label_distribution(base.tagged(spark, sf))


@query(
    "group_distribution",
    S.with_(S.people(), S.samples("adversarial"))
    + "SELECT format, category, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM samples GROUP BY format, category",
)
def group_distribution(spark, sf):
    return profile.group_distribution(base.samples(spark, sf, "adversarial"), "format", "category")


_COVER = " UNION ALL ".join(
    f"SELECT format, count(*) AS total, '{t}' AS entity, count(*) FILTER (list_contains(labels, 'B-{t}')) AS n FROM tagged GROUP BY format"
    for t in ENTITY_TYPES
)


@query("entity_coverage", S.with_(*TAGGED) + f"SELECT *, round(n / CAST(total AS DOUBLE), 6) AS rate FROM ({_COVER})")
def entity_coverage(spark, sf):
    return profile.entity_coverage(base.tagged(spark, sf), "format")


@query(
    "example_per_group",
    S.with_(S.people(), S.samples("hard"))
    + "SELECT category, min(sample_id) AS sample_id, left(arg_min(payload, sample_id), 130) AS example FROM samples GROUP BY category",
)
def example_per_group(spark, sf):
    return profile.example_per_group(base.samples(spark, sf, "hard"), "category")


# --- quality ---------------------------------------------------------------------------------

_EXPECTED = {"json": 630, "formdata": 615, "narrative": 255}


def _checks(items) -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS \"check\", CAST({v} AS DOUBLE) AS value, coalesce({ok.replace('$', '(' + v + ')')}, FALSE) AS ok FROM src" for n, v, ok in items
    )


@query(
    "quality_report_raw",
    S.with_(S.people(), S.samples())
    + _checks(
        [("total", "(SELECT count(*) FROM samples)", "$ = 1500")]
        + [(f"format_{f}", f"(SELECT count(*) FROM samples WHERE format = '{f}')", f"$ = {n}") for f, n in _EXPECTED.items()]
        + [
            ("null_payloads", "(SELECT count(*) FROM samples WHERE payload IS NULL)", "$ = 0"),
            ("empty_records", "(SELECT count(*) FROM samples WHERE has_pii AND coalesce(nik, nama, telepon, jabatan, lokasi) IS NULL)", "$ = 0"),
            ("negatives", "(SELECT count(*) FROM samples WHERE NOT has_pii)", "$ >= 0"),
            ("bad_json", "(SELECT count(*) FROM samples WHERE format = 'json' AND NOT json_valid(payload))", "$ = 0"),
        ]
    ).replace(" FROM src", ""),
)
def quality_raw(spark, sf):
    return quality.raw_report(base.samples(spark, sf), 1500, _EXPECTED)


_ALLOWED = "[" + ", ".join(f"'{x}'" for x in STRICT_LABELS) + "]"
_VIOLATIONS = """viol AS (SELECT count(*) AS v FROM (SELECT label, lag(label) OVER (PARTITION BY sample_id ORDER BY pos) AS prev FROM (
  SELECT sample_id, unnest(labels) AS label, generate_subscripts(labels, 1) AS pos FROM tagged))
  WHERE label LIKE 'I-%' AND (prev IS NULL OR prev NOT IN (label, 'B-' || label[3:])))"""


def _damaged(df):
    """Labels with some I- tokens left without their beginning and some unknown ones."""
    k = F.col("sample_id")
    return df.withColumn(
        "labels",
        F.transform(
            "labels",
            lambda l: F.when((k % 10 == 3) & (l == "B-NAMA"), "O").when((k % 12 == 5) & (l == "B-NIK"), "I-NIK").otherwise(l),
        ),
    )


_DAMAGED = """damaged AS (SELECT * REPLACE (list_transform(labels, lambda l: CASE WHEN sample_id % 10 = 3 AND l = 'B-NAMA' THEN 'O'
  WHEN sample_id % 12 = 5 AND l = 'B-NIK' THEN 'I-NIK' ELSE l END) AS labels) FROM tagged)"""


def _tagged_checks(src):
    rate = lambda t: f"(SELECT round(count(*) FILTER (list_contains(labels, 'B-{t}')) / CAST(count(*) AS DOUBLE), 6) FROM {src} WHERE has_pii)"
    return _checks(
        [
            ("misaligned", f"(SELECT count(*) FROM {src} WHERE len(tokens) <> len(labels))", "$ = 0"),
            ("unexpected_labels", f"(SELECT sum(len(list_filter(list_distinct(labels), lambda l: NOT list_contains({_ALLOWED}, l)))) FROM {src})", "$ = 0"),
            ("order_violations", "(SELECT v FROM viol)", "$ = 0"),
            ("labelled_negatives", f"(SELECT count(*) FROM {src} WHERE NOT has_pii AND list_distinct(labels) <> ['O'])", "$ = 0"),
        ]
        + [(f"coverage_{t}", rate(t), "$ >= 0.95") for t in ENTITY_TYPES]
    ).replace(" FROM src", "")


@query("quality_report_tagged", S.with_(*TAGGED, _DAMAGED, _VIOLATIONS.replace("FROM tagged", "FROM damaged")) + _tagged_checks("damaged"))
def quality_tagged(spark, sf):
    return quality.tagged_report(_damaged(base.tagged(spark, sf)))


@query(
    "bio_order_violations",
    S.with_(*TAGGED, _DAMAGED)
    + """SELECT sample_id, count(*) AS n FROM (SELECT sample_id, label, lag(label) OVER (PARTITION BY sample_id ORDER BY pos) AS prev FROM (
  SELECT sample_id, unnest(labels) AS label, generate_subscripts(labels, 1) AS pos FROM damaged))
  WHERE label LIKE 'I-%' AND (prev IS NULL OR prev NOT IN (label, 'B-' || label[3:])) GROUP BY sample_id""",
)
def bio_order_violations(spark, sf):
    df = _damaged(base.tagged(spark, sf)).select("sample_id", order_violations("labels").cast("long").alias("n"))
    return df.where("n > 0")


@query(
    "unexpected_labels",
    S.with_(*TAGGED, _DAMAGED)
    + f"SELECT label, count(DISTINCT sample_id) AS samples FROM (SELECT sample_id, unnest(labels) AS label FROM damaged) WHERE NOT list_contains({_ALLOWED}, label) GROUP BY label",
)
def unexpected(spark, sf):
    return quality.unexpected_labels(_damaged(base.tagged(spark, sf)))


@query(
    "quality_report_holdout",
    S.with_(*S.main_tagged("holdout"))
    + _checks(
        [
            ("total", "(SELECT count(*) FROM tagged)", "$ = 1000"),
            ("misaligned", "(SELECT count(*) FROM tagged WHERE len(tokens) <> len(labels))", "$ = 0"),
            ("formats", "(SELECT count(DISTINCT format) FROM tagged)", "$ = 7"),
        ]
        + [
            (f"coverage_{t}", f"(SELECT round(count(*) FILTER (list_contains(labels, 'B-{t}')) / CAST(count(*) AS DOUBLE), 6) FROM tagged)", "$ >= 0.8")
            for t in ENTITY_TYPES
        ]
    ).replace(" FROM src", ""),
)
def quality_holdout(spark, sf):
    return quality.holdout_report(base.tagged(spark, sf, "holdout"))


# --- splits ----------------------------------------------------------------------------------

_RANKED = """ranked AS (SELECT *, row_number() OVER (PARTITION BY format ORDER BY md5('42:' || sample_id)) AS rk,
  count(*) OVER (PARTITION BY format) AS n FROM samples),
splits AS (SELECT *, CASE WHEN rk <= floor(n * 0.8 + 0.5) THEN 'train' WHEN rk <= floor(n * 0.9 + 0.5) THEN 'val' ELSE 'test' END AS split FROM ranked)"""


@query("stratified_split", S.with_(S.people(), S.samples(), _RANKED) + "SELECT sample_id, format, split FROM splits")
def stratified_split(spark, sf):
    return split.stratified_split(base.samples(spark, sf)).select("sample_id", "format", "split")


@query(
    "split_format_crosstab",
    S.with_(S.people(), S.samples(), _RANKED)
    + """SELECT format, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val,
  count(*) FILTER (split = 'test') AS test, count(*) AS total FROM splits GROUP BY format""",
)
def split_crosstab(spark, sf):
    return split.split_crosstab(split.stratified_split(base.samples(spark, sf)))


_SIZES = {"train": 1200, "val": 150, "test": 150}


@query(
    "quality_report_splits",
    S.with_(S.people(), S.samples(), _RANKED)
    + _checks([(s, f"(SELECT count(*) FROM splits WHERE split = '{s}')", f"abs($ - {n}) <= 2") for s, n in _SIZES.items()]).replace(" FROM src", ""),
)
def quality_splits(spark, sf):
    return quality.split_report(split.stratified_split(base.samples(spark, sf)), _SIZES, 2)


@query(
    "stratified_sample",
    S.with_(S.people(), S.samples("holdout"), _RANKED) + "SELECT sample_id, format FROM ranked WHERE rk <= floor(n * 0.2 + 0.5)",
)
def stratified_sample(spark, sf):
    return split.stratified_sample(base.samples(spark, sf, "holdout"), 0.2).select("sample_id", "format")


@query("shuffle_seeded", "SELECT doc_id, md5('42:' || doc_id) AS shuffle_key FROM documents")
def shuffle_seeded(spark, sf):
    df = base.texts(spark, sf, "documents").select("doc_id")
    return split.shuffle_seeded(df, "doc_id").withColumn("shuffle_key", order_key("doc_id"))


@query(
    "union_sources",
    S.with_(S.people(), S.samples(), S.samples("adversarial", "adv"))
    + """SELECT source, format, category, count(*) AS n FROM (SELECT 'main' AS source, format, NULL AS category FROM samples
  UNION ALL SELECT 'adversarial', format, category FROM adv) GROUP BY ALL""",
)
def union_sources(spark, sf):
    both = split.union_sources(
        {"main": base.samples(spark, sf).drop("category"), "adversarial": base.samples(spark, sf, "adversarial")}
    )
    return both.groupBy("source", "format", "category").agg(F.count("*").alias("n"))


# --- metrics ---------------------------------------------------------------------------------


def _scored(set_name="main", group="", keys="sample_id", pred=S.REGEX_PRED):
    cols = f"{keys}, {group}" if group else keys
    return [
        *S.main_tagged(set_name),
        f"pr AS (SELECT *, {pred} AS pred FROM tagged)",
        S.spans("pr", cols, "labels", "tspan"),
        S.spans("pr", cols, "pred", "pspan"),
        S.counts("tspan", "pspan", cols, group),
    ]


@query("regex_entity_metrics", S.with_(*_scored(), S.metrics()) + "SELECT * FROM metrics")
def regex_entity_metrics(spark, sf):
    return metrics.entity_metrics(base.predicted(spark, sf))


@query("metrics_by_format", S.with_(*_scored("holdout", "format"), S.metrics("format")) + "SELECT * FROM metrics")
def metrics_by_format(spark, sf):
    return metrics.entity_metrics(base.predicted(spark, sf, "holdout"), ["format"])


@query(
    "misclassified_examples",
    S.with_(*_scored("hard"))
    + """, d AS (SELECT sample_id, string_agg(CASE WHEN p IS NULL THEN type || '|' || s || '|' || e END, ',' ORDER BY s) AS missed,
  string_agg(CASE WHEN t IS NULL THEN type || '|' || s || '|' || e END, ',' ORDER BY s) AS wrong
FROM (SELECT *, 1 AS t FROM tspan) FULL JOIN (SELECT *, 1 AS p FROM pspan) USING (sample_id, type, s, e) GROUP BY sample_id
HAVING bool_or(p IS NULL) OR bool_or(t IS NULL))
SELECT sample_id, array_to_string(tokens, ' ') AS text, coalesce(missed, '') AS missed, coalesce(wrong, '') AS wrong
FROM d JOIN tagged USING (sample_id) WHERE len(tokens) <= 25 ORDER BY sample_id LIMIT 3""",
)
def misclassified(spark, sf):
    return metrics.misclassified_examples(base.predicted(spark, sf, "hard"))


# --- masking ---------------------------------------------------------------------------------

_MASK = """CASE split_part(l, '-', 2) WHEN 'NIK' THEN left(t, 6) || repeat('X', greatest(length(t) - 6, 0))
  WHEN 'PHONE' THEN left(t, 4) || repeat('X', length(t) - 6) || right(t, 2)
  WHEN 'NAMA' THEN left(t, 1) || repeat('*', length(t) - 1)
  WHEN 'JABATAN' THEN repeat('*', length(t)) WHEN 'LOKASI' THEN repeat('*', length(t)) ELSE t END"""


@query(
    "mask_payloads",
    S.with_(*TAGGED)
    + f""", txt AS (SELECT *, CASE WHEN format = 'formdata' THEN url_decode(payload) ELSE payload END AS body FROM tagged),
g AS (SELECT *, regexp_split_to_array(body, '{S.TOKEN}') AS gaps FROM txt),
u AS (SELECT sample_id, unnest(tokens) AS t, unnest(labels) AS l, generate_subscripts(tokens, 1) AS pos FROM g),
v AS (SELECT sample_id, list({_MASK} ORDER BY pos) AS masked FROM u GROUP BY sample_id)
SELECT sample_id, array_to_string(list_transform(range(1, len(gaps) + 1), lambda i: gaps[i] || coalesce(masked[i], '')), '') AS masked
FROM g LEFT JOIN v USING (sample_id)""",
)
def mask_payloads(spark, sf):
    return masking.mask_entities(base.tagged(spark, sf)).select("sample_id", "masked")


@query("sample_code", "SELECT doc_id, printf('sample_%03d', doc_id) AS code FROM documents")
def sample_codes(spark, sf):
    return base.texts(spark, sf, "documents").select("doc_id", sample_code(F.col("doc_id")).alias("code"))
