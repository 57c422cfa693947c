"""Queries for annotator agreement, annotation sheets, detection logs, latency and streams."""

from pyspark.sql import functions as F

from ..functions.fixed import ENTITY_FIELDS, ENTITY_TYPES, MASK_CONTEXT_WORDS
from ..operators import agreement, annotation, logs
from ..operators.common import explode_rows, materialize
from .payloads import render_payloads, person_columns
from ..streaming import detect, validation
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


PAIRS = [*S.main_tagged("holdout"), S.annotators()]
SPANS = [S.spans("pairs", "task_id", "labels_a", "sa"), S.spans("pairs", "task_id", "labels_b", "sb")]
STRICT = [*PAIRS, *SPANS, S.counts("sa", "sb", "task_id", "", "c1"), S.metrics("", 4, "c1", "strict")]
_RELAXED = """ov AS (SELECT sa.task_id, sa.type, sa.s, sa.e, sb.s AS bs, sb.e AS be,
  row_number() OVER (PARTITION BY sa.task_id, sa.type, sa.s, sa.e ORDER BY sb.s) AS rn
  FROM sa JOIN sb ON sa.task_id = sb.task_id AND sa.type = sb.type AND sa.s <= sb.e AND sb.s <= sa.e),
fm AS (SELECT * FROM ov WHERE rn = 1),
rc AS (SELECT type AS entity, 1 AS tp, 0 AS fp, 0 AS fn FROM fm
  UNION ALL SELECT type, 0, 0, 1 FROM sa ANTI JOIN fm USING (task_id, type, s, e)
  UNION ALL SELECT sb.type, 0, 1, 0 FROM sb WHERE NOT EXISTS (SELECT 1 FROM fm WHERE fm.task_id = sb.task_id AND fm.type = sb.type AND fm.bs = sb.s AND fm.be = sb.e)),
c2 AS (SELECT entity, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM rc GROUP BY entity)"""
RELAXED = [_RELAXED, S.metrics("", 4, "c2", "relaxed")]
_LK = lambda v: f"CASE WHEN {v} < 0 THEN 'Poor' WHEN {v} < 0.2 THEN 'Slight' WHEN {v} < 0.4 THEN 'Fair' WHEN {v} < 0.6 THEN 'Moderate' WHEN {v} < 0.8 THEN 'Substantial' ELSE 'Almost Perfect' END"
_CELLS = "ft AS (SELECT unnest(labels_a) AS a, unnest(labels_b) AS b FROM pairs), cl AS (SELECT a, b, CAST(count(*) AS DOUBLE) AS n FROM ft GROUP BY ALL)"
_KAPPA = """kc AS (SELECT * FROM cl WHERE a <> 'O' OR b <> 'O'), kn AS (SELECT sum(n) AS n, sum(n) FILTER (a = b) AS agree FROM kc),
ks AS (SELECT sum(x.m * y.m) AS e FROM (SELECT a AS l, sum(n) AS m FROM kc GROUP BY a) x JOIN (SELECT b AS l, sum(n) AS m FROM kc GROUP BY b) y USING (l)),
kv AS (SELECT (agree / n - e / (n * n)) / (1 - e / (n * n)) AS k, agree / n AS po, n FROM kn CROSS JOIN ks)"""
_BIN = f"""bn AS (SELECT entity, coalesce(sum(n) FILTER (suffix(a, '-' || entity) AND suffix(b, '-' || entity)), 0) AS yy, coalesce(sum(n) FILTER (suffix(a, '-' || entity) AND NOT suffix(b, '-' || entity)), 0) AS yn,
  coalesce(sum(n) FILTER (NOT suffix(a, '-' || entity) AND suffix(b, '-' || entity)), 0) AS ny, coalesce(sum(n) FILTER (NOT suffix(a, '-' || entity) AND NOT suffix(b, '-' || entity)), 0) AS nn
  FROM cl CROSS JOIN (SELECT unnest({ENTITY_TYPES}) AS entity) GROUP BY entity),
bk AS (SELECT *, yy + yn + ny + nn AS n FROM bn),
bkk AS (SELECT entity, CASE WHEN yy + yn = 0 OR ny + nn = 0 OR yy + ny = 0 OR yn + nn = 0 THEN CASE WHEN yn + ny = 0 THEN 1.0 ELSE 0.0 END
  ELSE ((yy + nn) / n - ((yy + yn) * (yy + ny) + (ny + nn) * (yn + nn)) / (n * n)) / (1 - ((yy + yn) * (yy + ny) + (ny + nn) * (yn + nn)) / (n * n)) END AS k FROM bk),
ba AS (SELECT entity, yn, ny, yy, nn, (yy + nn) / n AS pa, (2 * yy + yn + ny) / (2 * n) AS p FROM bk),
bac AS (SELECT entity, CASE WHEN yn + ny = 0 AND (yy = 0 OR nn = 0) THEN 1.0 ELSE (pa - 2 * p * (1 - p)) / (1 - 2 * p * (1 - p)) END AS ac1 FROM ba)"""
_AC1 = """an AS (SELECT sum(n) AS n, sum(n) FILTER (a = b) / sum(n) AS pa FROM cl),
api AS (SELECT l, sum(m) / (2 * (SELECT n FROM an)) AS p FROM (SELECT a AS l, n AS m FROM cl UNION ALL SELECT b, n FROM cl) GROUP BY l),
ap AS (SELECT sum(p * (1 - p)) / (count(*) - 1) AS pe FROM api), av AS (SELECT (pa - pe) / (1 - pe) AS ac1, n FROM an CROSS JOIN ap)"""


@query("strict_iaa", S.with_(*STRICT) + "SELECT * FROM strict")
def strict_iaa(spark, sf):
    return agreement.span_f1(base.annotator_pairs(spark, sf), "strict")


@query("relaxed_iaa", S.with_(*PAIRS, *SPANS, *RELAXED) + "SELECT * FROM relaxed")
def relaxed_iaa(spark, sf):
    return agreement.span_f1(base.annotator_pairs(spark, sf), "relaxed")


@query(
    "cohen_kappa",
    S.with_(*PAIRS, _CELLS, _KAPPA)
    + f"SELECT round(k, 4) AS kappa, round(po, 4) AS agreement, CAST(n AS BIGINT) AS n_tokens, {_LK('k')} AS interpretation FROM kv",
)
def cohen_kappa(spark, sf):
    return agreement.cohen_kappa(agreement.confusion_cells(base.annotator_pairs(spark, sf)))


@query("cohen_kappa_by_entity", S.with_(*PAIRS, _CELLS, _BIN) + f"SELECT entity, round(k, 4) AS kappa, {_LK('k')} AS interpretation FROM bkk")
def cohen_kappa_by_entity(spark, sf):
    return agreement.cohen_kappa_by_entity(agreement.confusion_cells(base.annotator_pairs(spark, sf)))


@query("gwet_ac1", S.with_(*PAIRS, _CELLS, _AC1) + f"SELECT round(ac1, 4) AS ac1, CAST(n AS BIGINT) AS n_tokens, {_LK('ac1')} AS interpretation FROM av")
def gwet_ac1(spark, sf):
    return agreement.gwet_ac1(agreement.confusion_cells(base.annotator_pairs(spark, sf))).drop("ci_low", "ci_high")


_INTERVAL = """gt AS (SELECT format, unnest(labels_a) AS a, unnest(labels_b) AS b FROM pairs), gc AS (SELECT format, a, b, CAST(count(*) AS DOUBLE) AS n FROM gt GROUP BY ALL),
gn AS (SELECT format, sum(n) AS t, coalesce(sum(n) FILTER (a = b), 0) / sum(n) AS pa FROM gc GROUP BY format),
gp AS (SELECT format, l, sum(m) / (2 * any_value(t)) AS p FROM (SELECT format, a AS l, n AS m FROM gc UNION ALL SELECT format, b, n FROM gc) JOIN gn USING (format) GROUP BY format, l),
ge AS (SELECT format, sum(p * (1 - p)) / (count(*) - 1) AS pe, count(*) AS q FROM gp GROUP BY format),
ga AS (SELECT *, (pa - pe) / (1 - pe) AS ac FROM gn JOIN ge USING (format)),
gs AS (SELECT ga.format, any_value(ac) AS ac, any_value(t) AS t, sqrt(sum(n * pow((CASE WHEN gc.a = gc.b THEN 1.0 ELSE 0.0 END - pe) / (1 - pe)
  - 2 * (1 - ac) * ((2 - pa_.p - pb_.p) / 2 / (q - 1) - pe) / (1 - pe) - ac, 2)) / (any_value(t) * (any_value(t) - 1))) AS se
  FROM gc JOIN ga USING (format) JOIN gp pa_ ON pa_.format = gc.format AND pa_.l = gc.a JOIN gp pb_ ON pb_.format = gc.format AND pb_.l = gc.b GROUP BY ga.format),
gr AS (SELECT *, (1.959963984540054 + (pow(1.959963984540054, 3) + 1.959963984540054) / 4 / (t - 1)) * se AS reach FROM gs)"""


@query(
    "gwet_ac1_interval",
    S.with_(*PAIRS, _INTERVAL)
    + f"""SELECT format, round(ac, 4) AS ac1, round(ac - reach, 4) AS ci_low, round(least(ac + reach, 1.0), 4) AS ci_high, CAST(t AS BIGINT) AS n_tokens,
  {_LK('ac')} AS interpretation FROM gr""",
)
def gwet_ac1_interval(spark, sf):
    return agreement.gwet_ac1(agreement.confusion_cells(base.annotator_pairs(spark, sf), ["format"]), ["format"])


@query("gwet_ac1_by_entity", S.with_(*PAIRS, _CELLS, _BIN) + f"SELECT entity, round(ac1, 4) AS ac1, {_LK('ac1')} AS interpretation FROM bac")
def gwet_ac1_by_entity(spark, sf):
    return agreement.gwet_ac1_by_entity(agreement.confusion_cells(base.annotator_pairs(spark, sf)))


_OK = lambda v, t: f"CASE WHEN {v} >= {t} THEN 'TERCAPAI' ELSE 'TIDAK TERCAPAI' END"


@query(
    "iaa_report",
    S.with_(*STRICT, *RELAXED, _CELLS, _KAPPA, _BIN, _AC1)
    + f"""SELECT 'span_f1_strict' AS metric, entity, f1 AS value, CASE WHEN entity = '_macro' THEN {_OK('f1', 0.75)} END AS verdict FROM strict
UNION ALL SELECT 'span_f1_relaxed', entity, f1, NULL FROM relaxed
UNION ALL SELECT 'relaxed_minus_strict', '_macro', round(r.f1 - s.f1, 4), NULL FROM relaxed r JOIN strict s ON r.entity = '_macro' AND s.entity = '_macro'
UNION ALL SELECT 'cohen_kappa', '_all', round(k, 4), {_LK('k')} FROM kv
UNION ALL SELECT 'cohen_kappa', entity, round(k, 4), {_LK('k')} FROM bkk
UNION ALL SELECT 'gwet_ac1', '_all', round(ac1, 4), {_OK('ac1', 0.8)} FROM av
UNION ALL SELECT 'gwet_ac1', entity, round(ac1, 4), {_LK('ac1')} FROM bac""",
)
def iaa_report(spark, sf):
    return agreement.iaa_report(materialize(base.annotator_pairs(spark, sf)))


@query(
    "classify_disagreements",
    S.with_(*PAIRS, *SPANS)
    + """, oa AS (SELECT * FROM sa ANTI JOIN sb USING (task_id, type, s, e)), ob AS (SELECT * FROM sb ANTI JOIN sa USING (task_id, type, s, e)),
ja AS (SELECT oa.*, bool_or(sb.type = oa.type) AS same_type, bool_or(sb.s = oa.s AND sb.e = oa.e) AS same_bounds, count(sb.s) AS n
  FROM oa LEFT JOIN sb ON sb.task_id = oa.task_id AND sb.s <= oa.e AND oa.s <= sb.e GROUP BY ALL),
jb AS (SELECT ob.*, count(sa.s) AS n FROM ob LEFT JOIN sa ON sa.task_id = ob.task_id AND sa.s <= ob.e AND ob.s <= sa.e GROUP BY ALL)
SELECT task_id, 'A' AS side, type AS entity, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end",
  CASE WHEN n = 0 THEN 'missing' WHEN same_type THEN 'boundary' WHEN same_bounds THEN 'type' ELSE 'review' END AS kind FROM ja
UNION ALL SELECT task_id, 'B', type, CAST(s AS INTEGER), CAST(e AS INTEGER), 'missing' FROM jb WHERE n = 0""",
)
def classify_disagreements(spark, sf):
    return agreement.classify_disagreements(base.annotator_pairs(spark, sf))


# --- offsets, spans, tasks -------------------------------------------------------------------

_OFFSETS = lambda src, key, text: f"""tg AS (SELECT {key}, regexp_extract_all({text}, '{S.TOKEN}') AS t, regexp_split_to_array({text}, '{S.TOKEN}') AS g FROM {src}),
ou AS (SELECT {key}, unnest(t) AS w, unnest(g[1 : len(t)]) AS gap, generate_subscripts(t, 1) - 1 AS pos FROM tg),
oo AS (SELECT {key}, pos, w, sum(length(gap) + length(w)) OVER (PARTITION BY {key} ORDER BY pos) AS e FROM ou)"""


@query(
    "tokenize_with_offsets",
    S.with_(_OFFSETS("conversations", "conv_id, turn", "text"))
    + """SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, w AS token, CAST(e - length(w) AS INTEGER) AS start, CAST(e AS INTEGER) AS "end" FROM oo""",
)
def tokenize_with_offsets(spark, sf):
    df = agreement.tokenize_with_offsets(base.texts(spark, sf, "conversations"))
    pairs = F.zip_with("tokens", "offsets", lambda t, o: F.struct(t.alias("token"), o["start"].alias("start"), o["end"].alias("end")))
    return explode_rows(df, ["conv_id", "turn"], pairs, "x", "pos").select("conv_id", "turn", "pos", "x.*")


def _annotated(spark, sf):
    """Holdout payloads with character spans of their values; some spans begin inside a token."""
    df = base.samples(spark, sf, "holdout")
    cut = F.when(F.col("sample_id") % 4 == 1, 1).otherwise(0)

    def span(field, name):
        at = F.position(F.col(f"pii_data.{field}"), F.col("payload"))
        return F.when(
            at > 0,
            F.struct(
                (at - 1 + cut).cast("int").alias("start"),
                (at - 1 + F.length(f"pii_data.{field}")).cast("int").alias("end"),
                F.array(F.lit(name)).alias("labels"),
            ),
        )

    spans = F.array_compact(F.array(*[span(f, t) for f, t in ENTITY_FIELDS]))
    return df.select("sample_id", F.col("payload").alias("text"), "format", spans.alias("spans"))


_CHAR_SPANS = " UNION ALL ".join(
    f"SELECT sample_id, '{t}' AS type, instr(payload, {f}) - 1 + CASE WHEN sample_id % 4 = 1 THEN 1 ELSE 0 END AS cs, instr(payload, {f}) - 1 + length({f}) AS ce FROM samples WHERE instr(payload, {f}) > 0"
    for f, t in ENTITY_FIELDS
)


@query(
    "spans_to_bio",
    S.with_(S.people(), S.samples("holdout"), _OFFSETS("samples", "sample_id", "payload"), f"cs AS ({_CHAR_SPANS})")
    + """, hit AS (SELECT oo.sample_id, pos, type, cs, row_number() OVER (PARTITION BY oo.sample_id, type ORDER BY pos) AS nth
  FROM oo JOIN cs ON cs.sample_id = oo.sample_id AND oo.e > cs.cs AND oo.e - length(w) < cs.ce),
lastspan AS (SELECT sample_id, pos, arg_max(CASE WHEN nth = 1 THEN 'B-' ELSE 'I-' END || type, cs) AS label FROM hit GROUP BY ALL)
SELECT sample_id, string_agg(coalesce(label, 'O'), ' ' ORDER BY pos) AS labels FROM oo LEFT JOIN lastspan USING (sample_id, pos) GROUP BY sample_id""",
)
def spans_to_bio(spark, sf):
    return agreement.spans_to_bio(_annotated(spark, sf)).select("sample_id", F.array_join("labels", " ").alias("labels"))


def _annotation_rows(spark, sf):
    """Rows of several annotators per task, as an export gives them."""
    k = F.col("sample_id")
    who = [("a@example.org", "11", F.lit(True)), ("b@example.org", "12", k % 4 != 0), ("c@example.org", "13", k % 5 == 0), ("b@example.org", "12", k % 6 == 1)]
    entries = [
        F.when(test, F.struct(F.lit(i).alias("position"), F.lit(mail).alias("email"), F.lit(uid).alias("uid")))
        for i, (mail, uid, test) in enumerate(who)
    ]
    df = base.tagged(spark, sf, "holdout").select(k.alias("task_id"), "tokens", "labels", F.array_compact(F.array(*entries)).alias("who"))
    rows = explode_rows(df, ["task_id", "tokens", "labels"], "who", "w").select("task_id", "tokens", "labels", "w.*")
    second = F.when(F.col("position") == 3, F.transform("labels", lambda l: F.lit("O"))).otherwise(F.col("labels"))
    role = agreement.role_of_annotator("email", "uid", "a@example.org", "12")
    return rows.withColumn("labels", second).withColumn("role", role).where("role is not null")


_ANN = """ann AS (SELECT sample_id AS task_id, 'A' AS role, 0 AS position, labels FROM tagged
  UNION ALL SELECT sample_id, 'B', 1, labels FROM tagged WHERE sample_id % 4 <> 0
  UNION ALL SELECT sample_id, 'B', 3, list_transform(labels, lambda l: 'O') FROM tagged WHERE sample_id % 6 = 1)"""


@query(
    "annotation_pair_counts",
    S.with_(*S.main_tagged("holdout"), _ANN)
    + """SELECT CAST(count(*) AS BIGINT) AS annotation_rows, count(DISTINCT task_id) FILTER (role = 'A') AS tasks_a, count(DISTINCT task_id) FILTER (role = 'B') AS tasks_b,
  (SELECT count(DISTINCT a.task_id) FROM ann a JOIN ann b USING (task_id) WHERE a.role = 'A' AND b.role = 'B') AS paired_tasks FROM ann""",
)
def annotation_pair_counts(spark, sf):
    return agreement.annotation_pair_counts(_annotation_rows(spark, sf))


@query(
    "pair_annotators",
    S.with_(*S.main_tagged("holdout"), _ANN)
    + """SELECT task_id, array_to_string(arg_min(labels, position) FILTER (role = 'A'), ' ') AS labels_a,
  array_to_string(arg_min(labels, position) FILTER (role = 'B'), ' ') AS labels_b FROM ann GROUP BY task_id HAVING count(*) FILTER (role = 'B') > 0""",
)
def pair_annotators(spark, sf):
    pairs = agreement.pair_annotators(_annotation_rows(spark, sf))
    return pairs.select("task_id", *[F.array_join(c, " ").alias(c) for c in ("labels_a", "labels_b")])


@query(
    "first_annotation",
    S.with_(*S.main_tagged("holdout"), _ANN)
    + "SELECT task_id, role, min(position) AS position, array_to_string(arg_min(labels, position), ' ') AS labels FROM ann GROUP BY ALL",
)
def first_annotation(spark, sf):
    first = agreement.first_annotation(_annotation_rows(spark, sf))
    return first.select("task_id", "role", "position", F.array_join("labels", " ").alias("labels"))


@query(
    "annotation_completeness",
    """WITH n AS (SELECT conv_id, count(*) FILTER (role = 'assistant') AS n FROM conversations GROUP BY conv_id)
SELECT count(*) AS tasks, count(*) FILTER (n = 0) AS zero, count(*) FILTER (n = 1) AS one, count(*) FILTER (n >= 2) AS two_or_more FROM n""",
)
def annotation_completeness(spark, sf):
    """Conversations stand in for tasks, their answers for annotations."""
    tasks = base.texts(spark, sf, "conversations").groupBy("conv_id").agg(
        F.count_if(F.col("role") == "assistant").alias("n")
    )
    return annotation.annotation_completeness(tasks, "n")


def _round1(spark, sf):
    df = base.samples(spark, sf, "holdout")
    values = [
        F.array_compact(F.array(F.col(f"pii_data.{f}"), F.when(F.col("sample_id") % 8 == 0, F.lit("lain")))).alias(t)
        for f, t in ENTITY_FIELDS
    ]
    return df.select("sample_id", F.lit("unknown").alias("format"), F.when(F.col("sample_id") % 3 == 0, "cek").alias("note"), *values)


_R1 = ", ".join(f"{f} || CASE WHEN sample_id % 8 = 0 THEN ' || lain' ELSE '' END AS {t}" for f, t in ENTITY_FIELDS)


@query(
    "annotation_sheet",
    S.with_(S.people(), S.samples("holdout"))
    + f"""SELECT printf('sample_%03d', sample_id) AS ID, CASE WHEN sample_id % 10 = 9 THEN 'unknown' ELSE format END AS Format,
  CASE WHEN sample_id % 10 = 9 THEN '' ELSE payload END AS Raw_Text, {_R1}, CASE WHEN sample_id % 3 = 0 THEN 'cek' ELSE '' END AS Catatan FROM samples""",
)
def annotation_sheet(spark, sf):
    known = base.tagged(spark, sf, "holdout").where("sample_id % 10 <> 9")
    return annotation.annotation_sheet(annotation.attach_text(_round1(spark, sf), known))


@query(
    "annotation_entity_totals",
    S.with_(S.people(), S.samples("holdout"))
    + f"SELECT entity, CAST((SELECT count(*) + count(*) FILTER (sample_id % 8 = 0) FROM samples) AS BIGINT) AS n FROM (SELECT unnest({ENTITY_TYPES}) AS entity)",
)
def annotation_entity_totals(spark, sf):
    return annotation.annotation_entity_totals(_round1(spark, sf))


# --- logs ------------------------------------------------------------------------------------

LOGS = [S.people(), S.logs()]
_REL = """rel AS (SELECT * FROM parsed SEMI JOIN (SELECT DISTINCT log_id, block_no FROM (SELECT log_id, block_no, unnest(original_ids) AS nik FROM parsed) SEMI JOIN expected USING (nik)) USING (log_id, block_no)),
det AS (SELECT DISTINCT unnest(detected_ids) AS nik FROM rel)"""


def _parsed(spark, sf):
    return logs.parse_blocks(logs.split_blocks(base.logs(spark, sf)))


KEYS = ["log_id", "block_no"]


@query(
    "parse_log_blocks",
    S.with_(*LOGS)
    + "SELECT log_id, CAST(block_no AS INTEGER) AS block_no, array_to_string(list_sort(original_ids), ',') AS original_ids, array_to_string(list_sort(detected_ids), ',') AS detected_ids, masked, latency_ms FROM parsed",
)
def parse_log_blocks(spark, sf):
    ids = lambda c: F.array_join(F.array_sort(c), ",").alias(c)
    return _parsed(spark, sf).select(*KEYS, ids("original_ids"), ids("detected_ids"), "masked", "latency_ms")


@query(
    "log_detection_metrics",
    S.with_(*LOGS, _REL)
    + """, c AS (SELECT (SELECT count(*) FROM expected) AS total_ids, (SELECT count(*) FROM expected SEMI JOIN det USING (nik)) AS tp,
  (SELECT count(*) FROM expected ANTI JOIN det USING (nik)) AS fn, (SELECT count(*) FROM det ANTI JOIN expected USING (nik)) AS fp),
p AS (SELECT *, tp / CAST(tp + fp AS DOUBLE) AS pr, tp / CAST(total_ids AS DOUBLE) AS rc FROM c)
SELECT (SELECT count(*) FROM parsed) AS blocks, (SELECT count(*) FROM rel) AS blocks_with_id, total_ids, tp, fn, fp, round(pr, 4) AS precision, round(rc, 4) AS recall,
  round(2 * pr * rc / (pr + rc), 4) AS f1, round(rc * 100, 2) AS detection_rate, (SELECT round(avg(latency_ms), 2) FROM rel) AS mean_ms,
  (SELECT min(latency_ms) FROM rel) AS min_ms, (SELECT max(latency_ms) FROM rel) AS max_ms, (SELECT count(latency_ms) FROM rel) AS n_latency FROM p""",
)
def log_detection_metrics(spark, sf):
    return logs.log_detection_metrics(_parsed(spark, sf), base.expected_ids(spark, sf), KEYS)


@query(
    "per_request_detection",
    S.with_(*LOGS)
    + """SELECT log_id, CAST(block_no AS INTEGER) AS block_no, nik, list_contains(detected_ids, nik) AS detected, masked, latency_ms
FROM (SELECT *, unnest(original_ids) AS nik FROM parsed) SEMI JOIN expected USING (nik)""",
)
def per_request_detection(spark, sf):
    return logs.per_request_detection(_parsed(spark, sf), base.expected_ids(spark, sf), KEYS)


@query("undetected_ids", S.with_(*LOGS, _REL) + "SELECT nik FROM expected ANTI JOIN det USING (nik)")
def undetected_ids(spark, sf):
    expected = base.expected_ids(spark, sf)
    return logs.undetected_ids(logs.relevant_blocks(_parsed(spark, sf), expected, KEYS), expected)


@query(
    "expected_vs_detected",
    S.with_(*LOGS, _REL)
    + "SELECT nik, coalesce(a, FALSE) AS expected, coalesce(b, FALSE) AS detected FROM (SELECT nik, TRUE AS a FROM expected) FULL JOIN (SELECT nik, TRUE AS b FROM det) USING (nik)",
)
def expected_vs_detected(spark, sf):
    expected = base.expected_ids(spark, sf)
    return logs.expected_vs_detected(logs.relevant_blocks(_parsed(spark, sf), expected, KEYS), expected)


@query(
    "log_substring_hits",
    S.with_(*LOGS)
    + f"""SELECT nik, coalesce(bool_or(regexp_matches(ctx, '{'|'.join(MASK_CONTEXT_WORDS)}')), FALSE) AS hit FROM (
  SELECT e.nik, lower(substr(value, greatest(1, instr(value, e.nik) - 100), instr(value, e.nik) + 100 - greatest(1, instr(value, e.nik) - 100))) AS ctx,
    row_number() OVER (PARTITION BY e.nik ORDER BY log_id) AS rn FROM expected e LEFT JOIN logs ON contains(value, e.nik)) WHERE rn = 1 GROUP BY nik""",
)
def log_substring_hits(spark, sf):
    return logs.log_substring_hits(base.logs(spark, sf), base.expected_ids(spark, sf), "log_id")


@query(
    "log_substring_metrics",
    S.with_(*LOGS)
    + f""", h AS (SELECT nik, coalesce(bool_or(regexp_matches(ctx, '{'|'.join(MASK_CONTEXT_WORDS)}')), FALSE) AS hit FROM (
  SELECT e.nik, lower(substr(value, greatest(1, instr(value, e.nik) - 100), instr(value, e.nik) + 100 - greatest(1, instr(value, e.nik) - 100))) AS ctx,
    row_number() OVER (PARTITION BY e.nik ORDER BY log_id) AS rn FROM expected e LEFT JOIN logs ON contains(value, e.nik)) WHERE rn = 1 GROUP BY nik),
c AS (SELECT count(*) AS total_ids, count(*) FILTER (hit) AS tp, count(*) FILTER (NOT hit) AS fn FROM h), r AS (SELECT *, tp / CAST(total_ids AS DOUBLE) AS rc FROM c)
SELECT total_ids, tp, fn, CAST(1 AS DOUBLE) AS precision, round(rc, 4) AS recall, round(2 * rc / (1 + rc), 4) AS f1, round(rc * 100, 2) AS detection_rate FROM r""",
)
def log_substring_metrics(spark, sf):
    return logs.log_substring_metrics(base.logs(spark, sf), base.expected_ids(spark, sf), "log_id")


@query(
    "latency_summary",
    S.with_(*LOGS)
    + "SELECT round(avg(latency_ms), 2) AS mean_ms, min(latency_ms) AS min_ms, max(latency_ms) AS max_ms, count(latency_ms) AS n FROM parsed",
)
def latency_summary(spark, sf):
    return logs.latency_summary(_parsed(spark, sf))


@query(
    "latency_percentiles",
    """SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.5), 4) AS p50,
  round(quantile_cont(value, 0.9), 4) AS p90, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99 FROM events GROUP BY event_type""",
)
def latency_percentiles(spark, sf):
    return logs.latency_percentiles(base.table(spark, sf, "events"), "value", ["event_type"])


@query(
    "load_test_summary",
    """WITH r AS (SELECT CAST(epoch_us(ts) // 1000 AS BIGINT) AS t, CAST(floor(value) AS BIGINT) AS el, CASE event_type WHEN 'error' THEN 500 ELSE 200 END AS code, CAST(user_id % 10 + 1 AS INTEGER) AS th FROM events),
s AS (SELECT *, min(t) OVER () AS a, max(t + el) OVER () AS b FROM r)
SELECT count(*) AS requests, count(*) FILTER (code = 200) AS ok, max(b) - min(a) AS wall_ms, round(1000.0 * count(*) / (max(b) - min(a)), 4) AS requests_per_s, max(th) AS max_threads FROM s""",
)
def load_test_summary(spark, sf):
    """Events taken as requests: value is the elapsed time, the user picks the client thread."""
    e = base.table(spark, sf, "events").select(
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timeStamp"),
        F.floor("value").cast("long").alias("elapsed"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("responseCode"),
        (F.col("user_id") % 10 + 1).cast("int").alias("allThreads"),
    )
    return logs.load_test_summary(e)


# --- streams ---------------------------------------------------------------------------------


def _stream_people(spark, sf):
    k = F.col("c_custkey")
    nation = base.table(spark, sf, "nation")
    return base.stream(spark, sf, "customer", deal=True).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        k.alias("sample_id"), *person_columns(k, F.col("n_name"))
    )


def _finished(stream):
    _, path = detect.run_to_files(stream)
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


@query(
    "stream_detect_and_mask",
    S.with_(*S.main_tagged())
    + f""", pr AS (SELECT sample_id, {S.REGEX_PRED} AS pred, tokens, regexp_split_to_array(CASE WHEN format = 'formdata' THEN url_decode(payload) ELSE payload END, '{S.TOKEN}') AS gaps FROM tagged),
u AS (SELECT sample_id, unnest(tokens) AS t, unnest(pred) AS l, generate_subscripts(tokens, 1) AS pos FROM pr),
v AS (SELECT sample_id, list(CASE l WHEN 'B-NIK' THEN left(t, 6) || repeat('X', length(t) - 6) WHEN 'B-PHONE' THEN left(t, 4) || repeat('X', length(t) - 6) || right(t, 2) ELSE t END ORDER BY pos) AS m,
  count(*) FILTER (l <> 'O') AS n FROM u GROUP BY sample_id)
SELECT sample_id, array_to_string(list_transform(range(1, len(gaps) + 1), lambda i: gaps[i] || coalesce(m[i], '')), '') AS masked, coalesce(n, 0) AS n FROM pr LEFT JOIN v USING (sample_id)""",
)
def stream_detect_and_mask(spark, sf):
    stream = detect.detect_and_mask(render_payloads(_stream_people(spark, sf)))
    return _finished(stream.select("sample_id", "masked", F.size("entities").cast("long").alias("n")))


_WINDOWS = lambda start, size, extra="": f"""WITH e AS (SELECT {start} AS a, {start} + INTERVAL {size} HOUR AS b, event_type, value FROM events{extra})
SELECT CAST(a AS VARCHAR) AS window_start, CAST(b AS VARCHAR) AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total, max(value) AS maximum
FROM e GROUP BY ALL"""


def _counts(spark, sf, window, slide=None, session=False):
    events = base.stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = detect.run_to_end(events, "ts", lambda e: detect.detection_counts(e, "ts", "event_type", "value", window, slide, session))
    return out.select(
        *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("window_start", "window_end")],
        "event_type", "n", F.round("total", 4).alias("total"), "maximum",
    )


@query(
    "stream_detection_counts",
    _WINDOWS("time_bucket(INTERVAL 6 HOUR, ts)", 6),
)
def stream_detection_counts(spark, sf):
    return _counts(spark, sf, "6 hours")


@query(
    "stream_detection_counts_sliding",
    _WINDOWS("(time_bucket(INTERVAL 6 HOUR, ts) - o)", 12, ", (SELECT unnest([INTERVAL 0 HOUR, INTERVAL 6 HOUR]) AS o)"),
)
def stream_detection_counts_sliding(spark, sf):
    return _counts(spark, sf, "12 hours", "6 hours")


@query(
    "stream_detection_sessions",
    """WITH g AS (SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY ts) AS session FROM g)
SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS window_start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS window_end, event_type,
  count(*) AS n, round(sum(value), 4) AS total, max(value) AS maximum FROM s GROUP BY event_type, session""",
)
def stream_detection_sessions(spark, sf):
    return _counts(spark, sf, "30 minutes", session=True)


# 2024-01-01, when the log begins, and the time by which sent IDs must show up.
_BEGIN, _DEADLINE = 1704067200, 1704067200 + 7200
_VERDICTS = f"""seen AS (SELECT nik, min(log_id % 3600) AS s FROM (SELECT log_id, unnest(detected_ids) AS nik FROM parsed) GROUP BY nik),
verdicts AS (SELECT nik, CASE WHEN s IS NULL THEN 'FN' WHEN e THEN 'TP' ELSE 'FP' END AS verdict, coalesce({_BEGIN} + s, {_DEADLINE}) AS told
  FROM seen FULL JOIN (SELECT nik, TRUE AS e FROM expected) USING (nik))"""


def _verdicts(spark, sf):
    texts = base.render_logs(_stream_people(spark, sf))
    parsed = logs.parse_blocks(logs.split_blocks(texts))
    found = explode_rows(parsed, ["log_id"], "detected_ids", "nik").select("nik", F.timestamp_seconds(F.lit(_BEGIN) + F.col("log_id") % 3600).alias("ts"))
    expected = base.expected_ids(spark, sf).withColumn("deadline", F.timestamp_seconds(F.lit(_DEADLINE)))
    return validation.run_to_deadline(found, "ts", lambda d: validation.validate_log_stream(d, expected))


@query("stream_log_validation", S.with_(*LOGS, _VERDICTS) + "SELECT nik, verdict, told FROM verdicts")
def stream_log_validation(spark, sf):
    """Detected IDs right or wrong, and sent IDs that never showed up."""
    return _verdicts(spark, sf).select("nik", "verdict", F.unix_seconds("ts").alias("told"))


@query(
    "stream_log_totals",
    S.with_(*LOGS, _VERDICTS)
    + """, w AS (SELECT told // 60 * 60 + 60 AS w, count(*) FILTER (verdict = 'TP') AS tp, count(*) FILTER (verdict = 'FP') AS fp, count(*) FILTER (verdict = 'FN') AS fn FROM verdicts GROUP BY ALL),
r AS (SELECT w AS window_end, (sum(tp) OVER x)::BIGINT AS tp, (sum(fp) OVER x)::BIGINT AS fp, (sum(fn) OVER x)::BIGINT AS fn FROM w WINDOW x AS (ORDER BY w))
SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall FROM r""",
)
def stream_log_totals(spark, sf):
    """Running totals per minute."""
    out = validation.running_totals(_verdicts(spark, sf))
    return out.withColumn("window_end", F.unix_seconds("window_end"))


@query(
    "filter_by_group",
    S.with_(S.people(), S.samples("adversarial"))
    + "SELECT format, category, count(*) AS n, CAST(sum(length(payload)) AS BIGINT) AS chars FROM samples GROUP BY ALL",
)
def filter_by_group(spark, sf):
    """One grouping instead of a filter per format and category."""
    df = base.samples(spark, sf, "adversarial")
    return df.groupBy("format", "category").agg(F.count("*").alias("n"), F.sum(F.length("payload")).alias("chars"))
