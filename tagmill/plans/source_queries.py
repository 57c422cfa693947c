"""Queries that write a derived table and read it back through the fixed-schema readers."""

from pyspark.sql import functions as F

from ..operators import annotation, gazetteer, hmm, logs, metrics, split
from ..operators.common import materialize, shared_folder
from .payloads import render_requests
from ..sources import readers, schemas, writers
from . import base, label_queries, model_queries, review_queries, sqlbase as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("samples_csv_roundtrip", label_queries.ORACLES["render_holdout"])
def samples_csv(spark, sf):
    path = shared_folder(spark)
    writers.write_samples_csv(base.samples(spark, sf, "holdout"), path)
    back = readers.read_samples_csv(spark, path)
    return back.select("sample_id", "payload", "format", "source", "category", "pii_data.*")


@query("splits_parquet_roundtrip", label_queries.ORACLES["split_format_crosstab"])
def splits_parquet(spark, sf):
    """Written by split, so that training reads one partition."""
    path = shared_folder(spark)
    writers.write_samples(split.stratified_split(base.samples(spark, sf)), path, partition_by="split")
    return split.split_crosstab(readers.read_samples(spark, path, schemas.SAMPLES + ", split string"))


@query(
    "hmm_model_roundtrip",
    S.with_(*model_queries._hmm_sql())
    + """SELECT 'start' AS kind, CAST(NULL AS VARCHAR) AS prev, state, CAST(NULL AS VARCHAR) AS token, round(logp, 6) AS logp FROM hs
UNION ALL SELECT 'trans', prev, state, NULL, round(logp, 6) FROM ht UNION ALL SELECT 'emission', NULL, state, token, round(logp, 6) FROM he
UNION ALL SELECT 'unseen', NULL, state, NULL, round(logp, 6) FROM hu""",
)
def hmm_model(spark, sf):
    path = shared_folder(spark)
    counts = materialize(hmm.hmm_counts(base.tagged(spark, sf)))
    writers.write_hmm(hmm.fit_hmm(None, counts=counts), path)
    none = F.lit(None).cast("string")
    parts = [
        t.select(F.lit(k).alias("kind"), *[F.col(c) if c in t.columns else none.alias(c) for c in ("prev", "state", "token")], F.round("logp", 6).alias("logp"))
        for k, t in readers.read_hmm(spark, path).items()
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("gazetteer_roundtrip", model_queries.ORACLES["build_gazetteer"])
def gazetteer_table(spark, sf):
    path = shared_folder(spark)
    writers.write_gazetteer(gazetteer.build_gazetteer(base.tagged(spark, sf)), path)
    return readers.read_gazetteer(spark, path)


@query("metrics_roundtrip", label_queries.ORACLES["regex_entity_metrics"].replace("SELECT * FROM metrics", "SELECT 'regex' AS model, 'main' AS dataset, * FROM metrics"))
def metrics_table(spark, sf):
    """Written twice, as a repeated job would; the second write replaces the first."""
    path = shared_folder(spark)
    table = materialize(metrics.entity_metrics(base.predicted(spark, sf)))
    writers.write_metrics(table.limit(1), path, "json", model="hmm", dataset="main")
    for _ in range(2):
        writers.write_metrics(table, path, "json", model="regex", dataset="main")
    schema = ", ".join(f"{c} {t}" for c, t in table.dtypes)
    return readers.read_metrics(spark, path, schema, "json").where("model = 'regex'")


_TASKS = """t AS (SELECT conv_id AS id, turn AS inner_id, text, role, turn % 3 AS k FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)"""


def _tasks(spark, sf):
    """Turns as annotation tasks: none, one or two annotators, who mark the first letters; other results stand between."""
    turns = base.table(spark, sf, "conversations").where("conv_id is not null and turn is not null")
    text, k = F.coalesce("text", F.lit("")), F.col("turn") % 3
    none = F.lit(None)
    value = lambda start, end, label: F.struct(
        F.lit("labels").alias("type"),
        F.struct(F.lit(start).alias("start"), end.cast("int").alias("end"), F.lit('a "quoted" } text').alias("text"), F.array(F.lit(label)).alias("labels")).alias("value"),
    )
    choice = F.struct(F.lit("choices").alias("type"), F.struct(none.cast("int").alias("start"), none.cast("int").alias("end"), none.cast("string").alias("text"), none.cast("array<string>").alias("labels")).alias("value"))
    who = lambda w, *results: F.struct(F.lit(w).alias("completed_by"), F.array(*results).alias("result"))
    a = who('{"id": 7, "email": "a@x"}', value(0, F.least(F.char_length(text), F.lit(4)), "NAMA"), choice)
    b = who("8", choice, value(0, F.least(F.char_length(text), F.lit(2)), "LOKASI"), value(2, F.least(F.char_length(text), F.lit(5)), "NAMA"))
    kind = "array<struct<completed_by:string,result:array<struct<type:string,value:struct<start:int,end:int,text:string,labels:array<string>>>>>>"
    found = F.when(k == 0, F.array().cast(kind)).when(k == 1, F.array(a)).otherwise(F.array(a, b))
    return turns.select(
        F.col("conv_id").alias("id"), F.col("turn").alias("inner_id"), F.struct(text.alias("text"), F.col("role").alias("meta_format")).alias("data"), found.alias("annotations"),
    )


@query(
    "annotation_export",
    f"""WITH {_TASKS}, r AS (SELECT id, inner_id, text, role, unnest(CASE WHEN k = 1 THEN ['A'] WHEN k = 2 THEN ['A', 'B'] END) AS who FROM t WHERE k > 0)
SELECT id AS task_id, inner_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(role, 'unknown') AS meta_format, who AS role,
  CASE who WHEN 'A' THEN 'NAMA|0|' || least(length(coalesce(text, '')), 4) ELSE 'LOKASI|0|' || least(length(coalesce(text, '')), 2) || ',NAMA|2|' || least(length(coalesce(text, '')), 5) END AS spans FROM r""",
)
def annotation_export(spark, sf):
    """Tasks written as JSON arrays and read back in splits: a row per task and annotator."""
    path = shared_folder(spark)
    writers.write_annotation_export(_tasks(spark, sf), path)
    rows = annotation.annotation_rows(readers.read_annotation_export(spark, path), "a@x", "8")
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("|", s["labels"][0], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return rows.select("task_id", "inner_id", F.sha2("text", 256).alias("text_sha256"), "meta_format", "role", spans.alias("spans"))


@query("annotation_export_completeness", f"WITH {_TASKS} SELECT count(*) AS tasks, count(*) FILTER (k = 0) AS zero, count(*) FILTER (k = 1) AS one, count(*) FILTER (k = 2) AS two_or_more FROM t")
def annotation_export_completeness(spark, sf):
    path = shared_folder(spark)
    writers.write_annotation_export(_tasks(spark, sf), path)
    return annotation.annotation_completeness(readers.read_annotation_export(spark, path))


@query(
    "loadtest_file",
    """SELECT CAST(epoch_us(ts) // 1000 AS BIGINT) AS "timeStamp", CAST(floor(value) AS INTEGER) AS elapsed, CASE event_type WHEN 'error' THEN 500 ELSE 200 END AS "responseCode",
  event_type <> 'error' AS success, event_type AS label, CAST(user_id % 10 + 1 AS INTEGER) AS "allThreads" FROM events""",
)
def loadtest_file(spark, sf):
    """Events as load-test lines, with the prompt and header that such files begin with."""
    path = shared_folder(spark)
    code = F.when(F.col("event_type") == "error", "500").otherwise("200")
    line = F.concat_ws(
        ",", F.unix_millis(F.col("ts").cast("timestamp")).cast("string"), F.floor("value").cast("string"), "event_type", code, F.lit("OK"), F.lit("t 1-1"), F.lit("text"),
        (F.col("event_type") != "error").cast("string"), F.lit(""), F.lit("211"), F.lit("292"), F.lit("10"), (F.col("user_id") % 10 + 1).cast("string"), F.lit("https://x/api"), F.lit("41"), F.lit("0"), F.lit("35"),
    )
    head = spark.createDataFrame([("client$ cat results.csv",), ("timeStamp,elapsed,label,responseCode",)], "value string")
    base.table(spark, sf, "events").select(line.alias("value")).union(head).write.text(path)
    return readers.read_loadtest(spark, path).select("timeStamp", "elapsed", "responseCode", "success", "label", "allThreads")


@query(
    "annotation_sheet_file",
    review_queries.ORACLES["annotation_sheet"],
)
def annotation_sheet_file(spark, sf):
    """The sheet written as CSV and read back; empty cells stay empty."""
    path = shared_folder(spark)
    sheet = review_queries.QUERIES["annotation_sheet"](spark, sf)
    writers.write_annotation_sheet(sheet, path)
    return readers.read_annotation_sheet(spark, path, sheet.columns)


@query(
    "log_files",
    S.with_(*review_queries.LOGS)
    + """SELECT array_to_string(list_sort(original_ids), ',') AS original_ids, array_to_string(list_sort(detected_ids), ',') AS detected_ids, masked, latency_ms FROM parsed""",
)
def log_files(spark, sf):
    path = shared_folder(spark)
    base.logs(spark, sf).select("value").write.text(path)
    ids = lambda c: F.array_join(F.array_sort(c), ",").alias(c)
    return logs.parse_blocks(readers.read_log_blocks(spark, path)).select(
        ids("original_ids"), ids("detected_ids"), "masked", "latency_ms"
    )


@query("term_list", S.with_(S.niks()) + "SELECT nik AS value FROM niks")
def term_list(spark, sf):
    path = shared_folder(spark)
    base.niks(spark, sf).select(F.concat(F.lit(" "), "nik", F.lit(" \n"))).write.text(path)
    return readers.read_term_list(spark, path)


@query(
    "id_reference",
    S.with_(S.people())
    + """SELECT nik AS "NIK", substr(nik, 1, 2) AS "Provinsi", substr(nik, 7, 2) AS "Tanggal Lahir",
  CASE WHEN CAST(substr(nik, 7, 2) AS INTEGER) > 40 THEN 'P' ELSE 'L' END AS "Jenis Kelamin", substr(nik, 13) AS "Nomor Urut" FROM people""",
)
def id_reference(spark, sf):
    path = shared_folder(spark)
    base.people(spark, sf).select(
        F.col("nik").alias("NIK"), F.substring("nik", 1, 2).alias("Provinsi"), F.substring("nik", 7, 2).alias("Tanggal Lahir"),
        F.when(F.substring("nik", 7, 2).cast("int") > 40, "P").otherwise("L").alias("Jenis Kelamin"), F.substring("nik", 13, 4).alias("Nomor Urut"),
    ).write.csv(path, header=True)
    return readers.read_id_reference(spark, path)


@query("write_requests", label_queries.ORACLES["render_requests"])
def requests(spark, sf):
    path = shared_folder(spark)
    writers.write_payloads(render_requests(base.people(spark, sf)), path)
    return spark.read.schema(schemas.PAYLOADS).json(path)
