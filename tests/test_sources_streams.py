"""Readers and writers on files, and streams with late rows."""

import datetime as dt
import json
import random
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tagmill.operators import annotation, common, logs
from tagmill.sources import readers, splits, writers
from tagmill.streaming import detect, validation
from tests.test_operators import BLOCK


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_log_reader(spark, tmp_path):
    path = write(tmp_path, "p.log", "start\n" + BLOCK * 300)
    blocks = logs.parse_blocks(readers.read_log_blocks(spark, path))
    assert blocks.where("latency_ms = 8.23 and masked and size(original_ids) = 2").count() == 300
    assert blocks.count() == 300


def test_log_reader_splits_large_files(spark, tmp_path):
    path = write(tmp_path, "p.log", "start\n" + BLOCK * 3000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        blocks = readers.read_log_blocks(spark, path)
        assert splits.pieces(spark, path, "\n").rdd.getNumPartitions() > 5
        assert logs.parse_blocks(blocks).where("latency_ms = 8.23 and size(original_ids) = 2").count() == 3000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_load_test_and_latency_lists(spark, tmp_path):
    head = "timeStamp,elapsed,label,responseCode,responseMessage,threadName,dataType,success,failureMessage,bytes,sentBytes,grpThreads,allThreads,URL,Latency,IdleTime,Connect"
    row = "17799528612{0:02d},{1},POST,200,OK,t 1-5,text,true,,211,292,10,10,https://x/api,41,0,35"
    text = "\n".join(["client$ cat results.csv", head] + [row.format(i, 100 + i) for i in range(5)])
    rows = readers.read_loadtest(spark, write(tmp_path, "l.jtl", text))
    assert rows.count() == 5
    s = logs.load_test_summary(rows).first()
    assert (s["requests"], s["ok"], s["wall_ms"], s["max_threads"]) == (5, 5, 108, 10)
    p = logs.latency_percentiles(rows, "elapsed").first()
    assert (p["n"], p["p50"], p["min"], p["max"]) == (5, 102.0, 100, 104)
    lat = readers.read_latency_list(spark, write(tmp_path, "i.txt", "server$ cat i\n8.84\n8.44\n"))
    assert sorted(r[0] for r in lat.collect()) == [8.44, 8.84]


def test_annotation_export(spark, tmp_path):
    result = lambda s, e, n: {"type": "labels", "value": {"start": s, "end": e, "text": "", "labels": [n]}}
    tasks = [
        {"id": 1, "inner_id": 1, "data": {"text": "Rina 081", "meta_format": "x"}, "annotations": [
            {"completed_by": {"id": 7, "email": "a@x"}, "result": [result(0, 4, "NAMA"), {"type": "choices", "value": {}}]},
            {"completed_by": 8, "result": [result(5, 8, "PHONE")]},
        ]},
        {"id": 2, "inner_id": 2, "data": {"text": "Budi"}, "annotations": [{"completed_by": 99, "result": []}]},
        {"id": 3, "inner_id": 3, "data": {"text": "-"}, "annotations": []},
    ]
    df = readers.read_annotation_export(spark, write(tmp_path, "e.json", json.dumps(tasks, indent=1)))
    assert tuple(annotation.annotation_completeness(df).first()) == (3, 1, 1, 1)
    rows = {r["role"]: r for r in annotation.annotation_labels(df, "a@x", "8").collect()}
    assert rows["A"]["labels"] == ["B-NAMA", "O"] and rows["B"]["labels"] == ["O", "B-PHONE"]
    assert rows["A"]["meta_format"] == "x"


def test_round1_sheet(spark, tmp_path):
    doc = {"round": "1", "completed": True, "annotations": [{"sample_id": 3, "format": "x", "NIK": ["1", "2"], "PHONE": [], "NAMA": ["R"], "note": "n"}]}
    df = readers.read_round1(spark, write(tmp_path, "r.json", json.dumps(doc, indent=1)))
    holdout = spark.createDataFrame([(3, None, ["a", "b"], "y")], "sample_id bigint, payload string, tokens array<string>, format string")
    full = annotation.attach_text(df, holdout)
    row = annotation.annotation_sheet(full).first()
    assert (row["ID"], row["Format"], row["Raw_Text"], row["NIK"], row["PHONE"], row["LOKASI"], row["Catatan"]) == ("sample_003", "y", "a b", "1 || 2", "", "", "n")
    assert annotation.annotation_sheet(full, filled=False).first()["NIK"] == ""
    path = str(tmp_path / "sheet")
    writers.write_annotation_sheet(annotation.annotation_sheet(full), path)
    assert spark.read.csv(path, header=True).first()["NIK"] == "1 || 2"


def test_terms_and_missing_gazetteer(spark, tmp_path):
    terms = readers.read_term_list(spark, write(tmp_path, "t.txt", " a \n\n\tb\n   \n"))
    assert sorted(r[0] for r in terms.collect()) == ["a", "b"]
    assert readers.read_gazetteer(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception):
        readers.read_samples(spark, str(tmp_path / "none"))


def _rows_stream(spark, tmp_path, batches, schema):
    folder = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(folder))


def test_late_rows_are_dropped(spark, tmp_path):
    at = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    batches = [[(at(1, 0), "NIK", 5.0), (at(1, 10), "NIK", 7.0)], [(at(3, 0), "NIK", 1.0)], [(at(3, 30), "NIK", 1.0)], [(at(1, 5), "NIK", 100.0), (at(5, 0), "NIK", 1.0)]]
    stream = _rows_stream(spark, tmp_path, batches, "ts timestamp, entity string, ms double")
    counts = detect.detection_counts(stream, "ts", "entity", "ms", "1 hour", late="10 minutes")
    _, path = detect.run_to_files(counts)
    got = {r["window_start"].hour: (r["n"], r["total"]) for r in spark.read.parquet(path).collect()}
    assert got[1] == (2, 12.0) and got[3] == (2, 2.0) and 5 not in got


def test_metrics_and_model_tables(spark, tmp_path):
    m = spark.createDataFrame([("NIK", 1.0)], "entity string, f1 double")
    writers.write_metrics(m, str(tmp_path / "m"), model="regex", dataset="holdout")
    assert spark.read.parquet(str(tmp_path / "m")).first()["dataset"] == "holdout"
    assert common.shared_folder(spark) != common.shared_folder(spark)


@pytest.fixture
def small_splits(spark):
    """Splits of a few bytes; pieces are read alike however they are packed into tasks."""
    keys = {"spark.sql.files.maxPartitionBytes": "70", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


def test_log_blocks_over_many_splits(spark, tmp_path, small_splits):
    rng = random.Random(1)
    parts = ["".join(rng.choice(["word ", "a=b ", "=" * 49 + " ", "\n", "long line " * 9]) for _ in range(rng.randint(0, 8))) for _ in range(60)]
    text = "".join(p + "=" * rng.randint(50, 70) + rng.choice(["\n", "", "x\n"]) for p in parts) + "tail"
    path = write(tmp_path, "s.log", text)
    assert splits.pieces(spark, path, "\n").select("start").distinct().count() > 20
    got = sorted(r["text"].strip() for r in splits.split_by(spark, path, "={50,}").collect())
    assert got == sorted(p.strip() for p in re.split("={50,}", text))
    assert splits.split_by(spark, write(tmp_path, "none.log", "a\nb" * 100), "={50,}").count() == 1
    assert splits.split_by(spark, write(tmp_path, "empty.log", ""), "={50,}").count() == 0


def test_json_arrays_over_many_splits(spark, tmp_path, small_splits):
    rng = random.Random(2)
    odd = ["", "}", "{", '"', "\\", "\\\\", '\\"', "]}[{", "é漢", "x" * 120, "a, b: {c}"]
    value = lambda d: rng.choice([rng.choice(odd), 5, None, [rng.choice(odd) for _ in range(rng.randint(0, 3))], {rng.choice(odd): value(d + 1)} if d < 3 else {}])
    for n, options in enumerate([{}, {"indent": 2}, {"ensure_ascii": False}, {"separators": (",", ":")}]):
        records = [{"id": i, **{rng.choice(odd): value(0) for _ in range(rng.randint(0, 4))}} for i in range(40)]
        path = write(tmp_path, f"r{n}.json", json.dumps(records, **options))
        assert splits.pieces(spark, path, "}").select("start").distinct().count() > 10
        got = [json.loads(r["text"]) for r in splits.json_array(spark, path).collect()]
        assert sorted(got, key=lambda r: r["id"]) == records
    for text in ("[]", "", " [ ] "):
        assert splits.json_array(spark, write(tmp_path, "none.json", text)).count() == 0


def test_annotation_export_is_read_by_several_tasks(spark, tmp_path):
    tasks = [{"id": i, "inner_id": i, "data": {"text": f"t{i} }} \" {{", "meta_format": "x"}, "annotations": [{"completed_by": {"id": 7, "email": "a@x"}, "result": []}]} for i in range(3000)]
    path = write(tmp_path, "big.json", json.dumps(tasks))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        rows = readers.read_annotation_export(spark, path)
        assert splits.pieces(spark, path, "}").rdd.getNumPartitions() > 5
        assert sorted((r["id"], r["data"]["text"], len(r["annotations"])) for r in rows.collect()) == [(t["id"], t["data"]["text"], 1) for t in tasks]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    out = str(tmp_path / "again")
    writers.write_annotation_export(readers.read_annotation_export(spark, path), out)
    assert readers.read_annotation_export(spark, out).count() == 3000


def test_metrics_are_replaced_and_double_rows_refused(spark, tmp_path):
    path = str(tmp_path / "metrics")
    rows = lambda f1: spark.createDataFrame([("NIK", f1), ("_macro", f1)], "entity string, f1 double")
    writers.write_metrics(rows(0.1), path, model="a", dataset="x")
    writers.write_metrics(rows(0.2), path, model="b", dataset="x")
    writers.write_metrics(rows(0.3), path, model="a", dataset="x")
    read = lambda: readers.read_metrics(spark, path, "entity string, f1 double")
    assert sorted((r["model"], r["entity"], r["f1"]) for r in read().collect()) == [("a", "NIK", 0.3), ("a", "_macro", 0.3), ("b", "NIK", 0.2), ("b", "_macro", 0.2)]
    rows(0.4).write.mode("append").parquet(f"{path}/model=a/dataset=x")
    with pytest.raises(Exception, match="double metrics rows"):
        read().collect()


def test_stream_tells_misses_repeats_and_late_ids(spark, tmp_path):
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    batches = [
        [(at(1), "hit"), (at(1, 1), "hit"), (at(1, 5), "wrong")],
        [(at(1, 30), "wrong"), (at(1, 40), None), (at(2), "hit")],
        [(at(9), "other")],
        [(at(9, 30), None)],  # rows are held against the watermark of the batch before
        [(at(10), "missed"), (at(10, 1), "missed"), (at(3), "too late")],
        [(at(23), None)],
    ]
    stream = _rows_stream(spark, tmp_path, batches, "ts timestamp, nik string")
    expected = spark.createDataFrame([("hit", at(5)), ("missed", at(5)), ("missed", at(4)), ("never", at(6)), (None, at(6))], "nik string, deadline timestamp")
    out = validation.validate_log_stream(stream, expected)
    _, path = detect.run_to_files(out)
    rows = spark.read.parquet(path)
    got = sorted((r["nik"], r["verdict"], r["ts"].hour) for r in rows.collect())
    assert got == [("hit", "TP", 1), ("missed", "FN", 5), ("missed", "late", 10), ("never", "FN", 6), ("other", "FP", 9), ("wrong", "FP", 1)]
    totals = [(r["tp"], r["fp"], r["fn"]) for r in validation.running_totals(rows, "1 hour").orderBy("window_end").collect()]
    assert totals == [(1, 1, 0), (1, 1, 1), (1, 1, 2), (1, 2, 2), (2, 2, 1)]


def test_ids_of_a_bucket_share_state_and_are_told_apart(spark, tmp_path):
    """Few state rows and timers for many IDs, with the verdicts that a state per ID gives."""
    rng = random.Random(11)
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    batches = [[(at(600 * n + rng.randint(-100, 300)), f"id {rng.randint(0, 400)}") for _ in range(150)] for n in range(5)] + [[(at(9000), None)]]
    sent = spark.createDataFrame([(f"id {i}", at(rng.randint(0, 2500))) for i in range(0, 400, 2)], "nik string, deadline timestamp")
    stream = _rows_stream(spark, tmp_path, batches, "ts timestamp, nik string")
    found = {}
    for buckets in (3, 1_000_003):
        query, path = detect.run_to_files(validation.validate_log_stream(stream, sent, buckets=buckets, forget="5 hours"))
        found[buckets] = sorted(map(tuple, spark.read.parquet(path).collect()))
        kept = max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress)
        assert (kept <= 3 * 4) == (buckets == 3)
    assert found[3] == found[1_000_003]
    told = [v for _, v, *_ in found[3]]
    assert {v: told.count(v) > 5 for v in set(told)} == dict.fromkeys(validation.CHANGES, True)
    fp = [n for n, v, *_ in found[3] if v == "FP"]
    assert len(fp) > len(set(fp))  # some were forgotten and came again


def test_streams_of_small_files_are_dealt_out(spark, tmp_path, monkeypatch):
    from tagmill.plans import base

    pq.write_table(pa.table({"id": list(range(300))}), tmp_path / "customer.parquet")
    pq.write_table(pa.table({"id": [1, 2, 3]}), tmp_path / "nation.parquet")
    monkeypatch.setattr(base, "STREAM_ROWS", 20)
    tasks = F.spark_partition_id().alias("task")
    _, path = detect.run_to_files(base.stream(spark, str(tmp_path), "customer", deal=True).select("id", tasks))
    got = spark.read.parquet(path).collect()
    assert sorted(r.id for r in got) == list(range(300)) and len({r.task for r in got}) == 15
