"""The pipeline: columns, each stage's effect on planted cases, odd input."""

import random

import corpus_pipeline as pipeline
from tests.llm.test_operators import check_packing, plain_components


def planted(n=260):
    rng = random.Random(20)
    vocabulary = [f"w{i}" for i in range(5000)]
    rows, labels = [], []
    for d in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(30, 90))]
        text = " ".join(w[:20]) + "\nRead more on our site.\n" + " ".join(w[20:])
        bad = d % 9 == 0
        if bad:
            text = " ".join(f"{x.upper()}!!" for x in w)
        rows.append((d, text, "en", "ab"[d % 2]))
        labels.append((d, int(not bad), 0))
    rows += [(n + i, rows[1][1], "en", "a") for i in range(5)]  # exact copies of document 1
    rows += [(n + 10, rows[2][1] + " end", "en", "a"), (n + 11, None, None, None), (n + 12, "", "en", "a")]
    return rows, labels


def test_stages(spark, frame, tmp_path):
    rows, labels = planted()
    docs = frame(rows)
    sf = str(tmp_path)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    assert [name for name, _ in pipeline.STAGES] == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "mixing_to_targets", "best_fit_packing"]
    columns, after = docs.columns, {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        after[name] = docs
        if name != "best_fit_packing":
            assert docs.columns == columns
    first = {r.doc_id for r in after["quality_classifier"].collect()}
    good = {r[0] for r in rows if not (r[0] % 9 == 0 and r[0] < 260)}
    assert len(good - first) <= 2 and len(first - good) <= 2
    lines = {r.doc_id: r for r in after["line_dedup"].collect()}
    assert set(lines) == first
    assert all("Read more" not in r.text and r.n_chars == len(r.text) for r in lines.values() if r.text)
    groups = plain_components([(d, r.text) for d, r in lines.items()], 5, 80, 100)
    assert {r.doc_id for r in after["ngram_jaccard_join"].collect()} == {d for d, (_, c) in groups.items() if d == c}
    mixed = [(r.doc_id, r.text) for r in after["mixing_to_targets"].collect()]
    assert mixed
    check_packing(after["best_fit_packing"].collect(), mixed)


def test_empty_documents(spark, frame, tmp_path):
    frame([(1, "x")]).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []


def test_copies_end_as_one_full_document(spark, frame, tmp_path):
    rng = random.Random(21)
    vocabulary = [f"w{i}" for i in range(5000)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    text, near = "\n".join(line(12) for _ in range(8)), [line(12) for _ in range(12)]
    rows = [(i, f"{line(30)}\nRead more on our site.\n{line(30)}") for i in range(40)]
    rows += [(100 + i, text) for i in range(30)]  # exact copies
    rows += [(200 + i, "\n".join([*near, "Read more on our site.", f"copy {i}"])) for i in range(30)]  # copies but for a line
    rows += [(300, text), (300, text), (301, None), (302, "")]
    docs = frame(rows)
    lines = pipeline.without_common_lines(spark, docs, str(tmp_path))
    assert lines.columns == docs.columns
    got = {r.doc_id: r for r in lines.collect()}
    assert [d for d in got if 100 <= d < 200 or d == 300] == [100] and got[100].text == text and got[100].n_chars == len(text)
    assert got[200].text == rows[70][1]  # whole, its shared line too
    assert {got[200 + i].text for i in range(1, 30)} == {f"copy {i}" for i in range(1, 30)}
    assert all("Read more" not in got[i].text for i in range(40))
    assert got[301].text is None or got[301].text == ""
    assert got[302].text == ""
    frame([(r.doc_id, r.text) for r in got.values()]).write.parquet(f"{tmp_path}/lines")
    last = {r.doc_id: r.text for r in pipeline.one_of_each_group(spark, spark.read.parquet(f"{tmp_path}/lines"), "").collect()}
    assert [d for d, t in last.items() if t and set(t.split("\n")) & set(text.split("\n"))] == [100] and last[100] == text
