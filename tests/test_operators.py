"""Operators against hand-computed cases and brute force on small inputs."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagmill.functions.labels import entity_spans, tag_regex
from tagmill.functions.text import tokenize
from tagmill.operators import (
    agreement, common, compare, features, gazetteer, hmm, labeling, linear, logs, masking, metrics, split, throughput, trie,
)
from tests.test_functions import TOKENS, _random_labels, _spans

PII = "struct<nik:string,nama:string,telepon:string,jabatan:string,lokasi:string>"


def samples(spark, rows):
    df = spark.createDataFrame(
        [(i, p, f, d) for i, (p, f, d) in enumerate(rows)], f"sample_id bigint, payload string, format string, pii_data {PII}"
    )
    return [(r["tokens"], r["labels"]) for r in labeling.label_samples(df).orderBy("sample_id").collect()]


def test_labels_of_fixture_rows(spark):
    got = samples(
        spark,
        [
            ('{"nik": "3274635212890001"}', "json", {"nik": "3274635212890001"}),
            (
                "nomor_induk=3274635212890001&nama_lengkap=Rina%20Sari&nomor_hp=+6281234567890", "formdata",
                {"nik": "3274635212890001", "nama": "Rina Sari", "telepon": "+6281234567890"},
            ),
            ("Rina Sari di jawa barat", "narrative", {"nama": "Rina Sari", "lokasi": "Jawa Barat"}),
            ("   ", "narrative", {"nama": "Rina"}),
            ("Rina Sari", "negative", {"nama": "Rina Sari"}),
            ("Rina Sari", "narrative", None),
            ("Kepala Dinas di Kepala", "narrative", {"jabatan": "Kepala Dinas", "lokasi": "Dinas di Kepala", "nama": "Kepala"}),
        ],
    )
    labels = [g[1] for g in got]
    assert labels[0] == ["O"] * 6 + ["B-NIK", "O", "O"]
    assert labels[1] == ["O"] * 3 + ["B-NIK"] + ["O"] * 4 + ["B-NAMA", "I-NAMA"] + ["O"] * 4 + ["B-PHONE"]
    assert labels[2] == ["B-NAMA", "I-NAMA", "O", "B-LOKASI", "I-LOKASI"]
    assert got[3] == ([], [])
    assert labels[4] == labels[5] == ["O", "O"]
    # The place meets the title and is skipped; the name is found at its first place only.
    assert labels[6] == ["B-JABATAN", "I-JABATAN", "O", "O"]


def test_labels_as_brute_force(spark):
    rng, words = random.Random(3), ["a", "B", "b", "c1", "-", "7"]
    order = [("nik", "NIK"), ("telepon", "PHONE"), ("jabatan", "JABATAN"), ("lokasi", "LOKASI"), ("nama", "NAMA")]
    rows = []
    for _ in range(300):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))
        rows.append((text, "narrative", {f: " ".join(rng.choice(words) for _ in range(rng.randint(0, 3))) for f, _ in order}))

    def find(tokens, target):
        k = len(target)
        return next((i for i in range(len(tokens) - k + 1) if k and tokens[i : i + k] == target), None)

    def plain(text, record):
        tokens = TOKENS.findall(text)
        labels = ["O"] * len(tokens)
        for field, name in order:
            target = TOKENS.findall(record[field])
            at = find(tokens, target)
            if at is None:
                at = find([t.lower() for t in tokens], [t.lower() for t in target])
            if at is None or any(x != "O" for x in labels[at : at + len(target)]):
                continue
            labels[at : at + len(target)] = [f"B-{name}"] + [f"I-{name}"] * (len(target) - 1)
        return tokens, labels

    assert samples(spark, rows) == [plain(t, r) for t, _, r in rows]


def test_metrics_demo_case(spark):
    df = spark.createDataFrame(
        [
            (["B-NAMA", "O", "O", "B-LOKASI"], ["B-NAMA", "O", "O", "B-LOKASI"]),
            (["O", "B-NIK", "O", "B-NAMA"], ["O", "B-NIK", "O", "O"]),
        ],
        "labels array<string>, pred array<string>",
    )
    m = {r["entity"]: r for r in metrics.entity_metrics(df, digits=4).collect()}
    assert m["NIK"]["f1"] == m["LOKASI"]["f1"] == 1.0
    assert (m["NAMA"]["precision"], m["NAMA"]["recall"], m["NAMA"]["f1"]) == (1.0, 0.5, 0.6667)
    assert m["_macro"]["f1"] == 0.8889
    assert (m["_micro"]["precision"], m["_micro"]["recall"], m["_micro"]["f1"]) == (1.0, 0.75, 0.8571)


def test_mcnemar_cases(spark):
    cases = [(0, 0), (5, 0), (3, 3), (30, 10)]
    df = spark.createDataFrame([("A", "B", b, c) for b, c in cases], "model_a string, model_b string, a_only bigint, b_only bigint")
    exact = compare.mcnemar_stats(df).collect()
    legacy = compare.mcnemar_stats(df, "reference").collect()
    assert [round(r["chi_square"], 4) for r in exact] == [0.0, 3.2, 0.1667, 9.025]
    assert [round(r["p_value"], 4) for r in exact[:3]] == [1.0, 0.0625, 1.0]
    assert [round(r["p_value"], 4) for r in legacy[:3]] == [1.0, 0.0, 0.6875]
    assert abs(exact[3]["p_value"] - math.erfc(math.sqrt(9.025 / 2))) < 1e-12
    assert [r["better_model"] for r in exact] == ["TIE", "A", "TIE", "A"]


# --- hidden Markov model ---------------------------------------------------------------------


def test_tiny_hmm(spark):
    train = spark.createDataFrame(
        [(0, ["a", "b"], ["X", "O"]), (1, ["a"], ["X"]), (2, [], [])], "sample_id bigint, tokens array<string>, labels array<string>"
    )
    model = hmm.fit_hmm(train)
    p = lambda name, *keys: {tuple(r[k] for k in keys): round(math.exp(r["logp"]), 9) for r in model[name].collect()}
    assert p("start", "state") == {("X",): 0.75, ("O",): 0.25}
    assert p("trans", "prev", "state") == {("X", "O"): round(2 / 3, 9), ("X", "X"): round(1 / 3, 9), ("O", "O"): 0.5, ("O", "X"): 0.5}
    assert p("emission", "state", "token") == {("X", "a"): 0.6, ("O", "b"): 0.5}
    assert p("unseen", "state") == {("X",): 0.2, ("O",): 0.25}


def _viterbi(tokens, start, trans, emission, unseen):
    states = sorted(start)
    if not tokens:
        return []
    e = lambda s, t: emission.get((s, t), unseen[s])
    score = {s: start[s] + e(s, tokens[0]) for s in states}
    back = []
    for t in tokens[1:]:
        step, came = {}, {}
        for s in states:
            best = max(states, key=lambda r: (score[r] + trans[r, s] + e(s, t), -states.index(r)))
            step[s], came[s] = score[best] + trans[best, s] + e(s, t), best
        score = step
        back.append(came)
    path = [max(states, key=lambda s: (score[s], -states.index(s)))]
    for came in reversed(back):
        path.append(came[path[-1]])
    return path[::-1]


def test_viterbi_as_textbook_on_both_paths(spark):
    rng = random.Random(5)
    train = [
        (i, [rng.choice("abcdef") for _ in range(n)], _random_labels(rng, n)) for i, n in enumerate(rng.randint(1, 12) for _ in range(60))
    ]
    df = spark.createDataFrame(train, "sample_id bigint, tokens array<string>, labels array<string>")
    model = {k: common.materialize(v) for k, v in hmm.fit_hmm(df).items()}
    start = {r["state"]: r["logp"] for r in model["start"].collect()}
    trans = {(r["prev"], r["state"]): r["logp"] for r in model["trans"].collect()}
    emission = {(r["state"], r["token"]): r["logp"] for r in model["emission"].collect()}
    unseen = {r["state"]: r["logp"] for r in model["unseen"].collect()}
    goal = [(i, [rng.choice("abcdefz") for _ in range(rng.randint(0, 30))]) for i in range(120)]
    goals = spark.createDataFrame(goal, "sample_id bigint, tokens array<string>")
    want = {i: _viterbi(t, start, trans, emission, unseen) for i, t in goal}
    small = {r["sample_id"]: r["pred"] for r in hmm.tag_hmm(goals, model).collect()}
    joined = {r["sample_id"]: r["pred"] for r in hmm.tag_hmm(goals, model, model_bytes=3).collect()}
    assert small == want
    assert joined == want
    twice = goals.withColumn("sample_id", F.lit(1))  # ids may repeat
    again = lambda **k: sorted((r["tokens"], r["pred"]) for r in hmm.tag_hmm(twice, model, **k).collect())
    assert again() == again(model_bytes=3) == sorted((t, want[i]) for i, t in goal)


def test_viterbi_with_200_states():
    rng = np.random.default_rng(3)
    scores = [rng.normal(size=(n, 200)) for n in (5, 1, 0, 9, 5)]
    start, trans = rng.normal(size=200), rng.normal(size=(200, 200))
    for e, path in zip(scores, hmm._viterbi_batch(scores, start, trans)):
        best, back = start + e[0] if len(e) else None, []
        for x in e[1:]:
            step = best[:, None] + trans + x
            back.append(step.argmax(0))
            best = step.max(0)
        want = [] if best is None else [int(best.argmax())]
        for b in reversed(back):
            want.append(int(b[want[-1]]))
        assert list(path) == want[::-1]


def test_many_and_long_entity_types(spark):
    types = [f"T{i}|x" for i in range(60)] + ["L" * 300]
    labels = [x for t in types for x in (f"B-{t}", f"I-{t}", "O")]
    df = spark.createDataFrame([(labels, labels)], "labels array<string>, pred array<string>")
    spans = df.select(entity_spans("labels", types).alias("s")).first()["s"]
    assert [(s["type"], s["start"], s["end"]) for s in spans] == [(t, 3 * i, 3 * i + 1) for i, t in enumerate(types)]
    got = {r["entity"]: r["tp"] for r in metrics.entity_counts(df, [], "labels", "pred", types).collect()}
    assert got == {t: 1 for t in types}
    token = spark.createDataFrame([("secret", "B-" + "L" * 300)], "t string, l string")
    masked = token.select(masking.mask_token(F.col("t"), F.col("l"), {"L" * 300: (0, 0, "*")}).alias("m")).first()["m"]
    assert masked == "******"


def test_the_word_false_keeps_its_features(spark):
    df = spark.createDataFrame([(1, ["x", "false", "y"])], "sample_id bigint, tokens array<string>")
    feats = features.token_features(df)
    words = feats.select(features.feature_strings(feats).alias("f")).first()["f"]
    assert "word_identity=false" in words[1] and "word_lower=false" in words[1] and "m1_lower=false" in words[2]
    assert not any(w.endswith("_istitle=false") for w in words[1])


# --- agreement -------------------------------------------------------------------------------


def _relaxed(a, b):
    sa, sb = _spans(a), _spans(b)
    tp, hit_a, hit_b = Counter(), set(), set()
    for i, (ta, s, e) in enumerate(sa):
        for j, (tb, bs, be) in enumerate(sb):
            if ta == tb and not (e < bs or be < s):
                tp[ta] += 1
                hit_a.add(i)
                hit_b.add(j)
                break
    fn = Counter(t for i, (t, _, _) in enumerate(sa) if i not in hit_a)
    fp = Counter(t for j, (t, _, _) in enumerate(sb) if j not in hit_b)
    return {t: (tp[t], fp[t], fn[t]) for t in set(tp) | set(fp) | set(fn)}


def test_relaxed_match_as_brute_force(spark):
    rng = random.Random(11)
    rows = [(i, _random_labels(rng, n), _random_labels(rng, n)) for i, n in enumerate(rng.randint(0, 20) for _ in range(300))]
    rows.append((999, ["B-NAMA", "I-NAMA", "I-NAMA", "I-NAMA"], ["B-NAMA", "I-NAMA", "B-NAMA", "I-NAMA"]))
    df = spark.createDataFrame(rows, "task_id bigint, labels_a array<string>, labels_b array<string>")
    got = agreement.match_spans_relaxed(df).select("task_id", "tp", "fp", "fn").collect()
    count = lambda keys: Counter(k.split("|")[0] for k in keys)
    for r, (_, a, b) in zip(sorted(got, key=lambda r: r["task_id"]), rows):
        tp, fp, fn = count(r["tp"]), count(r["fp"]), count(r["fn"])
        assert {t: (tp[t], fp[t], fn[t]) for t in set(tp) | set(fp) | set(fn)} == _relaxed(a, b)
    assert _relaxed(*rows[-1][1:]) == {"NAMA": (1, 1, 0)}


def test_kappa_and_ac1_by_hand(spark):
    a = ["B-NIK"] * 40 + ["O"] * 60
    b = ["B-NIK"] * 30 + ["O"] * 10 + ["B-NIK"] * 5 + ["O"] * 55
    cells = agreement.confusion_cells(spark.createDataFrame([(a, b)], "labels_a array<string>, labels_b array<string>"))
    binary = {r["entity"]: r for r in agreement.cohen_kappa_by_entity(cells).collect()}
    po, pe = 0.85, 0.4 * 0.35 + 0.6 * 0.65
    assert binary["NIK"]["kappa"] == round((po - pe) / (1 - pe), 4)
    assert binary["NAMA"]["kappa"] == 1.0
    pi = 0.375
    chance = 2 * pi * (1 - pi)
    overall = agreement.gwet_ac1(cells).first()
    assert overall["ac1"] == round((po - chance) / (1 - chance), 4)
    assert overall["ci_low"] < overall["ac1"] < overall["ci_high"]
    assert {r["entity"]: r["ac1"] for r in agreement.gwet_ac1_by_entity(cells).collect()}["NIK"] == overall["ac1"]


def test_kappa_with_fewer_than_two_pairs(spark):
    cells = agreement.confusion_cells(spark.createDataFrame([(["O", "B-NIK"], ["O", "O"])], "labels_a array<string>, labels_b array<string>"))
    r = agreement.cohen_kappa(cells).first()
    assert (r["kappa"], r["agreement"], r["n_tokens"]) == (0.0, 0.0, 0)


def test_spans_to_bio_as_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for i in range(200):
        text = "".join(rng.choice("ab1, +é_📧") for _ in range(rng.randint(0, 30)))
        spans = []
        for _ in range(rng.randint(0, 4)):
            s = rng.randint(0, 30)
            spans.append({"start": s, "end": s + rng.randint(0, 8), "labels": [rng.choice(["NIK", "NAMA"])] if rng.random() < 0.9 else []})
        rows.append((i, text, spans))

    def plain(text, spans):
        marks = [(m.start(), m.end()) for m in TOKENS.finditer(text)]
        labels = ["O"] * len(marks)
        for s in sorted(spans, key=lambda s: s["start"]):
            if not s["labels"]:
                continue
            inside = [i for i, (a, b) in enumerate(marks) if b > s["start"] and a < s["end"]]
            for j, i in enumerate(inside):
                labels[i] = ("I-" if j else "B-") + s["labels"][0]
        return marks, labels

    df = spark.createDataFrame(rows, "id int, text string, spans array<struct<start:int,end:int,labels:array<string>>>")
    got = agreement.tokenize_with_offsets(agreement.spans_to_bio(df)).orderBy("id").collect()
    for r, (_, text, spans) in zip(got, rows):
        marks, labels = plain(text, spans)
        assert [tuple(o) for o in r["offsets"]] == marks
        assert r["labels"] == labels


# --- splits, joins, skew ---------------------------------------------------------------------


@pytest.mark.parametrize("digits", [1, 4])
def test_stratified_split_is_exact_with_a_dominant_stratum(spark, digits):
    df = spark.range(3000).select(
        F.col("id").alias("sample_id"), F.when(F.col("id") % 10 < 8, "json").when(F.col("id") % 10 < 9, "form").otherwise(F.format_string("f%d", F.col("id") % 7)).alias("format")
    )
    sizes = Counter(r["format"] for r in df.collect())
    got = Counter((r["format"], r["split"]) for r in split.stratified_split(df, digits=digits).collect())
    for fmt, n in sizes.items():
        train, rest = math.floor(n * 0.8 + 0.5), math.floor(n * 0.9 + 0.5)
        assert (got[fmt, "train"], got[fmt, "val"], got[fmt, "test"]) == (train, rest - train, n - rest)
    kept = Counter(r["format"] for r in split.stratified_sample(df, 0.2, digits=digits).collect())
    assert kept == Counter({f: math.floor(n * 0.2 + 0.5) for f, n in sizes.items() if math.floor(n * 0.2 + 0.5)})


def test_lookup_join_keeps_all_rows_of_a_hot_key(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 900)).alias("key"), "id")
    table = spark.createDataFrame([("hot", 1), ("k1", 2), ("none", 3)], "key string, v int")
    got = common.lookup_join(rows, table, "key", hot_share=0.1)
    want = rows.join(table, "key", "left")
    assert got.count() == 5000
    assert got.exceptAll(want.select(*got.columns)).count() == 0


def test_feature_paths_agree(spark):
    df = spark.createDataFrame(
        [(0, '{"nik" : "3274635212890001", "order": 5}'), (1, "Kepala Dinas Rina HP: 081234567890"), (2, ""), (3, "invoice 081234567890 NIK = 3201013102011234")],
        "sample_id bigint, text string",
    ).withColumn("tokens", tokenize("text"))
    terms = gazetteer.seed_terms(spark).union(
        spark.createDataFrame([("jabatan_phrases", "kepala dinas"), ("jabatan_tokens", "dinas"), ("nama_prefixes", "rina")], "c string, t string")
    )
    small = features.token_features(df, terms).orderBy("sample_id").collect()
    terms = terms.union(spark.createDataFrame([("negative_keywords", "kupon")], "c string, t string"))
    df = df.union(spark.createDataFrame([(4, "kupon 3274635212890001 false", ["kupon", "3274635212890001", "false"])], df.schema))
    small = features.token_features(df, terms).orderBy("sample_id").collect()
    joined = features.token_features(df, terms, small_terms=0, trie_bytes=0)
    swept = features.token_features(df, terms, small_terms=0)
    assert [r["features"] for r in swept.orderBy("sample_id").collect()] == [r["features"] for r in small]
    assert small[4]["features"][1]["nik_has_negative_context"]
    assert [r["features"] for r in joined.orderBy("sample_id").collect()] == [r["features"] for r in small]
    f = small[1]["features"]
    assert f[0]["bigram_jabatan"] and f[1]["in_jabatan_dict"] and f[2]["in_nama_dict"] and not f[3]["bigram_jabatan"]
    assert f[5]["has_phone_label_context"] and f[5]["phone_valid_prefix"] and not f[5]["phone_has_negative_context"]
    assert f[5]["in_form_field_position"] and f[0]["bos"] and f[5]["eos"] and f[1]["m2_lower"] is None
    g = small[3]["features"]
    assert g[1]["phone_has_negative_context"] and g[4]["nik_structure_complete"] and g[4]["nik_has_negative_context"]
    assert small[2]["features"] == []
    assert len(f[0]) == 47


@pytest.mark.parametrize("trie_bytes", [0, 1 << 20])
def test_keyword_lists_of_any_size(spark, monkeypatch, trie_bytes):
    df = spark.createDataFrame([(0, ["Kupon-1", "3274635212890001", "x"]), (1, ["ku-pon", "081234567890"]), (2, ["kup", "3274635212890001"]), (3, ["3274635212890001", "ku", "é"])], "sample_id int, tokens array<string>")
    terms = spark.createDataFrame([("negative_keywords", k) for k in ("kupon", "é", "zzz")] + [("nama_prefixes", "ku")], "category string, term string")
    want = [r["features"] for r in features.token_features(df, terms).orderBy("sample_id").collect()]
    monkeypatch.setattr(gazetteer, "SMALL_TERMS", 2)  # three keywords are too many for a plan
    got = [r["features"] for r in features.token_features(df, terms, small_terms=0, trie_bytes=trie_bytes).orderBy("sample_id").collect()]
    assert got == want
    assert [r[1]["nik_has_negative_context"] or r[1]["phone_has_negative_context"] for r in want[:3]] == [True, True, False] and want[3][0]["nik_has_negative_context"]


def test_trie_finds_terms_of_any_length(spark):
    rng = random.Random(11)
    words = "abcd"
    terms = {(rng.choice("xyz"), " ".join(rng.choice(words) for _ in range(rng.randint(1, 5)))) for _ in range(60)}
    rows = [(i, [rng.choice(words + "e") for _ in range(rng.randint(0, 15))]) for i in range(80)] + [(90, None)]
    df = spark.createDataFrame(rows, "id int, tokens array<string>")
    out = trie.term_matches(df, spark.createDataFrame(sorted(terms), "category string, term string"))
    for r in out.collect():
        t = r["tokens"] or []
        want = sorted((i, n, c) for c, term in terms for n in [len(term.split())] for i in range(len(t) - n + 1) if " ".join(t[i : i + n]) == term)
        assert [(x["start"], x["length"], x["category"]) for x in r["terms"] or []] == want
    none = trie.term_matches(df, spark.createDataFrame([], "category string, term string"))
    assert all(not r["terms"] for r in none.collect())


def test_chosen_features_equal_all_features(spark):
    df = spark.createDataFrame([(0, ["NIK", ":", "3274635212890001", "invoice"]), (1, []), (2, ["HP", "081234567890"])], "sample_id int, tokens array<string>")
    names = ["nik_structure_complete", "has_nik_label_context", "in_form_field_position", "phone_valid_prefix", "matches_nik_pattern", "m1_isupper"]
    terms = gazetteer.seed_terms(spark)
    whole = features.token_features(df, terms).orderBy("sample_id").collect()
    some = features.token_features(df, terms, use_gazetteer=False, fields=names).orderBy("sample_id").collect()
    assert [[f.asDict() for f in r["features"]] for r in some] == [[{n: f[n] for n in f.__fields__ if n in names} for f in r["features"]] for r in whole]


def test_context_windows_equal_a_plain_search(spark):
    rng = random.Random(5)
    words = ["nik", "hp", "order", "3274635212890001", "081234567890", "x", "é", ".", ""]
    rows = [(i, [rng.choice(words + ["x"] * 12) for _ in range(i)]) for i in range(45)] + [(90, None)]
    df = spark.createDataFrame(rows, "sample_id int, tokens array<string>")
    terms = {"nik_labels": ["nik"], "phone_labels": ["hp"], "negative_keywords": ["order"]}
    for r in features.token_features(df, terms).collect():
        t = r["tokens"]
        near = lambda w, i, after: w in t[max(i - 10, 0) : i] or (after and w in t[i + 1 : i + 11])
        for i, f in enumerate(r["features"] or []):
            assert f["has_nik_label_context"] == near("nik", i, False) and f["has_phone_label_context"] == near("hp", i, False)
            assert f["nik_has_negative_context"] == (t[i] == words[3] and near("order", i, True))
            assert f["phone_has_negative_context"] == (t[i] == words[4] and near("order", i, True))
            assert (f["m2_lower"], f["p2_lower"]) == (t[i - 2] if i > 1 else None, t[i + 2] if i + 2 < len(t) else None)
            assert (f["bos"], f["eos"]) == (i == 0, i == len(t) - 1)
        assert len(r["features"] or []) == len(t or []) and (r["features"] is None) == (t is None)


def test_null_tokens_keep_their_places(spark):
    df = spark.createDataFrame([(1, ["a", "nik", None, "B"])], "sample_id int, tokens array<string>")
    f = features.token_features(df).first()["features"]
    assert [x["word_identity"] for x in f] == ["a", "nik", None, "B"]
    assert len(features.token_features(df, fields=["word_lower"]).first()["features"]) == 4


def test_long_features_are_made_by_compiled_code(spark):
    df = features.token_features(spark.createDataFrame([(7, ["Rina", "9"])], "sample_id int, tokens array<string>"))
    long = features.long_features(df)
    rows = {(r["sample_id"], r["pos"], r["name"]): r["value"] for r in long.collect()}
    whole = [f.asDict() for f in df.first()["features"]]
    text = lambda v: str(v).lower() if isinstance(v, bool) else str(v)
    assert rows == {(7, i, n): text(v) for i, f in enumerate(whole) for n, v in f.items() if v is not None}
    plan = long._jdf.queryExecution().executedPlan().toString()
    assert "map(" not in plan and plan.count("Generate ") == 2


def test_samples_are_mined_once(spark):
    df = spark.createDataFrame([(0, ["Rina", "di"], ["B-NAMA", "O"])], "sample_id long, tokens array<string>, labels array<string>")
    found = gazetteer.build_gazetteer(df)
    assert ("nama_prefixes", "rina") in {(r["category"], r["term"]) for r in found.collect()}
    assert "sample_id" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_tables_are_dealt_by_rows(spark, tmp_path, monkeypatch):
    from tagmill.plans import base

    spark.range(300).coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    assert base.table(spark, str(tmp_path), "customer").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(base, "COUNTED_BYTES", 1)
    monkeypatch.setattr(base, "TASK_ROWS", 20)
    dealt = base.table(spark, str(tmp_path), "customer")
    assert dealt.rdd.getNumPartitions() == 15 and dealt.count() == 300


def test_throughput_counts_what_it_scores(spark):
    df = spark.createDataFrame([(i, ["a"] * (i % 4)) for i in range(50)], "id int, tokens array<string>")
    got = throughput.score_throughput(df, lambda d: d.select(F.reverse("tokens")), F.size("tokens"), runs=1)
    assert (got["rows"], got["tokens"]) == (50, 73) and got["rows_per_s"] > 0 and got["task_ms_per_row"] >= 0


def test_first_names_keep_the_limit_and_the_order_of_ties(spark):
    rows, seen = [], {}
    for i in range(900):
        name = f"N{'abcdefghij'[i * 7 % 10]}{'abcdefghij'[i * 3 % 7]}{'abcdefghij'[i % 9]}"
        rows.append((i, [name, "di"], ["B-NAMA", "O"]))
        n, first = seen.get(name.lower(), (0, i))
        seen[name.lower()] = (n + 1, first)
    df = spark.createDataFrame(rows, "sample_id long, tokens array<string>, labels array<string>")
    want = sorted(((t, n) for t, (n, _) in seen.items()), key=lambda x: (-x[1], seen[x[0]][1]))
    for limit in (5, 500):
        got = [(r["term"], r["n"]) for r in gazetteer.top_terms(gazetteer.mine_counts(df), "nama_prefixes", limit).collect()]
        assert sorted(got) == sorted(want[:limit])


def test_linear_tagger_learns_and_scores_alike_on_both_paths(spark):
    rows = [(i, f"Nama : {n} NIK : {1000000000000000 + i}", {"nama": n, "nik": str(1000000000000000 + i)}) for i, n in enumerate(["Rina Sari", "Budi Putra", "Agus Wijaya"] * 8)]
    df = labeling.label_samples(
        spark.createDataFrame([(i, p, "narrative", d) for i, p, d in rows], f"sample_id bigint, payload string, format string, pii_data {PII}")
    )
    feats = features.token_features(df)
    weights = linear.fit_linear_tagger(feats, max_iter=20)
    small = {r["sample_id"]: (r["labels"], r["pred"]) for r in linear.tag_linear(feats, weights).collect()}
    joined = {r["sample_id"]: r["pred"] for r in linear.tag_linear(feats, weights, model_bytes=3).collect()}
    assert all(a == b for a, b in small.values())
    assert joined == {k: v[1] for k, v in small.items()}
    twice = feats.withColumn("sample_id", F.col("sample_id") % 2)  # ids may repeat
    again = lambda **k: sorted((r["tokens"], r["pred"]) for r in linear.tag_linear(twice, weights, **k).collect())
    assert again() == again(model_bytes=3) == sorted((r["tokens"], small[r["sample_id"]][1]) for r in feats.collect())
    assert linear.fit_linear_tagger(feats, max_iter=1, shard_tokens=7)["state"].count() > 0
    top = linear.top_weights(weights["state"], 5).collect()
    assert len(top) == 5 and abs(top[0]["weight"]) >= abs(top[4]["weight"])


# --- logs and masking ------------------------------------------------------------------------

BLOCK = (
    "=" * 50
    + '\nIntercepted: POST /api/data\nOriginal body: {"nik":"3274635212890001","note":"1234567890123456"}\n'
    + "- NIK: 3274635212890001 -> 327463XXXXXXXXXX\nTotal 1 masked | Time: 8.23 ms\n"
)


def test_log_block(spark):
    df = spark.createDataFrame([(BLOCK * 2 + "=" * 60 + "\nnoise",)], "value string")
    rows = logs.parse_blocks(logs.split_blocks(df)).collect()
    assert len(rows) == 2
    assert sorted(rows[0]["original_ids"]) == ["1234567890123456", "3274635212890001"]
    assert rows[0]["detected_ids"] == ["3274635212890001"] and rows[0]["masked"] and rows[0]["latency_ms"] == 8.23


def test_log_substring_takes_the_first_place_only(spark):
    nik = "3274635212890001"
    texts = [(0, f"seen {nik} " + "x" * 150 + f" masked {nik}"), (1, "detected 9" + nik + "7 y")]
    df = spark.createDataFrame(texts, "id int, value string")
    expected = spark.createDataFrame([(nik,), ("9" + nik[:15],), ("0" * 16,)], "nik string")
    got = {r["nik"]: r["hit"] for r in logs.log_substring_hits(df, expected, "id").collect()}
    assert got == {nik: False, "9" + nik[:15]: True, "0" * 16: False}


def test_mask_entities(spark):
    df = spark.createDataFrame([(0, "NIK 3274635212890001, HP 081234567890 (Rina)", "narrative")], "sample_id bigint, payload string, format string")
    df = df.withColumn("labels", tag_regex(tokenize("payload")))
    assert masking.mask_entities(df).first()["masked"] == "NIK 327463XXXXXXXXXX, HP 0812XXXXXX90 (Rina)"


def test_annotator_roles(spark):
    df = spark.createDataFrame([("a@x", "1"), ("z", "2"), ("b@x", "3"), ("q", "9")], "email string, uid string")
    got = [r[0] for r in df.select(agreement.role_of_annotator("email", "uid", "a@x", "2")).collect()]
    assert got == ["A", "B", None, None]


def test_long_expected_lists_give_the_same_log_metrics(spark, monkeypatch):
    nik = lambda i: f"32746352128{i:05d}"
    block = "=" * 50 + '\nIntercepted: POST\nOriginal body: {{"nik":"{0}"}}\n{1}Time: 2.0 ms\n'
    rows = [(i, block.format(nik(0 if i % 3 == 0 else i), f"- NIK: {nik(i)} -> 327XXX\n" if i % 2 else "")) for i in range(60)]
    parsed = logs.parse_blocks(logs.split_blocks(spark.createDataFrame(rows, "log_id int, value string")))
    expected = spark.createDataFrame([(nik(i),) for i in range(0, 80, 2)], "nik string")
    keys = ["log_id", "block_no"]
    short = logs.log_detection_metrics(parsed, expected, keys).first()
    per = sorted(map(tuple, logs.per_request_detection(parsed, expected, keys).collect()))
    monkeypatch.setattr(logs, "small_rows", lambda *a: None)
    monkeypatch.setattr(common, "SMALL_ROWS", 1)
    assert logs.log_detection_metrics(parsed, expected, keys).first() == short
    assert sorted(map(tuple, logs.per_request_detection(parsed, expected, keys).collect())) == per
    hits = logs.log_substring_hits(spark.createDataFrame(rows, "log_id int, value string"), expected, "log_id")
    assert hits.count() == 40


def test_split_with_many_strata_gives_the_same_rows(spark, monkeypatch):
    df = spark.range(500).select(F.col("id").alias("sample_id"), F.when(F.col("id") % 2 == 0, "big").otherwise(F.concat(F.lit("f"), F.col("id") % 40)).alias("format"))
    small = {r["sample_id"]: r["split"] for r in split.stratified_split(df).collect()}
    monkeypatch.setattr(common, "SMALL_ROWS", 1)
    assert {r["sample_id"]: r["split"] for r in split.stratified_split(df).collect()} == small
