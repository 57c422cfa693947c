"""Chain training, sparse model tables, exact selection, side-by-side taggers, span labels."""

import itertools
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagmill.operators import agreement, chain, compare, features, hmm, linear, selection, sparse, taggers


# --- chain training --------------------------------------------------------------------------


def random_shard(seed, k=3, features=7):
    rng = np.random.default_rng(seed)
    lengths = np.array([3, 1, 4, 2, 0, 3])
    n = int(lengths.sum())
    sizes = rng.integers(1, 4, n)
    local = rng.integers(k, k + features, int(sizes.sum()))
    return lengths, rng.integers(0, k, n), sizes, local, rng.normal(size=(k + features, k))


def brute_loss(lengths, y, sizes, local, w):
    k, first, total = w.shape[1], 0, 0.0
    begin = np.cumsum(sizes) - sizes
    unary = np.array([w[local[b : b + s]].sum(0) for b, s in zip(begin, sizes)])
    for n in lengths:
        if n:
            score = lambda p: sum(unary[first + i, p[i]] for i in range(n)) + sum(w[p[i], p[i + 1]] for i in range(n - 1))
            total += np.log(sum(np.exp(score(p)) for p in itertools.product(range(k), repeat=int(n)))) - score(y[first : first + n])
        first += n
    return total


@pytest.mark.parametrize("seed", [1, 2])
def test_log_partition_and_gradient(seed):
    shard = random_shard(seed)
    value, gradient = chain.shard_objective(*shard)
    assert value == pytest.approx(brute_loss(*shard))
    w = shard[-1]
    for at in np.ndindex(w.shape):
        up, down = w.copy(), w.copy()
        up[at] += 1e-5
        down[at] -= 1e-5
        assert gradient[at] == pytest.approx((brute_loss(*shard[:-1], up) - brute_loss(*shard[:-1], down)) / 2e-5, abs=1e-6)


def test_direction_is_the_two_loop_recursion():
    rng = np.random.default_rng(3)
    s, y, g = rng.normal(size=(4, 12)), None, rng.normal(size=12)
    y = s @ np.diag(rng.uniform(0.5, 2, 12))
    q, alpha = g.copy(), []
    for a, b in zip(s[::-1], y[::-1]):
        alpha.append(a @ q / (a @ b))
        q -= alpha[-1] * b
    q *= s[-1] @ y[-1] / (y[-1] @ y[-1])
    for a, b, al in zip(s, y, alpha[::-1]):
        q += a * (al - b @ q / (a @ b))
    basis = np.vstack([s, y, g[None]])
    assert np.allclose(chain.direction(basis @ basis.T) @ basis, -q)


def test_pseudo_gradient_of_zero_weights():
    got = chain.pseudo_gradient(np.array([0.0, 0.0, 0.0, 1.0, -1.0]), np.array([0.5, -0.5, 0.05, 0.2, 0.2]), 0.1)
    assert np.allclose(got, [0.4, -0.4, 0.0, 0.3, 0.1])


def test_fit_reaches_the_minimum_whatever_the_shards(spark):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        words = [rng.choice("abc") for _ in range(rng.randint(1, 6))]
        rows.append((i, [[f"w={w}", "bias"] for w in words], ["X" if w == "a" or (j and words[j - 1] == "a") else "O" for j, w in enumerate(words)]))
    rows += [(90, [], []), (91, None, None), (92, [["w=a"]], None), (93, [["w=a"]], ["X", "O"])]  # left out
    df = spark.createDataFrame(rows, "id int, words array<array<string>>, labels array<string>")
    fits = [chain.fit_chain(df, F.col("words"), 0.05, 0.1, max_iter=10, shard_tokens=s) for s in (9, 1000)]
    for a, b in zip(fits[0]["losses"], fits[0]["losses"][1:]):
        assert b <= a
    assert fits[0]["losses"][-1] == pytest.approx(fits[1]["losses"][-1], rel=1e-4) and fits[0]["losses"][-1] < 0.5 * fits[0]["losses"][0]
    weights = {(r.feature, r.state): r.weight for r in fits[0]["state"].collect()}
    trans = {(r.prev, r.state): r.weight for r in fits[0]["trans"].collect()}
    assert set(trans) == {(a, b) for a in "OX" for b in "OX"} and weights[("w=a", "X")] > 0 > weights[("w=a", "O")]
    assert trans[("O", "X")] < trans[("X", "X")]  # an X after an O comes from its word alone
    none = chain.fit_chain(df.limit(0), F.col("words"))
    assert none["state"].count() == none["trans"].count() == 0


def test_a_step_takes_few_jobs_and_blocks_change_nothing(spark, monkeypatch):
    rng = random.Random(12)
    rows = [([[f"w={rng.randint(0, 40)}", f"v={rng.randint(0, 5)}", "bias"] for _ in range(rng.randint(1, 7))],) for _ in range(80)]
    rows = [(w, ["X" if int(t[0][2:]) % 3 else rng.choice("OY") for t in w]) for (w,) in rows]
    df = spark.createDataFrame(rows, "words array<array<string>>, labels array<string>")

    def fit(steps):
        spark.sparkContext.setJobGroup(f"fit {steps}", "")
        out = chain.fit_chain(df, F.col("words"), 0.05, 0.1, max_iter=steps, shard_tokens=50, period=100)
        assert len(out["losses"]) == steps + 1
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fit {steps}"))

    try:
        (_, few), (out, more) = fit(2), fit(10)
        monkeypatch.setattr(chain, "BLOCK_FEATURES", 1, raising=False)
        small, _ = fit(9)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert more - few <= 8 * 12  # writing, reading back and joining each vector took more than 20 a step
    assert np.allclose(small["losses"], out["losses"][:10], rtol=1e-8)


def test_packing_computes_features_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.arrow_udf("array<array<string>>")
    def words(w: pa.Array) -> pa.Array:
        calls.add(len(w))
        return w

    rows = [([["a", "b"], ["c"]], ["O", "B"])] * 5 + [([["a"]], ["O", "B"]), ([], []), (None, None)]
    df = spark.createDataFrame(rows, "w array<array<string>>, labels array<string>").coalesce(1)
    shards, n = chain._pack(df, words("w"), ["B", "O"], 100)
    assert (n, shards.agg(F.sum(F.size("lengths"))).first()[0]) == (1, 5)
    assert calls.value == len(rows)


# --- sparse model tables ---------------------------------------------------------------------


def test_sparse_rows_stay_small_with_many_states():
    rng = np.random.default_rng(5)
    n, states = 300_000, 200
    keys = rng.integers(-(2**62), 2**62, n)
    table = sparse.SparseRows.of(keys, rng.integers(0, states, n), rng.normal(size=n))
    assert table.nbytes <= n * sparse.ENTRY_BYTES + 8  # a dense one takes 480 MB
    start, trans, default = np.zeros(states), rng.normal(size=(states, states)), np.full(states, -20.0)
    lengths = np.full(2000, 30)
    flat = rng.choice(keys, int(lengths.sum()))
    tracemalloc.start()
    out = hmm.decode(lambda a, b: table.replaced(flat[a:b], default), lengths, start, trans, [f"s{i}" for i in range(states)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 2000 and peak < 150e6


def test_sparse_rows_equal_a_dense_table():
    rng = np.random.default_rng(6)
    keys, states = rng.integers(-5, 5, 40), np.arange(40) % 4
    pairs = {(int(k), int(s)): float(v) for k, s, v in zip(keys, states, rng.normal(size=40))}
    table = sparse.SparseRows.of(np.array([k for k, _ in pairs]), np.array([s for _, s in pairs]), np.array(list(pairs.values())))
    hashes, default = rng.integers(-8, 8, 50), rng.normal(size=4)
    want = [[pairs.get((int(h), s), default[s]) for s in range(4)] for h in hashes]
    assert np.allclose(table.replaced(hashes, default), want)
    owner = np.sort(rng.integers(0, 10, 50))
    sums = [[default[s] + sum(pairs.get((int(h), s), 0) for h, o in zip(hashes, owner) if o == i) for s in range(4)] for i in range(10)]
    assert np.allclose(table.summed(hashes, owner, 10, default), sums)
    none = sparse.SparseRows.of(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    assert np.allclose(none.replaced(hashes[:2], default), [default, default]) and none.replaced(hashes[:0], default).shape == (0, 4)


def test_one_pass_equals_each_tagger(spark):
    rng = random.Random(7)
    rows = [(i, [rng.choice(["Rina", "di", "NIK", "3274635212890001", "Kota"]) for _ in range(rng.randint(0, 8))]) for i in range(40)]
    rows = [(i, t, [rng.choice(["O", "B-NAMA", "I-NAMA"]) for _ in t]) for i, t in rows]
    df = spark.createDataFrame(rows, "sample_id int, tokens array<string>, labels array<string>")
    plain, hybrid = hmm.fit_hmm(df), hmm.fit_hmm(df, hybrid=True)
    both = taggers.predict_models(df, {"a": taggers.hmm_model(plain), "b": taggers.hmm_model(hybrid, hybrid=True)})
    got = {r.sample_id: (r.pred_a, r.pred_b) for r in both.collect()}
    assert {i: p[0] for i, p in got.items()} == {r.sample_id: r.pred for r in hmm.tag_hmm(df, plain).collect()}
    assert {i: p[1] for i, p in got.items()} == {r.sample_id: r.pred for r in hmm.tag_hmm(df, hybrid, hybrid=True).collect()}
    long = taggers.long_predictions(both, ["a", "b"], ["sample_id", "labels"])
    assert long.count() == 80
    right = compare.right_side_by_side(both, ["a", "b"], keep=["sample_id"])
    wide = compare.mcnemar_side_by_side(right, [("a", "b")]).collect()
    assert wide == compare.mcnemar_table(compare.correctness(long), [("a", "b")]).collect()
    with pytest.raises(ValueError, match="too large"):
        taggers.hmm_model(plain, model_bytes=30)


# --- exact selection -------------------------------------------------------------------------


def test_percentiles_equal_numpy(spark):
    rng = random.Random(8)
    rows = [("a", rng.gauss(0, 1e3)) for _ in range(500)] + [("b", float(rng.randint(-2, 2))) for _ in range(301)] + [("c", 7.5), (None, 1.0), (None, 2.0), ("a", None), ("d", None)]
    rows += [("e", x) for x in (-0.0, 0.0, 1e-300, -1e300, 1e300, 5e-324, float("inf"), float("-inf"))]
    df = spark.createDataFrame(rows, "g string, v double")
    points = {"p0": 0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    out = selection.percentiles(df, "v", points, ["g"])
    got = {r.g: r for r in out.collect()}
    assert set(got) == {"a", "b", "c", None, "e"}
    for g in ("a", "b", "c", None):
        v = np.array([x for k, x in rows if k == g and x is not None])
        assert got[g].n == len(v) and got[g].min == v.min() and got[g].mean == pytest.approx(v.mean())
        for name, p in points.items():
            assert got[g][name] == pytest.approx(np.percentile(v, 100 * p), rel=1e-12, abs=1e-12)
    assert got["e"].p0 == float("-inf") and got["e"].p100 == float("inf") and got["e"].p50 == pytest.approx(0)
    one = selection.percentiles(df.where("g = 'c'"), "v", {"p50": 0.5}).collect()
    assert [(r.n, r.p50) for r in one] == [(1, 7.5)]
    assert selection.percentiles(df.limit(0), "v", points, ["g"]).collect() == []
    plan = out._jdf.queryExecution().toString().lower()
    assert "percentile(" not in plan and "collect_list" not in plan


def test_order_bits_keep_the_order():
    values = np.array([-np.inf, -1e300, -1.5, -5e-324, -0.0, 0.0, 5e-324, 1.5, 1e300, np.inf, np.nan])
    bits = selection.order_bits(values)
    assert (np.diff(bits) >= 0).all() and bits[4] == bits[5] and (np.diff(np.delete(bits, 4)) > 0).all()


# --- span labels -----------------------------------------------------------------------------


def plain_labels(bounds, spans):
    labels = ["O"] * len(bounds)
    usable = [s for s in spans or [] if s["labels"] and s["start"] is not None and s["end"] is not None]
    for s in sorted(usable, key=lambda x: x["start"]):
        own = [i for i, (a, b) in enumerate(bounds) if b > s["start"] and a < s["end"]]
        for n, i in enumerate(own):
            labels[i] = ("I-" if n else "B-") + s["labels"][0]
    return labels


def test_span_labels_equal_plain_version():
    rng = random.Random(9)
    tokens, gaps, spans, want = [], [], [], []
    for _ in range(300):
        t = [rng.randint(1, 4) for _ in range(rng.randint(0, 6))]
        g = [rng.randint(0, 2) for _ in range(len(t) + 1)]
        found = [
            {"start": rng.choice([None, *range(12)]), "end": rng.choice([None, *range(25)]), "text": "", "labels": rng.choice([None, [], ["A"], ["B", "C"]])}
            for _ in range(rng.randint(0, 4))
        ]
        bounds, at = [], 0
        for n, size in enumerate(t):
            at += g[n]
            bounds.append((at, at + size))
            at += size
        tokens.append(t)
        gaps.append(g)
        spans.append(rng.choice([found, found, found, None]))
        want.append(plain_labels(bounds, spans[-1]))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("labels", pa.list_(pa.string()))]))
    got = agreement._span_labels(pa.array(tokens, pa.list_(pa.int32())), pa.array(gaps, pa.list_(pa.int32())), pa.array(spans, kind))
    assert got.to_pylist() == want


def test_models_beyond_the_limit_are_joined(spark):
    rows = [(i % 7, ["Kota", f"n{i}", "0811", "di"], ["B", "I", "O", "O"]) for i in range(12)] + [(3, [], []), (3, ["di", "x9"], ["O", "B"])]
    df = spark.createDataFrame(rows, "sample_id long, tokens array<string>, labels array<string>")
    counts = {h: hmm.hmm_counts(df, h) for h in (False, True)}
    trans = hmm.fit_hmm(None, counts=counts[False])["trans"].select("prev", "state", F.col("logp").alias("weight"))
    weights = counts[False].where("kind = 'emission'").select(F.concat(F.lit("word_lower="), "token").alias("feature"), "state", F.log(F.col("n") + 1).alias("weight"))
    tables = {"hmm": hmm.fit_hmm(None, counts=counts[False]), "hybrid_hmm": hmm.fit_hmm(None, hybrid=True, counts=counts[True])}
    tables |= {"linear": {"state": weights, "trans": trans}, "other": {"state": weights.where("state = 'O'"), "trans": trans}}
    featured = features.token_features(df, use_regex=False, use_gazetteer=False)
    names = ["sample_id", "tokens", *[f"pred_{n}" for n in tables]]
    # everything in one pass, everything joined, and some of each kind
    found = [sorted(map(str, taggers.predict_fitted(featured, tables, model_bytes=b).select(*names).collect())) for b in (1 << 20, 3, 12 * sparse.ENTRY_BYTES)]
    assert len(found[0]) == len(rows) and found[0] == found[1] == found[2]
    plan = linear.weighted_features(weights, featured)
    seen = featured.select(F.explode(F.flatten(plan)).alias("f")).where("not startswith(f, 'word_lower=')")
    assert seen.count() == 0  # features that no weight names are not made
