"""Queries that compare the pattern, hidden Markov, hybrid and linear taggers, all fitted on the main set."""

from pyspark.sql import DataFrame, functions as F

from ..functions.fixed import ENTITY_TYPES
from ..functions.labels import tag_regex
from ..operators import compare, features, hmm, metrics, taggers
from ..operators.common import materialize
from . import base, model_queries, sqlbase as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
MODELS = ["regex", "hmm", "hybrid_hmm", "linear"]
PAIRS = [(a, b) for i, a in enumerate(MODELS) for b in MODELS[i + 1 :]]


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# --- the taggers in SQL ----------------------------------------------------------------------

_FOLDED = "CASE WHEN regexp_matches(w, '^\\p{Nd}{16}$') THEN '<__NIK_PATTERN__>' WHEN regexp_matches(w, '^(\\+62|0)\\p{Nd}{8,12}$') THEN '<__PHONE_PATTERN__>' ELSE lower(w) END"


def _seen(src: str, cols: str) -> str:
    """What each chain model sees of the tokens of ``src``; the linear one has the plain words."""
    return f"SELECT 'hmm' AS model, {cols}, lower(w) AS o FROM {src} UNION ALL SELECT 'hybrid_hmm', {cols}, {_FOLDED} FROM {src}"


FITTED = [
    S.people(), S.samples("main"), S.tagged(), model_queries._TOK,
    f"""ob AS ({_seen('prevs', 'pos, l, pl')}),
st AS (SELECT model, l AS state, count(*) AS total FROM ob GROUP BY ALL), kk AS (SELECT model, count(*) AS k FROM st GROUP BY model),
vv AS (SELECT model, count(DISTINCT o) + 1 AS v FROM ob GROUP BY model),
hs AS (SELECT model, state, ln((coalesce(n, 0) + 1.0) / (sum(coalesce(n, 0)) OVER (PARTITION BY model) + k)) AS logp
  FROM st JOIN kk USING (model) LEFT JOIN (SELECT model, l AS state, count(*) AS n FROM ob WHERE pos = 0 GROUP BY ALL) USING (model, state)),
ht AS (SELECT model, prev, state, ln((coalesce(n, 0) + 1.0) / (sum(coalesce(n, 0)) OVER (PARTITION BY model, prev) + k)) AS logp
  FROM (SELECT a.model, a.state AS prev, b.state FROM st a JOIN st b USING (model)) JOIN kk USING (model)
  LEFT JOIN (SELECT model, pl AS prev, l AS state, count(*) AS n FROM ob WHERE pl IS NOT NULL GROUP BY ALL) USING (model, prev, state)),
em AS (SELECT model, state, o, ln((n + 1.0) / (total + v)) AS e FROM (SELECT model, l AS state, o, count(*) AS n FROM ob GROUP BY ALL) JOIN st USING (model, state) JOIN vv USING (model)
  UNION ALL SELECT 'linear', l, o, round(ln(count(*) + 1), 6) FROM ob WHERE model = 'hmm' GROUP BY l, o),
un AS (SELECT model, state, ln(1.0 / (total + v)) AS e FROM st JOIN vv USING (model) UNION ALL SELECT 'linear', state, 0.0 FROM st WHERE model = 'hmm'),
ts AS (SELECT * FROM hs UNION ALL SELECT 'linear', state, 0.0 FROM st WHERE model = 'hmm'),
tt AS (SELECT * FROM ht UNION ALL SELECT 'linear', prev, state, round(logp, 6) FROM ht WHERE model = 'hmm')""",
]


def scored(set_name: str, x: str = "") -> list[str]:
    """``models{x}``: samples of a set with every model's labels in ``pred``."""
    goal = "tagged" if set_name == "main" else f"goal{x}"
    own = [] if set_name == "main" else [S.samples(set_name, f"set{x}"), S.tagged(f"set{x}", goal)]
    return [
        *own,
        f"""gw{x} AS (SELECT sample_id, unnest(tokens) AS w, generate_subscripts(tokens, 1) - 1 AS pos FROM {goal}),
go{x} AS ({_seen(f'gw{x}', 'sample_id, pos')} UNION ALL SELECT 'linear', sample_id, pos, lower(w) FROM gw{x}),
ge{x} AS (SELECT go.model, sample_id, pos, un.state, coalesce(em.e, un.e) AS e FROM go{x} go JOIN un ON un.model = go.model LEFT JOIN em ON em.model = go.model AND em.state = un.state AND em.o = go.o),
vit{x} AS (SELECT model, sample_id, pos, state, logp + e AS score, [state] AS path FROM ge{x} JOIN ts USING (model, state) WHERE pos = 0
  UNION ALL SELECT model, sample_id, pos, state, score, path FROM (
    SELECT g.model, g.sample_id, g.pos, g.state, v.score + tt.logp + e AS score, list_append(v.path, g.state) AS path,
      row_number() OVER (PARTITION BY g.model, g.sample_id, g.state ORDER BY v.score + tt.logp + e DESC, v.state) AS rn
    FROM vit{x} v JOIN tt ON tt.model = v.model AND tt.prev = v.state JOIN ge{x} g ON g.model = v.model AND g.sample_id = v.sample_id AND g.pos = v.pos + 1 AND g.state = tt.state) WHERE rn = 1),
models{x} AS (SELECT sample_id, category, tokens, labels, 'regex' AS model, {S.REGEX_PRED} AS pred FROM {goal}
  UNION ALL SELECT sample_id, category, tokens, labels, model, path FROM {goal} JOIN (
    SELECT model, sample_id, path, row_number() OVER (PARTITION BY model, sample_id ORDER BY pos DESC, score DESC, state) AS rn FROM vit{x}) USING (sample_id) WHERE rn = 1)""",
    ]


def _measured(set_name: str, x: str = "") -> list[str]:
    return [
        *scored(set_name, x), S.spans(f"models{x}", "sample_id, model", "labels", f"tspan{x}"), S.spans(f"models{x}", "sample_id, model", "pred", f"pspan{x}"),
        S.counts(f"tspan{x}", f"pspan{x}", "sample_id, model", "model", f"cnt{x}"), S.metrics("model", cnt=f"cnt{x}", name=f"metrics{x}"),
    ]


# --- the taggers in Spark --------------------------------------------------------------------


def fitted(spark, sf) -> dict:
    """Tables of all models from two counts of the main set."""
    train = base.tagged(spark, sf)
    counts = {h: materialize(hmm.hmm_counts(train, h)) for h in (False, True)}
    plain = {k: materialize(v) for k, v in hmm.fit_hmm(None, counts=counts[False]).items()}
    hybrid = {k: materialize(v) for k, v in hmm.fit_hmm(None, hybrid=True, counts=counts[True]).items()}
    seen = counts[False].where("kind = 'emission'")
    weights = seen.select(F.concat(F.lit("word_lower="), "token").alias("feature"), "state", F.round(F.log(F.col("n") + 1), 6).alias("weight"))
    trans = plain["trans"].select("prev", "state", F.round("logp", 6).alias("weight"))
    return {"hmm": plain, "hybrid_hmm": hybrid, "linear": {"state": weights, "trans": trans}}


def predicted(spark, sf, set_name: str, tables: dict | None = None) -> DataFrame:
    """A set's samples with the labels of every model side by side (``pred_<model>``), from one pass."""
    tables = tables or fitted(spark, sf)
    df = base.tagged(spark, sf, set_name)
    df = features.token_features(df, use_regex=False, use_gazetteer=False, fields=["word_lower"])  # all that the weights name
    return taggers.predict_fitted(df, tables).withColumn("pred_regex", tag_regex("tokens"))


def long(spark, sf, set_name: str, tables: dict | None = None) -> DataFrame:
    keep = ["sample_id", "category", "tokens", "labels"]
    return taggers.long_predictions(predicted(spark, sf, set_name, tables), MODELS, keep)


def measured(spark, sf, set_name: str, tables: dict | None = None) -> DataFrame:
    return metrics.entity_metrics(long(spark, sf, set_name, tables), ["model"])


# --- queries ---------------------------------------------------------------------------------

_HOLDOUT = S.with_(*FITTED, *_measured("holdout"))


@query("compare_models", _HOLDOUT + "SELECT * FROM metrics")
def compare_models(spark, sf):
    return measured(spark, sf, "holdout")


@query(
    "match_entities",
    S.with_(*FITTED, *scored("hard"), S.spans("models", "sample_id, model", "labels", "tspan"), S.spans("models", "sample_id, model", "pred", "pspan"))
    + """SELECT model, sample_id, count(t) FILTER (p IS NOT NULL) AS tp, count(p) FILTER (t IS NULL) AS fp, count(t) FILTER (p IS NULL) AS fn
FROM (SELECT *, 1 AS t FROM tspan) FULL JOIN (SELECT *, 1 AS p FROM pspan) USING (sample_id, model, type, s, e) GROUP BY model, sample_id""",
)
def match_entities(spark, sf):
    df = metrics.match_entities(long(spark, sf, "hard"))
    sizes = [F.size(c).cast("long").alias(c) for c in ("tp", "fp", "fn")]
    return df.select("model", "sample_id", *sizes).where("tp + fp + fn > 0")


@query(
    "macro_consistency",
    _HOLDOUT
    + """SELECT model, round(sum(f1) FILTER (entity NOT LIKE '\\_%' ESCAPE '\\') / 5, 6) AS mean_f1, max(f1) FILTER (entity = '_macro') AS macro_f1,
  abs(sum(f1) FILTER (entity NOT LIKE '\\_%' ESCAPE '\\') / 5 - max(f1) FILTER (entity = '_macro')) < 1e-4 AS consistent FROM metrics GROUP BY model""",
)
def macro_consistency(spark, sf):
    return metrics.macro_consistency(measured(spark, sf, "holdout"), ["model"])


@query(
    "model_entity_matrix",
    _HOLDOUT
    + "SELECT model, "
    + ", ".join(f"coalesce(max(f1) FILTER (entity = '{t}'), 0) AS {t}" for t in ENTITY_TYPES)
    + ", coalesce(max(f1) FILTER (entity = '_macro'), 0) AS macro FROM metrics GROUP BY model",
)
def model_entity_matrix(spark, sf):
    return compare.model_entity_matrix(measured(spark, sf, "holdout"), ENTITY_TYPES)


_OTHERS = ["regex", "hmm", "linear"]


@query(
    "metric_delta",
    _HOLDOUT
    + ", w AS (SELECT entity, " + ", ".join(f"coalesce(max(f1) FILTER (model = '{m}'), 0) AS {m}" for m in MODELS) + " FROM metrics GROUP BY entity) SELECT entity, hybrid_hmm, "
    + ", ".join(f"round(hybrid_hmm - {m}, 6) AS vs_{m}" for m in _OTHERS) + ", hybrid_hmm >= greatest(hybrid_hmm, regex, hmm, linear) AS best FROM w",
)
def metric_delta(spark, sf):
    return compare.metric_delta(measured(spark, sf, "holdout"), "hybrid_hmm", _OTHERS)


@query("best_model", _HOLDOUT + "SELECT arg_max(model, f1) AS model, max(f1) AS f1 FROM metrics WHERE entity = '_macro'")
def best_model(spark, sf):
    return compare.best_model(measured(spark, sf, "holdout").where("entity = '_macro'"), "f1")


_ROBUST = """r AS (SELECT model, category, count(*) AS total,
  count(*) FILTER (neg AND anyp) AS fp, count(*) FILTER (NOT neg AND hit) AS tp, count(*) FILTER (NOT neg AND NOT hit) AS fn FROM (
  SELECT model, category, list_distinct(labels) = ['O'] AS neg, list_distinct(pred) <> ['O'] AS anyp,
    len(list_filter(range(1, len(labels) + 1), lambda i: labels[i] LIKE 'B-%' AND labels[i] = pred[i])) > 0 AS hit FROM models) GROUP BY ALL),
k AS (SELECT *, CASE WHEN category IN ('context_free_16digit', 'near_pattern') THEN 'FP' ELSE 'TP' END AS kind FROM r),
rr AS (SELECT *, 100.0 * (CASE WHEN kind = 'FP' THEN fp ELSE tp END) / total AS x FROM k)"""



@query(
    "robustness_by_category",
    S.with_(*FITTED, *scored("hard"), _ROBUST)
    + """SELECT model, category, total, fp, tp, fn, kind, round(x, 6) AS rate, CASE WHEN kind = 'FP'
  THEN CASE WHEN x > 30 THEN 'bad' WHEN x > 10 THEN 'warn' ELSE 'good' END
  ELSE CASE WHEN x > 80 THEN 'good' WHEN x > 50 THEN 'warn' ELSE 'bad' END END AS marker FROM rr""",
)
def robustness(spark, sf):
    return compare.robustness_by_category(long(spark, sf, "hard"))


@query(
    "robustness_score",
    S.with_(*FITTED, *scored("hard"), _ROBUST)
    + """, sc AS (SELECT model, CAST(sum(tp) - sum(fp) AS BIGINT) AS score_all, CAST(coalesce(sum(tp) FILTER (kind = 'TP'), 0) - coalesce(sum(fp) FILTER (kind = 'FP'), 0) AS BIGINT) AS score_by_kind,
  CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp FROM k GROUP BY model)
SELECT *, CAST(rank() OVER (ORDER BY score_all DESC) AS INTEGER) AS rank FROM sc""",
)
def robustness_score(spark, sf):
    s = compare.robustness_score(compare.robustness_by_category(long(spark, sf, "hard")))
    return compare.rank_models(s, "score_all")


_RIGHT = "ok AS (SELECT model, sample_id, labels = pred AS c FROM models)"


@query(
    "sample_accuracy",
    S.with_(*FITTED, *scored("holdout"), _RIGHT)
    + "SELECT model, count(*) AS n, count(*) FILTER (c) AS n_correct, round(avg(CAST(c AS DOUBLE)), 6) AS accuracy FROM ok GROUP BY model",
)
def sample_accuracy(spark, sf):
    return compare.sample_accuracy(compare.correctness(long(spark, sf, "holdout")))


_PAIRS = """m AS (SELECT p.a AS model_a, p.b AS model_b, count(*) FILTER (x.c AND y.c) AS both_correct, count(*) FILTER (x.c AND NOT y.c) AS a_only,
  count(*) FILTER (NOT x.c AND y.c) AS b_only, count(*) FILTER (NOT x.c AND NOT y.c) AS both_wrong
  FROM (VALUES """ + ", ".join(f"('{a}', '{b}')" for a, b in PAIRS) + """) p(a, b) JOIN ok x ON x.model = p.a JOIN ok y ON y.model = p.b AND x.sample_id = y.sample_id GROUP BY ALL)"""


def _mcnemar(spark, sf, set_name: str) -> DataFrame:
    right = compare.right_side_by_side(predicted(spark, sf, set_name), MODELS)
    return compare.mcnemar_stats(compare.mcnemar_side_by_side(right, PAIRS))


@query(
    "mcnemar_counts",
    S.with_(*FITTED, *scored("holdout"), _RIGHT, _PAIRS)
    + "SELECT *, a_only + b_only AS n_disagreements, coalesce(round(power(abs(a_only - b_only) - 1, 2) / nullif(a_only + b_only, 0), 6), 0) AS chi_square FROM m",
)
def mcnemar_counts(spark, sf):
    return _mcnemar(spark, sf, "holdout").select(
        "model_a", "model_b", "both_correct", "a_only", "b_only", "both_wrong", "n_disagreements",
        F.round("chi_square", 6).alias("chi_square"),
    )


# erfc by Simpson's rule over eight units, binomial tail by factorials
_P_VALUE = """CASE WHEN n = 0 THEN 1.0 WHEN n >= 25 THEN 2 / sqrt(pi()) * 0.004 / 3 * list_sum(list_transform(range(0, 2001),
  lambda i: (CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow(sqrt(pow(abs(a_only - b_only) - 1, 2) / n / 2) + i * 0.004, 2))))
  ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(a_only, b_only) + 1),
  lambda i: CAST(factorial(CAST(n AS INTEGER)) AS DOUBLE) / CAST(factorial(CAST(i AS INTEGER)) AS DOUBLE) / CAST(factorial(CAST(n - i AS INTEGER)) AS DOUBLE))) / pow(2.0, n)) END"""



@query(
    "mcnemar_stats",
    S.with_(*FITTED, *scored("hard"), _RIGHT, _PAIRS)
    + f""", d AS (SELECT *, a_only + b_only AS n FROM m), p AS (SELECT *, {_P_VALUE} AS p_value FROM d)
SELECT model_a, model_b, both_correct, a_only, b_only, both_wrong, n AS n_disagreements,
  CASE WHEN n = 0 THEN 0.0 ELSE round(power(abs(a_only - b_only) - 1, 2) / n, 6) END AS chi_square, round(p_value, 6) AS p_value,
  CASE WHEN n = 0 THEN 'No disagreement' WHEN p_value < 0.001 THEN '***' WHEN p_value < 0.01 THEN '**' WHEN p_value < 0.05 THEN '*' ELSE 'ns' END AS significance,
  CASE WHEN a_only > b_only THEN model_a WHEN b_only > a_only THEN model_b ELSE 'TIE' END AS better_model,
  CASE WHEN n = 0 THEN 'N/A' WHEN n < 25 THEN 'Exact binomial' ELSE 'Asymptotic (continuity correction)' END AS test_method FROM p""",
)
def mcnemar_stats(spark, sf):
    return _mcnemar(spark, sf, "hard").withColumns({c: F.round(c, 6) for c in ("chi_square", "p_value")})


@query(
    "test_holdout_gap",
    S.with_(*FITTED, *_measured("main", "1"), *_measured("holdout", "2"))
    + """, g AS (SELECT h.model, h.f1 AS holdout_f1, coalesce(t.f1, 0) AS test_f1 FROM metrics2 h LEFT JOIN metrics1 t ON h.model = t.model AND t.entity = '_macro' WHERE h.entity = '_macro')
SELECT *, round(test_f1 - holdout_f1, 6) AS gap, CASE WHEN test_f1 - holdout_f1 < 0.05 THEN 'Robust' WHEN test_f1 - holdout_f1 < 0.15 THEN 'Mild gap' ELSE 'Large gap' END AS status,
  CAST(rank() OVER (ORDER BY holdout_f1 DESC) AS INTEGER) AS rank FROM g""",
)
def test_holdout_gap(spark, sf):
    tables = fitted(spark, sf)
    m = lambda s: measured(spark, sf, s, tables)
    return compare.rank_models(compare.test_holdout_gap(m("main"), m("holdout")), "holdout_f1")
