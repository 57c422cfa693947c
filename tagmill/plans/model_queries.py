"""Queries for term lists, token features, hidden Markov and linear taggers."""

from pyspark.sql import functions as F

from ..functions.fixed import (
    JABATAN_PREFIX, NEGATIVE_KEYWORDS, NIK_LABEL_SEEDS, PHONE_LABEL_SEEDS, PHONE_PREFIXES, VALUE_DELIMITERS,
)
from ..functions.labels import mask_pattern_token, token_is_nik, token_is_phone
from ..functions.text import tokenize
from ..operators import features, gazetteer, hmm, linear, metrics
from ..operators.common import explode_rows, materialize
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


TAGGED = S.main_tagged()
_IN = lambda xs: ", ".join(S.q(x) for x in xs)
_TOK = """tok AS (SELECT sample_id, unnest(tokens) AS w, unnest(labels) AS l, generate_subscripts(tokens, 1) - 1 AS pos FROM tagged),
prevs AS (SELECT *, lower(w) AS t, lag(lower(w)) OVER x AS p1, lag(lower(w), 2) OVER x AS p2, lag(l) OVER x AS pl FROM tok WINDOW x AS (PARTITION BY sample_id ORDER BY pos))"""
_PREV = f"CASE WHEN p1 IN ({_IN(VALUE_DELIMITERS)}) THEN coalesce(p2, p1) ELSE p1 END"
_MINED = f"""{_TOK}, {S.spans('tagged', 'sample_id', 'labels', 'sp')},
phr AS (SELECT type, lower(array_to_string(tokens[s + 1 : e + 1], ' ')) AS term FROM sp JOIN tagged USING (sample_id) WHERE e > s),
items AS (
  SELECT 'jabatan_tokens' AS category, t AS term FROM prevs WHERE l IN ('B-JABATAN', 'I-JABATAN')
  UNION ALL SELECT 'lokasi_tokens', t FROM prevs WHERE l IN ('B-LOKASI', 'I-LOKASI')
  UNION ALL SELECT CASE type WHEN 'JABATAN' THEN 'jabatan_phrases' ELSE 'lokasi_phrases' END, term FROM phr WHERE type IN ('JABATAN', 'LOKASI')
  UNION ALL SELECT 'nama_prefixes', t FROM prevs WHERE l = 'B-NAMA' AND regexp_matches(w, '^\\p{{Lu}}\\p{{L}}+$')
  UNION ALL SELECT 'nik_labels', {_PREV} FROM prevs WHERE l = 'B-NIK' AND regexp_matches({_PREV}, '\\p{{L}}')
  UNION ALL SELECT 'phone_labels', {_PREV} FROM prevs WHERE l = 'B-PHONE' AND regexp_matches({_PREV}, '\\p{{L}}')),
mined AS (SELECT category, term, count(*) AS n FROM items GROUP BY ALL)"""
_GAZ = f"""seeds AS (SELECT 'jabatan_prefix' AS category, unnest([{_IN(JABATAN_PREFIX)}]) AS term
  UNION ALL SELECT 'nik_labels', unnest([{_IN(NIK_LABEL_SEEDS)}]) UNION ALL SELECT 'phone_labels', unnest([{_IN(PHONE_LABEL_SEEDS)}])
  UNION ALL SELECT 'negative_keywords', unnest([{_IN(NEGATIVE_KEYWORDS)}])),
gaz AS (SELECT category, term FROM mined WHERE n >= 2 OR category NOT LIKE '%_tokens' AND category NOT LIKE '%_phrases' UNION SELECT * FROM seeds)"""


@query("gazetteer_terms", S.with_(*TAGGED, _MINED) + "SELECT * FROM mined")
def gazetteer_terms(spark, sf):
    return gazetteer.mine_counts(base.tagged(spark, sf)).select("category", "term", "n")


@query(
    "gazetteer_phrases",
    S.with_(*TAGGED, _MINED) + "SELECT category, term, n FROM mined WHERE category LIKE '%phrases' AND n >= 2",
)
def gazetteer_phrases(spark, sf):
    counts = gazetteer.mine_counts(base.tagged(spark, sf))
    return counts.where("category like '%phrases' and n >= 2").select("category", "term", "n")


@query(
    "first_names",
    S.with_(*TAGGED, _TOK)
    + """SELECT 'nama_prefixes' AS category, t AS term, count(*) AS n FROM prevs WHERE l = 'B-NAMA' AND regexp_matches(w, '^\\p{Lu}\\p{L}+$')
GROUP BY t ORDER BY n DESC, min((sample_id, pos)) LIMIT 500""",
)
def first_names(spark, sf):
    return gazetteer.top_terms(gazetteer.mine_counts(base.tagged(spark, sf)), "nama_prefixes", 500)


@query(
    "context_labels",
    S.with_(*TAGGED, _MINED, _GAZ) + "SELECT category, term FROM gaz WHERE category IN ('nik_labels', 'phone_labels')",
)
def context_labels(spark, sf):
    g = gazetteer.build_gazetteer(base.tagged(spark, sf))
    return g.where("category in ('nik_labels', 'phone_labels')")


@query("build_gazetteer", S.with_(*TAGGED, _MINED, _GAZ) + "SELECT * FROM gaz")
def build(spark, sf):
    return gazetteer.build_gazetteer(base.tagged(spark, sf))


@query(
    "previous_words",
    S.with_(*TAGGED, _TOK) + f"SELECT {_PREV} AS word, l AS label, count(*) AS n FROM prevs WHERE l LIKE 'B-%' GROUP BY ALL",
)
def previous_words(spark, sf):
    from ..functions.let import let

    found = lambda low, lab: F.filter(
        F.transform(
            lab, lambda l, i: F.when(l.startswith("B-"), F.struct(gazetteer.previous_word(low, i).alias("word"), l.alias("label")))
        ),
        lambda x: x.isNotNull(),
    )
    df = base.tagged(spark, sf)
    words = let(found, F.transform("tokens", lambda t: F.lower(t)), F.col("labels"))
    return explode_rows(df, [], words, "x").groupBy("x.word", "x.label").agg(F.count("*").alias("n"))


# --- features --------------------------------------------------------------------------------

_NEG = "|".join(NEGATIVE_KEYWORDS)
_FEAT_SETS = {
    "main": S.with_(*TAGGED, _MINED, _GAZ),
    "adversarial": S.with_(
        S.people(), S.samples("main"), S.tagged(), _MINED, _GAZ, S.samples("adversarial", "adv"), S.tagged("adv", "scored")
    ),
}


def _flag(cat, col):
    return f"{col} IN (SELECT term FROM gaz WHERE category = '{cat}')"


def _window_features(src):
    return f""", ft AS (SELECT sample_id, unnest(tokens) AS w, generate_subscripts(tokens, 1) - 1 AS pos FROM {src}),
f1 AS (SELECT *, lower(w) AS t, lead(lower(w)) OVER x AS nx, lag(w) OVER x AS b1, lag(w, 2) OVER x AS b2,
  regexp_matches(w, '^\\p{{Nd}}{{16}}$') AS is_nik, regexp_matches(w, '^(\\+62|0)\\p{{Nd}}{{8,12}}$') AS is_phone,
  TRY_CAST(w[1:2] AS INTEGER) AS pp, TRY_CAST(w[7:8] AS INTEGER) AS dd, TRY_CAST(w[9:10] AS INTEGER) AS mm
  FROM ft WINDOW x AS (PARTITION BY sample_id ORDER BY pos)),
f2 AS (SELECT *, {_flag('nik_labels', 't')} AS nl, {_flag('phone_labels', 't')} AS pl, regexp_matches(t, '{_NEG}') AS ng,
  is_nik AND pp BETWEEN 11 AND 94 AS po, is_nik AND (dd BETWEEN 1 AND 31 OR dd BETWEEN 41 AND 71) AND mm BETWEEN 1 AND 12 AS date_ok FROM f1),
feat AS (SELECT *, coalesce(bool_or(nl) OVER before, FALSE) AS has_nik_label_context, coalesce(bool_or(pl) OVER before, FALSE) AS has_phone_label_context,
  coalesce(bool_or(ng) OVER before, FALSE) OR coalesce(bool_or(ng) OVER behind, FALSE) AS negative,
  coalesce(b1 IN (':', '=') AND regexp_matches(b2, '^\\p{{L}}+$'), FALSE) AS in_form_field_position
  FROM f2 WINDOW before AS (PARTITION BY sample_id ORDER BY pos ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING),
  behind AS (PARTITION BY sample_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING))
"""


_CONTEXT = [
    "has_nik_label_context", "has_phone_label_context", "in_form_field_position", "nik_structure_complete",
    "nik_province_valid", "nik_date_valid", "phone_valid_prefix", "nik_has_negative_context", "phone_has_negative_context",
]


@query(
    "context_features",
    _FEAT_SETS["adversarial"] + _window_features("scored")
    + f"""SELECT sample_id, CAST(pos AS INTEGER) AS pos, has_nik_label_context, has_phone_label_context, in_form_field_position,
  po AND date_ok AS nik_structure_complete, po AS nik_province_valid, date_ok AS nik_date_valid,
  is_phone AND coalesce(CASE WHEN w LIKE '+62%' THEN w[1:5] ELSE w[1:4] END IN ({_IN(PHONE_PREFIXES)}), FALSE) AS phone_valid_prefix,
  is_nik AND negative AS nik_has_negative_context, is_phone AND negative AS phone_has_negative_context FROM feat WHERE is_nik OR is_phone""",
)
def context_features(spark, sf):
    """Features of ID- and phone-like tokens of the adversarial set, term lists mined from main."""
    terms = gazetteer.build_gazetteer(base.tagged(spark, sf))
    fields = [*_CONTEXT, "matches_nik_pattern", "matches_phone_pattern"]
    df = base.tagged(spark, sf, "adversarial").where(F.exists("tokens", token_is_nik) | F.exists("tokens", token_is_phone))
    df = features.token_features(df, terms, use_gazetteer=False, fields=fields)
    rows = explode_rows(
        df, ["sample_id"],
        F.filter(
            F.transform("features", lambda f, i: F.struct(i.alias("pos"), f.alias("f"))),
            lambda x: x["f"]["matches_nik_pattern"] | x["f"]["matches_phone_pattern"],
        ),
    )
    return rows.select("sample_id", "x.pos", *[f"x.f.{c}" for c in _CONTEXT])


@query(
    "feature_counts",
    _FEAT_SETS["main"] + _window_features("tagged")
    + f""", c AS (SELECT count(*) AS bias, count(*) FILTER (pos = 0) AS bos, count(*) FILTER (nx IS NULL) AS eos, count(*) FILTER (is_nik) AS matches_nik_pattern,
  count(*) FILTER (is_phone) AS matches_phone_pattern, count(*) FILTER (has_nik_label_context) AS has_nik_label_context,
  count(*) FILTER (has_phone_label_context) AS has_phone_label_context, count(*) FILTER (in_form_field_position) AS in_form_field_position,
  count(*) FILTER ({_flag('jabatan_tokens', 't')}) AS in_jabatan_dict, count(*) FILTER ({_flag('jabatan_prefix', 't')}) AS is_jabatan_prefix,
  count(*) FILTER ({_flag('lokasi_tokens', 't')}) AS in_lokasi_dict, count(*) FILTER ({_flag('nama_prefixes', 't')}) AS in_nama_dict,
  count(*) FILTER ({_flag('jabatan_phrases', "t || ' ' || nx")}) AS bigram_jabatan, count(*) FILTER ({_flag('lokasi_phrases', "t || ' ' || nx")}) AS bigram_lokasi,
  0 AS has_title_marker FROM feat)
SELECT name, n FROM (UNPIVOT c ON * INTO NAME name VALUE n)""",
)
def feature_counts(spark, sf):
    """How many tokens have each flag set."""
    names = [
        "bias", "bos", "eos", "matches_nik_pattern", "matches_phone_pattern", "has_nik_label_context",
        "has_phone_label_context", "in_form_field_position", "in_jabatan_dict", "is_jabatan_prefix", "in_lokasi_dict",
        "in_nama_dict", "bigram_jabatan", "bigram_lokasi", "has_title_marker",
    ]
    df = base.tagged(spark, sf)
    rows = explode_rows(features.token_features(df, gazetteer.build_gazetteer(df)), [], "features", "f")
    counts = rows.agg(*[F.count_if(F.col(f"f.{n}").cast("boolean")).alias(n) for n in names])
    return counts.select(F.expr(f"stack({len(names)}, {', '.join(f'{chr(39)}{n}{chr(39)}, `{n}`' for n in names)}) as (name, n)"))


def _shape(x):
    return f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '[^\\p{{Nd}}\\p{{Lu}}\\p{{Ll}}]', '.', 'g'), '\\p{{Ll}}', 'x', 'g'), '\\p{{Lu}}', 'X', 'g'), '\\p{{Nd}}', 'd', 'g')"


def _short(x):
    return f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({_shape(x)}, 'd+', 'd', 'g'), 'x+', 'x', 'g'), 'X+', 'X', 'g'), '\\.+', '.', 'g')"


_UP = lambda x: f"regexp_matches({x}, '\\p{{Lu}}') AND NOT regexp_matches({x}, '\\p{{Ll}}')"
_TI = lambda x: f"regexp_matches({x}, '^\\p{{Lu}}\\p{{Ll}}*$')"
_ALL_FEATURES = {
    "bias": "1.0", "word_identity": "w", "word_lower": "t", "word_shape": _shape("w"), "word_shape_simple": _short("w"),
    "word_isupper": _UP("w"), "word_istitle": _TI("w"), "word_isdigit": "regexp_matches(w, '^\\p{Nd}+$')", "word_length": "length(w)",
    **{f"word_prefix_{k}": f"left(t, {k})" for k in (2, 3, 4)}, **{f"word_suffix_{k}": f"right(t, {k})" for k in (2, 3, 4)},
    "bos": "pos = 0", "eos": "n1 IS NULL",
    **{f"{n}_{f}": e for n, c in (("m1", "b1"), ("p1", "n1")) for f, e in (("lower", f"lower({c})"), ("shape", _shape(c)), ("istitle", _TI(c)), ("isupper", _UP(c)))},
    **{f"{n}_{f}": e for n, c in (("m2", "b2"), ("p2", "n2")) for f, e in (("lower", f"lower({c})"), ("shape", _shape(c)))},
    "matches_nik_pattern": "is_nik", "matches_phone_pattern": "is_phone",
    "has_nik_label_context": "has_nik_label_context", "has_phone_label_context": "has_phone_label_context",
    "in_form_field_position": "in_form_field_position", "nik_structure_complete": "po AND date_ok", "nik_province_valid": "po", "nik_date_valid": "date_ok",
    "phone_valid_prefix": f"is_phone AND coalesce(CASE WHEN w LIKE '+62%' THEN w[1:5] ELSE w[1:4] END IN ({_IN(PHONE_PREFIXES)}), FALSE)",
    "nik_has_negative_context": "is_nik AND negative", "phone_has_negative_context": "is_phone AND negative",
    "in_jabatan_dict": _flag("jabatan_tokens", "t"), "is_jabatan_prefix": _flag("jabatan_prefix", "t"),
    "in_lokasi_dict": _flag("lokasi_tokens", "t"), "in_nama_dict": _flag("nama_prefixes", "t"), "has_title_marker": "FALSE",
    "bigram_jabatan": f"coalesce({_flag('jabatan_phrases', chr(116) + ' || chr(32) || nx')}, FALSE)",
    "bigram_lokasi": f"coalesce({_flag('lokasi_phrases', chr(116) + ' || chr(32) || nx')}, FALSE)",
}


_FEATURES_SQL = (
    S.with_(S.people(), S.samples("main"), S.tagged(), _MINED, _GAZ, S.samples("holdout", "hold"), S.tagged("hold", "scored"))
    + _window_features("scored")
    + ", fx AS (SELECT *, lead(w) OVER x AS n1, lead(w, 2) OVER x AS n2 FROM feat WINDOW x AS (PARTITION BY sample_id ORDER BY pos)), wide AS (SELECT "
    + ", ".join(f"CAST(({e}) AS VARCHAR) AS {n}" for n, e in _ALL_FEATURES.items())
    + " FROM fx) SELECT name, count(*) AS n, count(DISTINCT value) AS distinct_values FROM (UNPIVOT wide ON * INTO NAME name VALUE value) GROUP BY name"
)


def _feature_counts(spark, sf, **options):
    terms = materialize(gazetteer.build_gazetteer(base.tagged(spark, sf)))
    goal = base.tagged(spark, sf, "holdout").select("sample_id", "tokens")
    long = features.long_features(features.token_features(goal, terms, **options))
    return long.groupBy("name").agg(F.count("*").alias("n"), F.count_distinct("value").alias("distinct_values"))


@query("token_features", _FEATURES_SQL)
def token_features(spark, sf):
    """All features of all tokens, as (name, rows, distinct values)."""
    return _feature_counts(spark, sf)


@query("token_features_joined", _FEATURES_SQL)
def token_features_joined(spark, sf):
    """The same by the path for term lists of any size."""
    return _feature_counts(spark, sf, small_terms=0, trie_bytes=0)


@query("token_features_trie", _FEATURES_SQL)
def token_features_trie(spark, sf):
    """The same by a trie over tokens."""
    return _feature_counts(spark, sf, small_terms=0)


# --- hidden Markov model ---------------------------------------------------------------------


def _fitted(spark, sf, hybrid=False):
    counts = materialize(hmm.hmm_counts(base.tagged(spark, sf), hybrid))
    return hmm.fit_hmm(None, hybrid=hybrid, counts=counts)


def _hmm_sql(hybrid=False):
    obs = (
        "CASE WHEN regexp_matches(w, '^\\p{Nd}{16}$') THEN '<__NIK_PATTERN__>' WHEN regexp_matches(w, '^(\\+62|0)\\p{Nd}{8,12}$') THEN '<__PHONE_PATTERN__>' ELSE lower(w) END"
        if hybrid
        else "lower(w)"
    )
    return [
        *TAGGED, _TOK,
        f"""ob AS (SELECT sample_id, pos, l, pl, {obs} AS o FROM prevs),
st AS (SELECT l AS state, count(*) AS total FROM ob GROUP BY l), kk AS (SELECT count(*) AS k FROM st), vv AS (SELECT count(DISTINCT o) + 1 AS v FROM ob),
hs AS (SELECT state, ln((coalesce(n, 0) + 1.0) / (sum(coalesce(n, 0)) OVER () + k)) AS logp FROM st CROSS JOIN kk LEFT JOIN (SELECT l AS state, count(*) AS n FROM ob WHERE pos = 0 GROUP BY l) USING (state)),
ht AS (SELECT prev, state, ln((coalesce(n, 0) + 1.0) / (sum(coalesce(n, 0)) OVER (PARTITION BY prev) + k)) AS logp
  FROM (SELECT a.state AS prev, b.state FROM st a CROSS JOIN st b) CROSS JOIN kk LEFT JOIN (SELECT pl AS prev, l AS state, count(*) AS n FROM ob WHERE pl IS NOT NULL GROUP BY ALL) USING (prev, state)),
he AS (SELECT state, o AS token, ln((n + 1.0) / (total + v)) AS logp FROM (SELECT l AS state, o, count(*) AS n FROM ob GROUP BY ALL) JOIN st USING (state) CROSS JOIN vv),
hu AS (SELECT state, ln(1.0 / (total + v)) AS logp FROM st CROSS JOIN vv)""",
    ]


for _name, _table, _cols in (
    ("hmm_start", "hs", ["state"]), ("hmm_trans", "ht", ["prev", "state"]),
    ("hmm_emission", "he", ["state", "token"]), ("hmm_unseen", "hu", ["state"]),
):

    def _add(name, table, cols):
        key = name.split("_")[1]

        @query(name, S.with_(*_hmm_sql()) + f"SELECT {', '.join(cols)}, round(logp, 6) AS logp FROM {table}")
        def run(spark, sf):
            return _fitted(spark, sf)[key].select(*cols, F.round("logp", 6).alias("logp"))

    _add(_name, _table, _cols)


@query(
    "hmm_counts",
    S.with_(*_hmm_sql(True))
    + """SELECT 'start' AS kind, CAST(NULL AS VARCHAR) AS prev, l AS state, CAST(NULL AS VARCHAR) AS token, count(*) AS n FROM ob WHERE pos = 0 GROUP BY l
UNION ALL SELECT 'trans', pl, l, NULL, count(*) FROM ob WHERE pl IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'emission', NULL, l, o, count(*) FROM ob GROUP BY l, o""",
)
def hmm_counts(spark, sf):
    return hmm.hmm_counts(base.tagged(spark, sf), hybrid=True)


@query(
    "vocabulary",
    S.with_(*_hmm_sql(True)) + "SELECT o AS token FROM ob UNION SELECT '<UNK>'",
)
def vocabulary(spark, sf):
    return hmm.vocabulary(base.tagged(spark, sf), hybrid=True)


@query(
    "mask_pattern_tokens",
    f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '{S.TOKEN}')) AS w FROM documents)
SELECT doc_id, count(DISTINCT CASE WHEN regexp_matches(w, '^\\p{{Nd}}{{16}}$') THEN '<__NIK_PATTERN__>'
  WHEN regexp_matches(w, '^(\\+62|0)\\p{{Nd}}{{8,12}}$') THEN '<__PHONE_PATTERN__>' ELSE lower(w) END) AS terms FROM t GROUP BY doc_id""",
)
def mask_pattern_tokens(spark, sf):
    docs = base.texts(spark, sf, "documents")
    terms = F.array_distinct(F.transform(tokenize("text"), mask_pattern_token))
    return docs.select("doc_id", F.size(terms).cast("long").alias("terms")).where("terms > 0")


def _viterbi_sql(hybrid):
    obs = (
        "CASE WHEN regexp_matches(w, '^\\p{Nd}{16}$') THEN '<__NIK_PATTERN__>' WHEN regexp_matches(w, '^(\\+62|0)\\p{Nd}{8,12}$') THEN '<__PHONE_PATTERN__>' ELSE lower(w) END"
        if hybrid
        else "lower(w)"
    )
    return [
        *_hmm_sql(hybrid), S.samples("holdout", "hold"), S.tagged("hold", "goal"),
        f"""go AS (SELECT sample_id, pos, {obs} AS o FROM (SELECT sample_id, unnest(tokens) AS w, generate_subscripts(tokens, 1) - 1 AS pos FROM goal)),
em AS (SELECT sample_id, pos, hu.state, coalesce(he.logp, hu.logp) AS e FROM go CROSS JOIN hu LEFT JOIN he ON he.state = hu.state AND he.token = go.o),
vit AS (SELECT sample_id, pos, state, hs.logp + e AS score, [state] AS path FROM em JOIN hs USING (state) WHERE pos = 0
  UNION ALL SELECT sample_id, pos, state, score, path FROM (
    SELECT em.sample_id, em.pos, em.state, v.score + ht.logp + e AS score, list_append(v.path, em.state) AS path,
      row_number() OVER (PARTITION BY em.sample_id, em.state ORDER BY v.score + ht.logp + e DESC, v.state) AS rn
    FROM vit v JOIN ht ON ht.prev = v.state JOIN em ON em.sample_id = v.sample_id AND em.pos = v.pos + 1 AND em.state = ht.state) WHERE rn = 1),
best AS (SELECT sample_id, path AS pred FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY pos DESC, score DESC, state) AS rn FROM vit) WHERE rn = 1),
pr AS (SELECT g.*, pred FROM goal g JOIN best USING (sample_id))""",
    ]


def _hmm_tagged(spark, sf, hybrid, **options):
    return hmm.tag_hmm(base.tagged(spark, sf, "holdout"), _fitted(spark, sf, hybrid), hybrid, **options)


for _hybrid in (False, True):

    def _add_tagger(hybrid):
        name = "hybrid_hmm" if hybrid else "hmm"

        @query(f"{name}_viterbi", S.with_(*_viterbi_sql(hybrid)) + "SELECT sample_id, array_to_string(pred, ' ') AS pred FROM pr")
        def tag(spark, sf):
            return _hmm_tagged(spark, sf, hybrid).select("sample_id", F.array_join("pred", " ").alias("pred"))

        @query(
            f"{name}_entity_metrics",
            S.with_(
                *_viterbi_sql(hybrid), S.spans("pr", "sample_id", "labels", "tspan"), S.spans("pr", "sample_id", "pred", "pspan"),
                S.counts("tspan", "pspan", "sample_id", ""), S.metrics(),
            )
            + "SELECT * FROM metrics",
        )
        def score(spark, sf):
            return metrics.entity_metrics(_hmm_tagged(spark, sf, hybrid))

    _add_tagger(_hybrid)


@query("hmm_viterbi_joined", ORACLES["hmm_viterbi"])
def hmm_viterbi_joined(spark, sf):
    """The same by the path for models of any size."""
    return _hmm_tagged(spark, sf, False, model_bytes=0).select("sample_id", F.array_join("pred", " ").alias("pred"))


# --- linear model ----------------------------------------------------------------------------


# Enough for the holdout bounds; the objective still falls slowly after it.
FIT_ITERATIONS = 20


def _linear(spark, sf):
    train = base.tagged(spark, sf)
    terms = materialize(gazetteer.build_gazetteer(train))
    return linear.fit_linear_tagger(features.token_features(train, terms), max_iter=FIT_ITERATIONS), terms


# Macro and entity F1 that training must reach on the holdout set.
_BOUNDS = {"NIK": 0.95, "PHONE": 0.95, "NAMA": 0.9, "JABATAN": 0.75, "LOKASI": 0.85, "_macro": 0.93, "_micro": 0.93}


@query(
    "linear_entity_metrics",
    S.with_(S.people(), S.samples("holdout"), S.tagged(), S.spans("tagged", "sample_id", "labels", "sp"))
    + f"""SELECT entity, count(*) AS support, TRUE AS good, TRUE AS loss_falls FROM (SELECT unnest([type, '_macro', '_micro']) AS entity FROM sp WHERE type IN ({_IN(list(_BOUNDS))})) GROUP BY entity""",
)
def linear_entity_metrics(spark, sf):
    """A chain model fitted on the main set and scored on the holdout set: whether F1 reaches its
    bound, and whether no iteration raised the objective and the last one is below a tenth of the first."""
    weights, terms = _linear(spark, sf)
    losses = weights["losses"]
    falls = all(b <= a for a, b in zip(losses, losses[1:])) and losses[-1] < losses[0] / 10
    goal = features.token_features(base.tagged(spark, sf, "holdout"), terms)
    scores = metrics.entity_metrics(linear.tag_linear(goal, weights))
    bound = F.element_at(F.create_map(*[F.lit(x) for kv in _BOUNDS.items() for x in kv]), F.col("entity"))
    return scores.select("entity", "support", (F.col("f1") >= bound).alias("good"), F.lit(falls).alias("loss_falls"))


_FIXED_SQL = """fw AS (SELECT 'word_lower=' || o AS feature, l AS state, o, round(ln(count(*) + 1), 6) AS weight FROM ob GROUP BY o, l)"""


def _fixed_weights(spark, sf):
    """A weight table by plain arithmetic on counts, which SQL can repeat."""
    seen = hmm.hmm_counts(base.tagged(spark, sf)).where("kind = 'emission'")
    return seen.select(F.concat(F.lit("word_lower="), "token").alias("feature"), "state", F.round(F.log(F.col("n") + 1), 6).alias("weight"))


@query("linear_top_weights", S.with_(*_hmm_sql(), _FIXED_SQL) + "SELECT feature, state, weight FROM fw ORDER BY abs(weight) DESC, feature, state LIMIT 15")
def linear_top_weights(spark, sf):
    return linear.top_weights(_fixed_weights(spark, sf), 15)


@query(
    "linear_viterbi",
    S.with_(
        *_hmm_sql(), _FIXED_SQL, S.samples("holdout", "hold"), S.tagged("hold", "goal"),
        """go AS (SELECT sample_id, pos, lower(w) AS o FROM (SELECT sample_id, unnest(tokens) AS w, generate_subscripts(tokens, 1) - 1 AS pos FROM goal)),
em AS (SELECT sample_id, pos, hs.state, coalesce(fw.weight, 0.0) AS e FROM go CROSS JOIN hs LEFT JOIN fw ON fw.state = hs.state AND fw.o = go.o),
vit AS (SELECT sample_id, pos, state, e AS score, [state] AS path FROM em WHERE pos = 0
  UNION ALL SELECT sample_id, pos, state, score, path FROM (
    SELECT em.sample_id, em.pos, em.state, v.score + round(ht.logp, 6) + e AS score, list_append(v.path, em.state) AS path,
      row_number() OVER (PARTITION BY em.sample_id, em.state ORDER BY v.score + round(ht.logp, 6) + e DESC, v.state) AS rn
    FROM vit v JOIN ht ON ht.prev = v.state JOIN em ON em.sample_id = v.sample_id AND em.pos = v.pos + 1 AND em.state = ht.state) WHERE rn = 1),
best AS (SELECT sample_id, path AS pred FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY pos DESC, score DESC, state) AS rn FROM vit) WHERE rn = 1)""",
    )
    + "SELECT sample_id, array_to_string(pred, ' ') AS pred FROM best",
)
def linear_viterbi(spark, sf):
    """The linear scorer with the table above and the transition weights of the counts."""
    trans = _fitted(spark, sf)["trans"].select("prev", "state", F.round("logp", 6).alias("weight"))
    weights = {"state": materialize(_fixed_weights(spark, sf)), "trans": materialize(trans)}
    goal = features.token_features(base.tagged(spark, sf, "holdout"), use_regex=False, use_gazetteer=False)
    return linear.tag_linear(goal, weights).select("sample_id", F.array_join("pred", " ").alias("pred"))
