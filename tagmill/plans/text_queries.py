"""Queries over documents, pages and conversations, and over IDs and phones."""

from pyspark.sql import DataFrame, functions as F

from ..functions import nik, phone, text as T
from ..functions.fixed import NIK_TOKEN, PHONE_PREFIXES, PROVINCES
from ..functions.labels import tag_regex, token_is_nik
from ..functions.let import let
from ..operators import profile
from ..operators.common import explode_rows
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


def _token_summary(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, T.tokenize(text).alias("t")).select(
        key,
        F.size("t").cast("long").alias("n_tokens"),
        F.md5(F.array_join("t", " ")).alias("digest"),
    )


def _token_summary_sql(table: str, key: str, text: str) -> str:
    return f"""SELECT {key}, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS digest
FROM (SELECT {key}, regexp_extract_all({text}, '{S.TOKEN}') AS t FROM {table})"""


@query("tokenize_documents", _token_summary_sql("documents", "doc_id", "text"))
def tokenize_documents(spark, sf):
    return _token_summary(base.texts(spark, sf, "documents"), "doc_id", "text")


@query("tokenize_pages", _token_summary_sql("pages", "page_id", "html"))
def tokenize_pages(spark, sf):
    return _token_summary(base.texts(spark, sf, "pages"), "page_id", "html")


@query(
    "tokenize_conversations",
    f"""SELECT role, count(*) AS n_turns, CAST(sum(len(t)) AS BIGINT) AS n_tokens
FROM (SELECT role, regexp_extract_all(text, '{S.TOKEN}') AS t FROM conversations) GROUP BY role""",
)
def tokenize_conversations(spark, sf):
    return (
        base.texts(spark, sf, "conversations")
        .select("role", F.size(T.tokenize("text")).alias("n"))
        .groupBy("role")
        .agg(F.count("*").alias("n_turns"), F.sum("n").alias("n_tokens"))
    )


_SHAPE = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(w, '[^\\p{Nd}\\p{Lu}\\p{Ll}]', '.', 'g'), "
    "'\\p{Ll}', 'x', 'g'), '\\p{Lu}', 'X', 'g'), '\\p{Nd}', 'd', 'g')"
)
_SHORT = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(shape, 'd+', 'd', 'g'), 'x+', 'x', 'g'), 'X+', 'X', 'g'), '\\.+', '.', 'g')"
_DOC_TOKENS = f"t AS (SELECT doc_id, lang, unnest(regexp_extract_all(text, '{S.TOKEN}')) AS w FROM documents)"


@query(
    "token_shape_profile",
    f"""WITH {_DOC_TOKENS}, s AS (SELECT lang, {_SHAPE} AS shape FROM t)
SELECT lang, {_SHORT} AS shape_simple, count(*) AS n, CAST(max(length(shape)) AS INTEGER) AS longest FROM s GROUP BY ALL""",
)
def token_shape_profile(spark, sf):
    tokens = base.texts(spark, sf, "documents").select("lang", T.tokenize("text").alias("t"))
    pairs = F.arrays_zip(T.token_shapes("t").alias("shape"), T.token_shapes_simple("t").alias("short"))
    return (
        explode_rows(tokens, ["lang"], pairs, "p")
        .groupBy("lang", F.col("p.short").alias("shape_simple"))
        .agg(F.count("*").alias("n"), F.max(F.length("p.shape")).alias("longest"))
    )


@query(
    "word_forms",
    f"""WITH {_DOC_TOKENS} SELECT lang, count(*) AS n,
  count(*) FILTER (regexp_matches(w, '\\p{{Lu}}') AND NOT regexp_matches(w, '\\p{{Ll}}')) AS upper_n,
  count(*) FILTER (regexp_matches(w, '^\\p{{Lu}}\\p{{Ll}}*$')) AS title_n,
  count(*) FILTER (regexp_matches(w, '^\\p{{Nd}}+$')) AS digit_n,
  count(*) FILTER (regexp_matches(w, '^\\p{{L}}+$')) AS alpha_n,
  CAST(sum(length(regexp_replace(lower(w), '[^\\p{{L}}\\p{{N}}_]', '', 'g'))) AS BIGINT) AS clean_chars
FROM t GROUP BY lang""",
)
def word_forms(spark, sf):
    w = F.col("w")
    return (
        explode_rows(base.texts(spark, sf, "documents"), ["lang"], T.tokenize("text"), "w")
        .groupBy("lang")
        .agg(
            F.count("*").alias("n"),
            F.count_if(T.is_upper(w)).alias("upper_n"),
            F.count_if(T.is_title(w)).alias("title_n"),
            F.count_if(T.is_digits(w)).alias("digit_n"),
            F.count_if(T.is_alpha(w)).alias("alpha_n"),
            F.sum(F.length(T.clean_word(w))).cast("long").alias("clean_chars"),
        )
    )


@query(
    "affix_profile",
    f"""WITH {_DOC_TOKENS} SELECT lower(left(w, 2)) AS prefix_2, lower(right(w, 3)) AS suffix_3, count(*) AS n,
  count(DISTINCT lower(left(w, 4))) AS prefixes_4 FROM t GROUP BY ALL""",
)
def affix_profile(spark, sf):
    w = F.col("w")
    return (
        explode_rows(base.texts(spark, sf, "documents"), [], T.tokenize("text"), "w")
        .groupBy(T.prefix(w, 2).alias("prefix_2"), T.suffix(w, 3).alias("suffix_3"))
        .agg(F.count("*").alias("n"), F.count_distinct(T.prefix(w, 4)).alias("prefixes_4"))
    )


@query(
    "url_quote_roundtrip",
    """SELECT doc_id, md5(replace(url_encode(text), '%2F', '/')) AS quoted, TRUE AS same FROM documents""",
)
def url_quote_roundtrip(spark, sf):
    return (
        base.texts(spark, sf, "documents")
        .withColumn("_q", T.url_quote("text"))
        .select("doc_id", F.md5("_q").alias("quoted"), (T.url_unquote("_q") == F.col("text")).alias("same"))
    )


@query("url_unquote_pages", "SELECT page_id, url_decode(url) AS url, md5(url_decode(html)) AS html FROM pages")
def url_unquote_pages(spark, sf):
    return base.texts(spark, sf, "pages").select(
        "page_id", T.url_unquote("url").alias("url"), F.md5(T.url_unquote("html")).alias("html")
    )


@query(
    "sixteen_digit_candidates",
    f"""WITH {_DOC_TOKENS} SELECT doc_id, w AS token, CAST(count(*) AS BIGINT) AS n,
  substr(w, 1, 2) IN ({', '.join(f"'{p}'" for p in PROVINCES)}) AS province_ok
FROM t WHERE regexp_matches(w, '^\\p{{Nd}}{{16}}$') GROUP BY ALL""",
)
def sixteen_digit_candidates(spark, sf):
    found = F.filter(T.tokenize("text"), token_is_nik)
    docs = base.texts(spark, sf, "documents").where(F.rlike("text", F.lit(NIK_TOKEN.strip("^$"))))
    return (
        explode_rows(docs, ["doc_id"], found, "token")
        .groupBy("doc_id", "token")
        .agg(F.count("*").alias("n"))
        .withColumn("province_ok", nik.checks_calendar(F.col("token"))["province_ok"])
    )


@query(
    "tag_documents",
    f"""WITH t AS (SELECT lang, source, regexp_extract_all(text, '{S.TOKEN}') AS tokens FROM documents),
p AS (SELECT lang, source, unnest({S.REGEX_PRED}) AS label FROM t)
SELECT lang, source, label, count(*) AS n FROM p GROUP BY ALL""",
)
def tag_documents(spark, sf):
    return (
        explode_rows(
            base.texts(spark, sf, "documents"), ["lang", "source"], tag_regex(T.tokenize("text")), "label"
        )
        .groupBy("lang", "source", "label")
        .agg(F.count("*").alias("n"))
    )


@query(
    "neighbour_words",
    f"""WITH d AS (SELECT conv_id, turn, regexp_extract_all(text, '{S.TOKEN}') AS t FROM conversations),
u AS (SELECT conv_id, turn, unnest(t) AS w, generate_subscripts(t, 1) AS pos FROM d),
n AS (SELECT w, lag(w) OVER x AS p1, lag(w, 2) OVER x AS p2, lead(w) OVER x AS n1, lead(w, 2) OVER x AS n2 FROM u
  WINDOW x AS (PARTITION BY conv_id, turn ORDER BY pos))
SELECT lower(w) AS word, count(*) AS n, count(*) FILTER (p1 IS NULL) AS bos, count(*) FILTER (n1 IS NULL) AS eos,
  count(DISTINCT lower(p1)) AS left_1, count(DISTINCT lower(p2)) AS left_2, count(DISTINCT lower(n1)) AS right_1,
  count(DISTINCT lower(n2)) AS right_2 FROM n GROUP BY ALL""",
)
def neighbour_words(spark, sf):
    around = lambda low: F.transform(
        low,
        lambda w, i: F.struct(
            w.alias("w"), F.get(low, i - 1).alias("p1"), F.get(low, i - 2).alias("p2"),
            F.get(low, i + 1).alias("n1"), F.get(low, i + 2).alias("n2"),
        ),
    )
    words = let(around, T.token_lowers(T.tokenize("text")))
    return (
        explode_rows(base.texts(spark, sf, "conversations"), [], words, "a")
        .groupBy(F.col("a.w").alias("word"))
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.col("a.p1").isNull()).alias("bos"),
            F.count_if(F.col("a.n1").isNull()).alias("eos"),
            *[
                F.count_distinct(f"a.{c}").alias(n)
                for c, n in (("p1", "left_1"), ("p2", "left_2"), ("n1", "right_1"), ("n2", "right_2"))
            ],
        )
    )


# --- IDs and phones --------------------------------------------------------------------------

_PARTS = """p AS (SELECT sample_id, nik, regexp_matches(nik, '^[0-9]{16}$') AS is16, TRY_CAST(substr(nik, 1, 2) AS INTEGER) AS pp,
  TRY_CAST(substr(nik, 7, 2) AS INTEGER) AS dd, TRY_CAST(substr(nik, 9, 2) AS INTEGER) AS mm, TRY_CAST(substr(nik, 11, 2) AS INTEGER) AS yy FROM niks)"""
_PROV = ", ".join(str(p) for p in PROVINCES)
_LAST = lambda y: f"CASE WHEN mm BETWEEN 1 AND 12 THEN day(last_day(make_date({y}, mm, 1))) END"
_CAL = f"""c AS (SELECT *, is16 AND pp IN ({_PROV}) AS province_ok,
  is16 AND coalesce((CASE WHEN dd > 40 THEN dd - 40 ELSE dd END) BETWEEN 1 AND {_LAST('CASE WHEN yy <= 29 THEN 2000 + yy ELSE 1900 + yy END')}, FALSE) AS date_ok FROM p)"""


@query("nik_checks_calendar", S.with_(S.niks(), _PARTS, _CAL) + "SELECT sample_id, nik, is16, province_ok, date_ok FROM c")
def nik_checks_calendar(spark, sf):
    return base.niks(spark, sf).select("sample_id", "nik", nik.checks_calendar(F.col("nik")).alias("c")).select("sample_id", "nik", "c.*")


@query(
    "nik_checks_range",
    S.with_(S.niks(), _PARTS)
    + """SELECT sample_id, nik, is16, is16 AND pp BETWEEN 11 AND 94 AS province_ok,
  is16 AND (dd BETWEEN 1 AND 31 OR dd BETWEEN 41 AND 71) AND mm BETWEEN 1 AND 12 AS date_ok FROM p""",
)
def nik_checks_range(spark, sf):
    return base.niks(spark, sf).select("sample_id", "nik", nik.checks_range(F.col("nik")).alias("c")).select("sample_id", "nik", "c.*")


@query(
    "nik_score",
    S.with_(S.niks(), _PARTS, _CAL)
    + """SELECT sample_id, CAST(CASE WHEN NOT is16 THEN 0 WHEN NOT province_ok THEN 0.33 WHEN NOT date_ok THEN 0.67 ELSE 1 END AS DOUBLE) AS score FROM c""",
)
def nik_score(spark, sf):
    return base.niks(spark, sf).select("sample_id", nik.score(F.col("nik")).alias("score"))


_VALID = f"""v AS (SELECT *, CASE WHEN dd >= 41 THEN dd - 40 ELSE dd END AS d, CASE WHEN yy < 26 THEN 2000 + yy ELSE 1900 + yy END AS y FROM p),
r AS (SELECT *, CASE WHEN NOT is16 THEN 'Panjang bukan 16 digit atau bukan angka'
  WHEN pp NOT IN ({_PROV}) THEN 'Kode provinsi ' || pp || ' tidak valid'
  WHEN mm NOT BETWEEN 1 AND 12 THEN 'Bulan ' || mm || ' tidak valid (harus 1-12)'
  WHEN d NOT BETWEEN 1 AND 31 THEN 'Tanggal ' || d || ' tidak valid'
  WHEN d > {_LAST('y')} THEN 'Tanggal ' || d || ' tidak valid untuk bulan ' || mm || ' tahun ' || y END AS reason FROM v)"""
_PROV_NAMES = "(VALUES " + ", ".join(f"({k}, {S.q(v)})" for k, v in PROVINCES.items()) + ") AS prov(code, name)"


@query(
    "nik_validate",
    S.with_(S.niks(), _PARTS, _VALID)
    + f"""SELECT sample_id, reason IS NULL AS valid, reason, CASE WHEN reason IS NULL THEN name END AS province,
  CASE WHEN reason IS NULL THEN CASE WHEN dd >= 41 THEN 'P' ELSE 'L' END END AS gender,
  CASE WHEN reason IS NULL THEN CAST(make_date(y, mm, d) AS VARCHAR) END AS birth_date
FROM r LEFT JOIN {_PROV_NAMES} ON pp = code""",
)
def nik_validate(spark, sf):
    v = nik.validate(F.col("nik"))
    return base.niks(spark, sf).select("sample_id", v.alias("v")).select(
        "sample_id", "v.valid", "v.reason", "v.province", "v.gender", F.col("v.birth_date").cast("string").alias("birth_date")
    )


@query(
    "nik_decode",
    S.with_(S.niks())
    + """SELECT sample_id, substr(nik, 1, 2) AS province_code, substr(nik, 3, 2) AS regency_code, substr(nik, 5, 2) AS district_code,
  substr(nik, 7, 2) AS day, substr(nik, 9, 2) AS month, substr(nik, 11, 2) AS year, substr(nik, 13, 4) AS serial,
  CASE WHEN CAST(substr(nik, 7, 2) AS INTEGER) > 40 THEN 'P' ELSE 'L' END AS gender FROM niks""",
)
def nik_decode(spark, sf):
    return base.niks(spark, sf).select("sample_id", nik.decode(F.col("nik")).alias("d")).select("sample_id", "d.*")


@query(
    "province_of",
    S.with_(S.niks()) + f"SELECT sample_id, name AS province FROM niks LEFT JOIN {_PROV_NAMES} ON TRY_CAST(substr(nik, 1, 2) AS INTEGER) = code",
)
def province_of(spark, sf):
    code = F.substring("nik", 1, 2).try_cast("int")
    return base.niks(spark, sf).select("sample_id", nik.province_name(code).alias("province"))


@query(
    "nik_population_profile",
    S.with_(S.niks(), _PARTS, _VALID)
    + """SELECT count(*) AS n, count(*) FILTER (reason IS NULL) AS n_valid, count(DISTINCT CASE WHEN reason IS NULL THEN pp END) AS provinces,
  count(*) FILTER (reason IS NULL AND dd < 41) AS male, count(*) FILTER (reason IS NULL AND dd >= 41) AS female FROM r""",
)
def nik_population_profile(spark, sf):
    return profile.nik_population(base.niks(spark, sf))


@query(
    "top_provinces",
    S.with_(S.niks(), _PARTS, _VALID)
    + f"SELECT name AS province, count(*) AS n FROM r JOIN {_PROV_NAMES} ON pp = code WHERE reason IS NULL GROUP BY name ORDER BY n DESC, name LIMIT 5",
)
def top_provinces(spark, sf):
    return profile.top_provinces(base.niks(spark, sf))


@query(
    "days_in_month",
    "SELECT o_orderkey, CAST(day(last_day(CAST(o_orderdate AS DATE))) AS INTEGER) AS days FROM orders",
)
def days_in_month(spark, sf):
    d = F.col("o_orderdate")
    return base.table(spark, sf, "orders").select("o_orderkey", nik.days_in_month(F.month(d), F.year(d)).alias("days"))


@query(
    "phone_checks",
    S.with_(S.people())
    + f"""SELECT sample_id, telepon, regexp_matches(telepon, '^(\\+62|0)[0-9]{{8,12}}$') AS is_phone,
  CASE WHEN telepon LIKE '+62%' THEN left(telepon, 5) WHEN telepon LIKE '0%' THEN left(telepon, 4) END IN
  ({', '.join(S.q(p) for p in PHONE_PREFIXES)}) AS prefix_ok, regexp_replace(telepon, '^0', '+62') AS international FROM people""",
)
def phone_checks(spark, sf):
    t = F.col("telepon")
    return base.people(spark, sf).select(
        "sample_id", "telepon", phone.is_phone(t).alias("is_phone"), phone.prefix_valid(t).alias("prefix_ok"),
        phone.to_international(t).alias("international"),
    )
