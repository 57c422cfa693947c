"""DuckDB SQL for the queries that SQL can express."""

from itertools import permutations

from . import benchmark_search, centroid_clustering, filter_audit, raking, url_reputation

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _strength(groups: str, name: str) -> str:
    """One row (m, mean): the moment estimate of a beta prior over groups (n, bad)."""
    return f"""{name}_s AS (SELECT count(n) AS k, coalesce(sum(n), 0)::DOUBLE AS t, sum(n * n)::DOUBLE AS q, coalesce(sum(bad), 0)::DOUBLE AS b, sum(bad * bad / n::DOUBLE) AS v
  FROM {groups} WHERE n > 0),
{name}_r AS (SELECT *, CASE WHEN t > 0 AND b > 0 AND b < t THEN (v - t * (b / t) * (b / t)) / ((b / t) * (1 - b / t)) - (k - 1) END AS spread,
  CASE WHEN t > 0 THEN t - q / t - (k - 1) END AS room FROM {name}_s),
{name} AS (SELECT greatest({url_reputation.MIN_STRENGTH}, least({url_reputation.MAX_STRENGTH}, t,
  CASE WHEN room <> 0 AND spread / room > 0 THEN room / spread - 1 ELSE {url_reputation.MAX_STRENGTH} END)) AS m, (b + 0.5) / (t + 1) AS mean FROM {name}_r)"""


def host_reputation() -> str:
    two = ", ".join(f"'{s}'" for s in url_reputation.SUFFIXES)
    rules = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in url_reputation.RULES)
    return rf"""WITH p AS (SELECT page_id, {_LOWER.format(r"coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '')")} AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
o AS (SELECT doc_id, count(*) AS n, sum(bad) AS bad FROM (SELECT page_id AS doc_id, regexp_matches({_LOWER.format("host || path")}, '{url_reputation.bad_url()}')::INT AS bad FROM p
  UNION ALL SELECT doc_id, CASE WHEN coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1 THEN 1 ELSE 0 END FROM labels) WHERE doc_id IS NOT NULL GROUP BY doc_id),
h0 AS (SELECT host, coalesce(sum(n), 0) AS n, coalesce(sum(bad), 0) AS bad FROM p LEFT JOIN o ON doc_id = page_id GROUP BY host),
h1 AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$|\.+$', '') AS bare FROM h0), h2 AS (SELECT *, string_split(bare, '.') AS l FROM h1),
hosts AS (SELECT host, n, bad, CASE WHEN ip THEN '' WHEN two THEN array_to_string(l[-2:], '.') ELSE l[-1] END AS suffix,
  CASE WHEN ip THEN bare WHEN two THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain
  FROM (SELECT *, regexp_matches(bare, '^[0-9.]*$|^\[') OR len(l) < 2 AS ip, len(l) > 2 AND array_to_string(l[-2:], '.') IN ({two}) AS two FROM h2)),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
{_strength('suffixes', 'ms')}, {_strength('domains', 'md')}, {_strength('hosts', 'mh')},
sr AS (SELECT suffix, (bad + m * mean) / (n + m) AS rate FROM suffixes CROSS JOIN ms),
dr AS (SELECT domain, suffix, (bad + m * rate) / (n + m) AS rate FROM domains CROSS JOIN md JOIN sr USING (suffix)),
hr AS (SELECT host, n, (bad + m * rate) / (n + m) AS rate, n + m AS total FROM hosts CROSS JOIN mh JOIN dr USING (domain, suffix)),
hb AS (SELECT host, n, rate, greatest(0.0, rate - {url_reputation.Z} * sqrt(rate * (1 - rate) / (total + 1))) AS bound FROM hr),
r AS (SELECT page_id, host, path, arg_max(action, length(rh || rp)) AS action, arg_max(rh || rp, length(rh || rp)) AS rule FROM p JOIN (VALUES {rules}) t(action, rh, rp)
  ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY ALL)
SELECT p.page_id, p.host, p.path, r.rule, coalesce(r.action, CASE WHEN round(bound, 6) > {url_reputation.MAX_BAD} THEN 'block' ELSE 'allow' END) AS verdict,
  hb.n::BIGINT AS labelled, round(rate, 6) AS bad_rate, round(bound, 6) AS bad_bound FROM p JOIN hb USING (host) LEFT JOIN r USING (page_id, host, path)"""


def ngram_join() -> str:
    return rf"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS n, any_value(b.n) AS m FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * c >= 85 * (n + m - c)), e AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS u, b AS v FROM e UNION SELECT r.u, e.b FROM reach r JOIN e ON r.v = e.a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id FROM s LEFT JOIN (SELECT u, min(v) AS m FROM reach GROUP BY u) ON u = doc_id"""


def substring_dedup() -> str:
    return rf"""WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
x AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w), h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM x),
f AS (SELECT h, min((doc_id, i)) AS f FROM h GROUP BY h), later AS (SELECT doc_id, i FROM h JOIN f USING (h) WHERE (doc_id, i) > f),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM later),
each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS t FROM each ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def line_dedup() -> str:
    key = _LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")
    return f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, {key} AS key FROM l), c AS (SELECT key, true AS common FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(common) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (common IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c USING (key) GROUP BY doc_id"""


def mixing() -> str:
    fits, last = [], "f0"
    for n, dim in enumerate(list(raking.DIMS) * raking.ROUNDS, 1):
        fits.append(f"f{n} AS (SELECT {last}.* REPLACE (share * target / sum(share) OVER (PARTITION BY {last}.{dim}) AS share) FROM {last} JOIN t_{dim} USING ({dim}))")
        last = f"f{n}"
    targets = [
        f"t_{d} AS (SELECT {d}, pow(t, {raking.TEMPER}) / sum(pow(t, {raking.TEMPER})) OVER () AS target FROM (SELECT {d}, sum(tokens)::DOUBLE AS t FROM cells GROUP BY {d}))"
        for d in raking.DIMS
    ]
    t = "coalesce(text, '')"
    return rf"""WITH d AS (SELECT doc_id, source, lang, coalesce(source, '') AS s, coalesce(lang, '') AS l, {t} AS t, len({_WORDS.format(t)}) + 1 AS tokens FROM documents),
docs AS (SELECT *, CASE WHEN tokens < 2 THEN 'empty' WHEN (length(t) - length(regexp_replace(t, '[#*$%&|<>{{}}\[\]=]', '', 'g'))) * 20 > length(t) THEN 'markup'
  WHEN (length(t) - length(regexp_replace(t, '[0-9]', '', 'g'))) * 20 > length(t) THEN 'figures' WHEN tokens < 101 THEN 'note' WHEN tokens < 1001 THEN 'article' ELSE 'book' END AS topic FROM d),
cells AS (SELECT s AS source, l AS lang, topic, sum(tokens) AS tokens FROM docs GROUP BY ALL), {', '.join(targets)},
f0 AS (SELECT *, tokens::DOUBLE AS share FROM cells), {', '.join(fits)},
p AS (SELECT source, lang, topic, factor, factor * {raking.SHARE}::DOUBLE AS probability FROM (SELECT *, round(share * sum(tokens) OVER () / (tokens * sum(share) OVER ()), 6) AS factor FROM {last})),
r AS (SELECT doc_id, docs.source, docs.lang, docs.topic, docs.tokens::BIGINT AS tokens, factor, probability, ('0x' || substr(md5('{raking.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0 AS draw
  FROM docs JOIN p ON p.source = s AND p.lang = l AND p.topic = docs.topic)
SELECT * EXCLUDE (draw), draw < probability AS kept, (floor(probability) + (draw < probability - floor(probability))::INTEGER)::INTEGER AS copies FROM r"""


def centroid_clustering_sql() -> str:
    c = centroid_clustering
    ctes = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, x, list_dot_product(x, x) AS xx FROM (SELECT vec_id, list_transform(embedding, lambda e: floor(e::DOUBLE * {c.SCALE})) AS x FROM embeddings
  WHERE len(embedding) = {c.COMPONENTS} AND len(list_filter(embedding, lambda e: coalesce(isfinite(e), false))) = {c.COMPONENTS}))""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{c.SEED}:' || vec_id) NULLS LAST, x) - 1 AS k, x AS c FROM v QUALIFY k < {c.K})",
    ]
    for n in range(c.ROUNDS + 1):
        ctes.append(f"""a{n} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(x) AS x, min((xx - 2 * list_dot_product(x, c) + list_dot_product(c, c), k)) AS m FROM v CROSS JOIN c{n} GROUP BY r)""")
        if n < c.ROUNDS:
            ctes.append(f"""s{n} AS (SELECT k, list(floor(s / n) ORDER BY j) AS c FROM (SELECT m[2] AS k, j, sum(e) AS s, count(*) AS n FROM (SELECT m, unnest(x) AS e, generate_subscripts(x, 1) AS j FROM a{n}) GROUP BY ALL) GROUP BY k)""")
            ctes.append(f"c{n + 1} AS MATERIALIZED (SELECT k, coalesce(s.c, o.c) AS c FROM c{n} o LEFT JOIN s{n} s USING (k))")
    last = f"a{c.ROUNDS}"
    return f"""WITH {', '.join(ctes)},
h AS (SELECT k, sha256(array_to_string(list_transform(c, lambda e: e::BIGINT), ',')) AS centroid_sha256 FROM c{c.ROUNDS}),
d AS (SELECT vec_id, m[2] AS k, m[1]::BIGINT AS distance FROM {last})
SELECT vec_id, k::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256 FROM d JOIN h USING (k)"""


def benchmark_search_sql() -> str:
    n = benchmark_search.WINDOW
    words = lambda t: rf"regexp_extract_all({_LOWER.format(t)}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""WITH b AS (SELECT item_id::VARCHAR AS item, {words("coalesce(text, '')")} AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(len(w), {n}) AS n, array_to_string(w[i:i + least(len(w), {n}) - 1], ' ') AS p FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {n - 1}, least(len(w), 1)) + 1)) AS i FROM b)),
d AS (SELECT row_number() OVER () AS r, doc_id, {words("coalesce(text, '')")} AS w FROM documents), ln AS (SELECT DISTINCT n FROM p),
x AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS p FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN ln WHERE len(w) >= n)),
o AS (SELECT r, i, n, item FROM x JOIN p USING (n, p)), hit AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS j FROM o) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM o WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)"""


def filter_audit_sql() -> str:
    letters = filter_audit.FILTERS
    steps = []
    for order in permutations(letters):
        for k in range(len(letters)):
            before = sum(1 << letters.index(f) for f in order[:k])
            steps.append(f"('{''.join(order)}', {k + 1}, {1 << letters.index(order[k])}, {before})")
    return rf"""WITH l AS (SELECT doc_id, max(coalesce((quality = 1)::INT, 0)) AS good, max(coalesce((toxic = 1)::INT, 0)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents), f AS (SELECT t, min(doc_id) AS m FROM d GROUP BY t),
x AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > m, false)::INT AS p FROM d JOIN f USING (t) LEFT JOIN l USING (doc_id)),
c AS (SELECT part, p, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM x GROUP BY ALL),
s AS (SELECT * FROM (VALUES {', '.join(steps)}) s(filter_order, step, own, before)),
r AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (p & (before | own) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (p & before = 0 AND p & own > 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (p & before > 0 AND p & own > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (p = own), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (p & before = 0 AND p & own > 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (p & before = 0 AND p & own > 0), 0)::BIGINT AS toxic_lost FROM c CROSS JOIN s GROUP BY ALL)
SELECT * EXCLUDE (own), (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r"""


ORACLES = {
    "op1_host_reputation": host_reputation(),
    "op3_ngram_join": ngram_join(),
    "op5_substring_dedup": substring_dedup(),
    "op7_line_dedup": line_dedup(),
    "op10_mixing": mixing(),
    "op11_centroid_clustering": centroid_clustering_sql(),
    "op12_benchmark_search": benchmark_search_sql(),
    "op13_filter_audit": filter_audit_sql(),
}
