"""The inputs of ``base`` in SQL, for the checks against a second engine.

Written from the definitions, not from the Spark expressions: labels are found by list
search, spans by windows over unnested tokens.
"""

from .catalog import KINDS, QUOTAS, REQUEST_BODIES, TEMPLATES
from ..functions.fixed import (
    ENTITY_FIELDS,
    FOREIGN_LOCATIONS,
    GOVERNMENT_JOBS,
    HOME_LOCATIONS,
    PERSON_NAMES,
    PRIVATE_JOBS,
    PROVINCES,
)

TOKEN = (
    r"\+62\p{Nd}{8,12}|\p{Nd}+|[a-zA-ZÀ-ſ]+"
    r"|[^\p{L}\p{N}_\p{Z}\t\n\v\f\r\x1c-\x1f\x{85}]"
)
FIELDS = ["nik", "nama", "telepon", "jabatan", "lokasi"]


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def pick(values, index: str) -> str:
    items = ", ".join(str(v) if isinstance(v, int) else q(v) for v in values)
    return f"([{items}])[({index}) % {len(values)} + 1]"


def pad(value: str, width: int) -> str:
    text = f"CAST({value} AS VARCHAR)"
    return f"(repeat('0', greatest({width} - length({text}), 0)) || {text})"


def nik(k: str) -> str:
    return " || ".join(
        [
            pad(pick(list(PROVINCES), k), 2),
            pad(f"({k}) * 7 % 99 + 1", 2),
            pad(f"({k}) * 13 % 99 + 1", 2),
            pad(f"({k}) % 28 + 1 + 40 * (({k}) % 2)", 2),
            pad(f"({k}) % 12 + 1", 2),
            pad(f"(40 + ({k}) % 67) % 100", 2),
            pad(f"({k}) % 9999 + 1", 4),
        ]
    )


def people() -> str:
    k = "c_custkey"
    phone = f"{pick(['0812', '0813', '0857', '0877', '0896'], k)} || {pad(k, 8)}"
    return f"""people AS (
  SELECT c_custkey AS sample_id, {nik(k)} AS nik,
    split_part({pick(PERSON_NAMES, k)}, ' ', 1) || ' ' || split_part({pick(PERSON_NAMES, k + ' * 3 + 1')}, ' ', 2) AS nama,
    CASE WHEN {k} % 3 = 0 THEN '+62' || substr({phone}, 2) ELSE {phone} END AS telepon,
    CASE WHEN {k} % 10 < 7 THEN {pick(GOVERNMENT_JOBS, k)} ELSE {pick(PRIVATE_JOBS, k)} END AS jabatan,
    CASE WHEN {k} % 3 = 0 THEN n_name WHEN {k} % 11 = 1 THEN {pick(FOREIGN_LOCATIONS, k)}
         ELSE {pick(HOME_LOCATIONS, k)} END AS lokasi
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def niks() -> str:
    return f"""niks AS (
  SELECT k AS sample_id,
    CASE WHEN k % 17 = 3 THEN substr(n, 1, 8) || '13' || substr(n, 11)
         WHEN k % 19 = 5 THEN '20' || substr(n, 3)
         WHEN k % 23 = 7 THEN substr(n, 1, 6) || '3102' || substr(n, 11)
         WHEN k % 29 = 11 THEN substr(n, 1, 15)
         WHEN k % 31 = 13 THEN n || '7' ELSE n END AS nik
  FROM (SELECT c_custkey AS k, {nik('c_custkey')} AS n FROM customer))"""


def samples(set_name: str = "main", name: str = "samples") -> str:
    low, cases = 0, []
    for kind, share in QUOTAS[set_name]:
        low += share
        cases.append(f"WHEN sample_id % 100 < {low} THEN {q(kind)}")
    numbers = " ".join(f"WHEN {q(k)} THEN (sample_id // 100) % {len(TEMPLATES[k])}" for k, _ in QUOTAS[set_name])
    rows = ", ".join(
        f"({q(kind)}, {i}, {q(fmt)}, {q(cat) if cat else 'NULL'}, {str(has).lower()}, {q(text)})"
        for s, kind, fmt, cat, has in KINDS
        if s == set_name
        for i, text in enumerate(TEMPLATES[kind])
    )
    run = lambda w: pad(f"sample_id * 7919 + {10 ** (w - 1)}", w)
    fills = {f: f for f in FIELDS}
    fills |= {f + "_q": f"replace({f}, ' ', '%20')" for f in ("nama", "jabatan", "lokasi")}
    fills |= {
        "nama2": pick(PERSON_NAMES, "sample_id * 7 + 5"),
        "nik2": nik("sample_id * 3 + 17"),
        "num15": run(15), "num16": run(16), "num17": run(17),
        "amount": f"CAST(sample_id % 990 + 10 AS VARCHAR) || ',' || {pad('sample_id * 7 % 1000', 3)} || ',' || {pad('sample_id * 13 % 1000', 3)}",
        "rec": "CAST(sample_id % 9000 + 1000 AS VARCHAR)",
        "ts": "'2026-01-15 10:20'", "date": "'2026-01-15'",
        "level": pick(["INFO", "DEBUG", "WARN"], "sample_id"),
    }
    text = "template"
    for f, value in fills.items():
        text = f"replace({text}, {q('{' + f + '}')}, {value})"
    kept = ", ".join(
        f"CASE WHEN has_pii AND contains(template, {q('{' + f)}) THEN {f} END AS {f}" for f in FIELDS
    )
    return f"""{name}_t(kind, template_no, format, category, has_pii, template) AS (VALUES {rows}),
{name}_k AS (SELECT *, CASE {' '.join(cases)} END AS kind FROM people),
{name}_n AS (SELECT *, CASE kind {numbers} END AS template_no FROM {name}_k),
{name} AS (
  SELECT sample_id, {text} AS payload, format, {q(set_name)} AS source, CAST(category AS VARCHAR) AS category, has_pii, {kept}
  FROM {name}_n JOIN {name}_t USING (kind, template_no))"""


def _find(tokens: str, target: str) -> str:
    n = f"len({target})"
    return (
        f"CASE WHEN {n} > 0 THEN list_filter(range(0, len({tokens}) - {n} + 1), "
        f"lambda i: {tokens}[i + 1 : i + {n}] = {target})[1] END"
    )


def tagged(src: str = "samples", name: str = "tagged") -> str:
    """Tokens and labels of rendered samples."""
    targets = ", ".join(f"regexp_extract_all({f}, '{TOKEN}') AS v_{f}" for f, _ in ENTITY_FIELDS)
    lows = ", ".join(f"list_transform(v_{f}, lambda x: lower(x)) AS w_{f}" for f, _ in ENTITY_FIELDS)
    starts = ", ".join(
        f"coalesce({_find('tokens', 'v_' + f)}, {_find('lowers', 'w_' + f)}) AS s_{f}, len(v_{f}) AS n_{f}"
        for f, _ in ENTITY_FIELDS
    )
    steps, src_name = [], f"{name}_s"
    done: list[str] = []
    for f, _ in ENTITY_FIELDS:
        clash = " OR ".join(
            f"(k_{o} IS NOT NULL AND s_{f} <= k_{o} + n_{o} - 1 AND k_{o} <= s_{f} + n_{f} - 1)" for o in done
        )
        steps.append(
            f"{name}_{f} AS (SELECT *, CASE WHEN {f'NOT ({clash})' if clash else 'TRUE'} THEN s_{f} END AS k_{f} FROM {src_name})"
        )
        src_name = f"{name}_{f}"
        done.append(f)
    label = "CASE " + " ".join(
        f"WHEN i = k_{f} THEN 'B-{t}' WHEN i > k_{f} AND i < k_{f} + n_{f} THEN 'I-{t}'" for f, t in ENTITY_FIELDS
    ) + " ELSE 'O' END"
    return f"""{name}_a AS (
  SELECT *, regexp_extract_all(CASE WHEN format = 'formdata' THEN url_decode(payload) ELSE payload END, '{TOKEN}') AS tokens, {targets}
  FROM {src}),
{name}_b AS (SELECT *, list_transform(tokens, lambda x: lower(x)) AS lowers, {lows} FROM {name}_a),
{name}_s AS (SELECT *, {starts} FROM {name}_b),
{', '.join(steps)},
{name} AS (SELECT sample_id, payload, format, source, category, has_pii, {', '.join(FIELDS)}, tokens,
  list_transform(range(0, len(tokens)), lambda i: {label}) AS labels FROM {src_name})"""


REGEX_PRED = (
    "list_transform(tokens, lambda t: CASE WHEN regexp_matches(t, '^\\p{Nd}{16}$') THEN 'B-NIK' "
    "WHEN regexp_matches(t, '^(\\+62|0)\\p{Nd}{8,12}$') THEN 'B-PHONE' ELSE 'O' END)"
)
def annotators(src: str = "tagged", name: str = "pairs") -> str:
    return f"""{name} AS (
  SELECT sample_id AS task_id, format, tokens, labels AS labels_a, list_transform(labels, lambda l: CASE
    WHEN sample_id % 5 = 0 AND suffix(l, '-LOKASI') THEN 'O'
    WHEN sample_id % 7 = 1 AND l = 'I-NAMA' THEN 'O'
    WHEN sample_id % 11 = 2 AND l = 'B-JABATAN' THEN 'B-LOKASI'
    WHEN sample_id % 11 = 2 AND l = 'I-JABATAN' THEN 'I-LOKASI'
    WHEN sample_id % 13 = 3 AND l = 'B-NAMA' THEN 'O'
    WHEN sample_id % 13 = 3 AND l = 'I-NAMA' THEN 'B-NAMA' ELSE l END) AS labels_b
  FROM {src})"""


def spans(src: str, keys: str, labels: str, name: str) -> str:
    """(keys, type, s, e): runs of a B- label and the I- labels of its type."""
    return f"""{name}_u AS (SELECT {keys}, unnest({labels}) AS label, generate_subscripts({labels}, 1) - 1 AS pos FROM {src}),
{name}_p AS (SELECT *, lag(label) OVER (PARTITION BY {keys} ORDER BY pos) AS prev FROM {name}_u),
{name}_g AS (SELECT *, sum(CASE WHEN label LIKE 'I-%' AND prev IN (label, 'B-' || label[3:]) THEN 0 ELSE 1 END)
   OVER (PARTITION BY {keys} ORDER BY pos) AS grp FROM {name}_p),
{name} AS (SELECT {keys}, arg_min(label, pos)[3:] AS type, min(pos) AS s, max(pos) AS e FROM {name}_g
   GROUP BY {keys}, grp HAVING arg_min(label, pos) LIKE 'B-%')"""


def counts(truth: str, pred: str, keys: str, group: str, name: str = "cnt") -> str:
    """tp, fp, fn per group and type from two span tables."""
    on = ", ".join([keys, "type", "s", "e"])
    sep = ", " if group else ""
    return f"""{name} AS (
  SELECT {group}{sep}type AS entity, count(t) FILTER (p IS NOT NULL) AS tp, count(p) FILTER (t IS NULL) AS fp,
    count(t) FILTER (p IS NULL) AS fn
  FROM (SELECT *, 1 AS t FROM {truth}) FULL JOIN (SELECT *, 1 AS p FROM {pred}) USING ({on})
  GROUP BY ALL)"""


def metrics(group: str = "", digits: int = 6, cnt: str = "cnt", name: str = "metrics") -> str:
    """Entity, macro and micro rows from counts."""
    sep = ", " if group else ""
    by = f"GROUP BY {group}" if group else ""
    safe = lambda a, b: f"coalesce(({a}) / nullif(CAST({b} AS DOUBLE), 0), 0)"
    return f"""{name}_pr AS (SELECT *, {safe('tp', 'tp + fp')} AS p, {safe('tp', 'tp + fn')} AS r FROM {cnt}),
{name}_f AS (SELECT *, {safe('2 * p * r', 'p + r')} AS f FROM {name}_pr),
{name}_m AS (SELECT {group}{sep}avg(p) AS mp, avg(r) AS mr, avg(f) AS mf, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM {name}_f {by}),
{name}_i AS (SELECT *, {safe('tp', 'tp + fp')} AS ip, {safe('tp', 'tp + fn')} AS ir FROM {name}_m),
{name} AS (
  SELECT {group}{sep}entity, round(p, {digits}) AS precision, round(r, {digits}) AS recall, round(f, {digits}) AS f1,
    CAST(tp + fn AS BIGINT) AS support, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn FROM {name}_f
  UNION ALL SELECT {group}{sep}'_macro', round(mp, {digits}), round(mr, {digits}), round(mf, {digits}),
    CAST(tp + fn AS BIGINT), CAST(tp AS BIGINT), CAST(fp AS BIGINT), CAST(fn AS BIGINT) FROM {name}_i
  UNION ALL SELECT {group}{sep}'_micro', round(ip, {digits}), round(ir, {digits}), round({safe('2 * ip * ir', 'ip + ir')}, {digits}),
    CAST(tp + fn AS BIGINT), CAST(tp AS BIGINT), CAST(fp AS BIGINT), CAST(fn AS BIGINT) FROM {name}_i)"""


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def main_tagged(set_name: str = "main") -> list[str]:
    return [people(), samples(set_name), tagged()]


def requests() -> str:
    k = f"sample_id % {len(REQUEST_BODIES)}"
    body = pick([b for _, _, b in REQUEST_BODIES], k)
    for f in ("nama", "nik", "telepon"):
        body = f"replace({body}, {q('{' + f + '}')}, {f})"
    return f"""requests AS (SELECT CAST(sample_id + 1 AS INTEGER) AS id, {pick([f for f, _, _ in REQUEST_BODIES], k)} AS format,
  nik AS nik_expected, nama AS nama_expected, telepon AS phone_expected,
  {pick([c for _, c, _ in REQUEST_BODIES], k)} AS content_type, {body} AS body FROM people)"""


def logs() -> str:
    line = "=" * 50
    return f"""logs AS (SELECT sample_id AS log_id, '{line}' || chr(10) || 'Intercepted: POST /api/data' || chr(10)
  || 'Original body: {{"nik":"' || nik || '","ref":"1234567890123456"}}' || chr(10)
  || CASE WHEN sample_id % 9 <> 0 THEN '- NIK: ' || nik || ' -> ' || substr(nik, 1, 6) || 'XXXXXXXXXX' || chr(10) ELSE '' END
  || CASE WHEN sample_id % 11 = 0 THEN '- NIK: 99' || substr(nik, 3) || ' -> 99XXXXXXXXXX' || chr(10) ELSE '' END
  || CASE WHEN sample_id % 6 <> 0 THEN 'Total 1 masked | Time: ' || CAST(sample_id % 40 + 1 AS VARCHAR) || '.' || {pad('sample_id * 7 % 100', 2)} || ' ms' || chr(10) ELSE '' END
  || CASE WHEN sample_id % 4 = 0 THEN '{line}==' || chr(10) || 'Intercepted: GET /health' || chr(10) || 'Original body: -' || chr(10) || 'Time: 1.5 ms' || chr(10) ELSE '' END AS value
  FROM people),
expected AS (SELECT DISTINCT nik FROM (SELECT nik FROM people WHERE sample_id % 13 <> 0
  UNION ALL SELECT '88' || substr(nik, 3) FROM people WHERE sample_id % 50 = 0)),
blocks AS (SELECT log_id, block_no - 1 AS block_no, trim(block, ' ' || chr(10)) AS block FROM (
  SELECT log_id, unnest(parts) AS block, generate_subscripts(parts, 1) AS block_no
  FROM (SELECT log_id, regexp_split_to_array(value, '={{50,}}') AS parts FROM logs)) WHERE contains(block, 'Intercepted:')),
parsed AS (SELECT log_id, block_no,
  list_distinct(regexp_extract_all(regexp_extract(block, 'Original body:\\s*(.+)', 1), '\\b[0-9]{{16}}\\b')) AS original_ids,
  list_distinct(regexp_extract_all(block, '-\\s*NIK:\\s*([0-9]{{16}})\\s*->\\s*\\S+', 1)) AS detected_ids,
  (contains(block, 'XXXXXXXXXX') OR (contains(block, 'Total') AND contains(block, 'masked'))) AS masked,
  TRY_CAST(nullif(regexp_extract(block, 'Time:\\s*([0-9.]+)\\s*ms', 1), '') AS DOUBLE) AS latency_ms FROM blocks)"""
