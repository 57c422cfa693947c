"""Column functions against hand-made rows and Python's own text functions."""

import random
import re
from urllib.parse import quote, unquote

import pytest
from pyspark.sql import functions as F

from tagmill.functions import labels as L, nik, phone, text as T, verdicts

TOKENS = re.compile(r"\+62\d{8,12}|\d+|[a-zA-ZÀ-ſ]+|[^\w\s]")
TEXTS = [
    '{"nik": "3274635212890001"}',
    "nomor_induk=3274635212890001&nama_lengkap=Rina Sari",
    "+62812345678901234",
    "Rp 12,345,678",
    "   ",
    "",
    "Éa ×÷ ſ кириллица ² ٣٤ 📧 a b c\x1cd\x85e",
]
WORDS = ["Budi", "NIK", "budi", "1234", ":", "ÉCOLE", "École", "×", "Ŷ", "aB", "Ab×Cd", "ß", "ĳ"]


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", expr(F.col("v")).alias("o")).orderBy("i").collect()]


def test_tokenize_as_python(spark):
    assert column(spark, TEXTS, T.tokenize) == [TOKENS.findall(t) for t in TEXTS]


def test_gaps_and_tokens_rebuild_the_text(spark):
    both = column(spark, TEXTS, lambda v: F.struct(T.tokenize(v).alias("t"), T.token_gaps(v).alias("g")))
    for source, r in zip(TEXTS, both):
        assert len(r["g"]) == len(r["t"]) + 1
        assert "".join(g + t for g, t in zip(r["g"], r["t"] + [""])) == source


@pytest.mark.parametrize("values", [["a+b", "a%20b", "100%", "%zz", "caf%C3%A9", "+62%2B1", "%", ""]])
def test_unquote_as_python(spark, values):
    assert column(spark, values, T.url_unquote) == [unquote(v) for v in values]


def test_quote_as_python(spark):
    values = ["Rina Sari", "a/b~c*d", "é&=+", "x_y-z.0"]
    assert column(spark, values, T.url_quote) == [quote(v) for v in values]


def test_case_flags_as_python(spark):
    assert column(spark, WORDS, T.is_upper) == [w.isupper() for w in WORDS]
    assert column(spark, WORDS, T.is_title) == [w.istitle() for w in WORDS]
    assert column(spark, WORDS, T.is_alpha) == [w.isalpha() for w in WORDS]


def test_shapes(spark):
    def shape(w):
        return "".join("d" if c.isdigit() else "X" if c.isupper() else "x" if c.islower() else "." for c in w)

    assert column(spark, WORDS, T.word_shape) == [shape(w) for w in WORDS]
    assert column(spark, WORDS, T.word_shape_simple) == [re.sub(r"(.)\1+", r"\1", shape(w)) for w in WORDS]
    arrays = [WORDS, [], ["a"]]
    assert column(spark, arrays, T.token_shapes, "array<string>") == [[shape(w) for w in ws] for ws in arrays]
    assert column(spark, arrays, T.token_lowers, "array<string>") == [[w.lower() for w in ws] for ws in arrays]


# token, is16, province, date, score, range validator
NIK_CASES = [
    ("3201234567890123", True, True, False, 0.67, (True, True, False)),
    ("3274635212890001", True, True, True, 1.0, (True, True, True)),
    ("9876543210987654", True, False, False, 0.33, (True, False, False)),
    ("2001010102001234", True, False, True, 0.33, (True, True, True)),
    ("3201310102001234", True, True, True, 1.0, (True, True, True)),
    ("3274021302001234", True, True, True, 1.0, (True, True, True)),
    ("3274021302011234", True, True, True, 1.0, (True, True, True)),
    ("3201013102011234", True, True, False, 0.67, (True, True, True)),
    ("3201012902001234", True, True, True, 1.0, (True, True, True)),
    ("3201012902011234", True, True, False, 0.67, (True, True, True)),
    ("3201013501001234", True, True, False, 0.67, (True, True, False)),
    ("abcdefghijklmnop", False, False, False, 0.0, (False, False, False)),
    ("32012345678901", False, False, False, 0.0, (False, False, False)),
]


def test_nik_validators(spark):
    niks = [c[0] for c in NIK_CASES]
    assert [tuple(r) for r in column(spark, niks, nik.checks_calendar)] == [c[1:4] for c in NIK_CASES]
    assert column(spark, niks, nik.score) == [c[4] for c in NIK_CASES]
    assert [tuple(r) for r in column(spark, niks, nik.checks_range)] == [c[5] for c in NIK_CASES]


def test_nik_validate_reasons(spark):
    rows = column(
        spark,
        ["3274635212890001", "2001010102001234", "3201010113001234", "3201013501001234", "3201012902011234", "12"],
        nik.validate,
    )
    assert [r["valid"] for r in rows] == [True, False, False, False, False, False]
    assert rows[0]["province"] == "Jawa Barat" and rows[0]["gender"] == "P" and str(rows[0]["birth_date"]) == "1989-12-12"
    assert rows[1]["reason"] == "Kode provinsi 20 tidak valid"
    assert rows[2]["reason"] == "Bulan 13 tidak valid (harus 1-12)"
    assert rows[3]["reason"] == "Tanggal 35 tidak valid"
    assert rows[4]["reason"] == "Tanggal 29 tidak valid untuk bulan 2 tahun 2001"


def test_phone_cases(spark):
    cases = [
        ("081234567890", True, True), ("+6281234567890", True, True), ("+6287712345678", True, True),
        ("087712345678", True, False), ("089612345678", True, False), ("0812345", False, True),
        ("021555012345", True, False), ("6281234567890", False, False),
    ]
    phones = [c[0] for c in cases]
    assert column(spark, phones, phone.is_phone) == [c[1] for c in cases]
    assert column(spark, phones, phone.prefix_valid) == [c[2] for c in cases]
    assert column(spark, ["0812", "+62812"], phone.to_international) == ["+62812", "+62812"]


def _spans(labels, keep_orphans=False):
    out, current = [], None
    for i, label in enumerate(labels):
        kind = label[2:]
        if label.startswith("B-"):
            current = [kind, i, i]
            out.append(current)
        elif label.startswith("I-") and current and current[0] == kind:
            current[2] = i
        elif label.startswith("I-") and keep_orphans:
            current = [kind, i, i]
            out.append(current)
        else:
            current = None
    return [tuple(s) for s in out]


def _random_labels(rng, n):
    pool = ["O", "B-NAMA", "I-NAMA", "B-LOKASI", "I-LOKASI", "B-NIK"]
    return [rng.choice(pool) for _ in range(n)]


@pytest.mark.parametrize("keep", [False, True])
def test_entity_spans_as_plain_loop(spark, keep):
    rng = random.Random(7)
    seqs = [_random_labels(rng, rng.randint(0, 25)) for _ in range(400)]
    got = column(spark, seqs, lambda v: L.entity_spans(v, keep_orphans=keep), "array<string>")
    assert [[tuple(s) for s in r] for r in got] == [_spans(s, keep) for s in seqs]


def test_order_violations(spark):
    seqs = [["I-NAMA"], ["B-NAMA", "I-NAMA", "I-LOKASI"], ["O", "I-NAMA", "I-NAMA"], []]
    assert column(spark, seqs, L.order_violations, "array<string>") == [1, 1, 1, 0]


def test_verdicts(spark):
    values = [-0.1, 0.1, 0.3, 0.5, 0.7, 0.8]
    assert column(spark, values, verdicts.landis_koch, "double") == [
        "Poor", "Slight", "Fair", "Moderate", "Substantial", "Almost Perfect",
    ]
    assert column(spark, [0.01, 0.1, 0.2], verdicts.gap_status, "double") == ["Robust", "Mild gap", "Large gap"]
    assert column(spark, [0.0001, 0.005, 0.03, 0.5], verdicts.significance_stars, "double") == ["***", "**", "*", "ns"]
    assert column(spark, [31.0, 20.0, 5.0], lambda v: verdicts.rate_marker(v, F.lit("FP")), "double") == ["bad", "warn", "good"]
    assert column(spark, [7, 123, 4567], T.sample_code, "bigint") == ["sample_007", "sample_123", "sample_4567"]
