"""Token features: word form, neighbours, context words, ID structure, term lists."""

import re

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import nik, phone
from ..functions.fixed import NEGATIVE_KEYWORDS, TITLE_MARKERS
from ..functions.let import let
from ..functions.labels import token_is_nik, token_is_phone
from ..functions.text import collapsed_shapes, is_alpha, is_digits, is_title, is_upper, token_lowers, token_shapes
from . import gazetteer as gz
from .common import explode_rows, lookup_join, materialize, with_row_key
from .sparse import MODEL_BYTES
from .trie import TokenTrie, term_bits, token_trie

WINDOW = 10
TERM_LISTS = {
    "jabatan_tokens": "in_jabatan_dict",
    "jabatan_prefix": "is_jabatan_prefix",
    "lokasi_tokens": "in_lokasi_dict",
    "nama_prefixes": "in_nama_dict",
    "nik_labels": "nik_label",
    "phone_labels": "phone_label",
}
PHRASE_LISTS = {"jabatan_phrases": "bigram_jabatan", "lokasi_phrases": "bigram_lokasi"}
FLAGS = [*TERM_LISTS.values(), *PHRASE_LISTS.values(), "negative"]


def _any(terms: list[str], word: Column) -> Column:
    return word.isin(terms) if terms else F.lit(False)


def _near(flags: Column, n: Column, after: bool = False, width: int = WINDOW) -> Column:
    """Per token of ``n`` whether a flag stands at most ``width`` tokens before it, or after it with ``after``.

    The flags become one string of marks, which one regular expression looks around in; a slice per
    token would copy the whole row for each.
    """
    before = rf"(?<=1.{{0,{width - 1}}})."
    marks = F.array_join(F.transform(flags, lambda x: F.when(x, "1").otherwise("0")), "")
    marks = F.rpad(marks, F.greatest(n, F.size(flags)), "0")
    found = F.regexp_replace(marks, rf"{before}|.(?=.{{0,{width - 1}}}1)" if after else before, "T")
    return F.transform(F.split(found, ""), lambda c: c == "T")


def _negative_word(lower: Column, keywords: list[str]) -> Column:
    """A keyword as the whole cleaned word, or anywhere inside the word."""
    if not keywords:
        return F.lit(False)
    clean = F.regexp_replace(lower, r"[^\p{L}\p{N}_]", "")
    return F.rlike(lower, F.lit("|".join(re.escape(k) for k in keywords))) | clean.isin(keywords)


def _in_list(low: Column, test) -> Column:
    """A flag per token."""
    return F.transform(low, lambda t: test(t))


def _pair_in_list(low: Column, test) -> Column:
    """A flag per token for itself and the next one joined by a space."""
    return let(
        lambda ws: F.transform(
            ws, lambda t, i: F.coalesce(test(F.concat(t, F.lit(" "), F.get(ws, i + 1))), F.lit(False))
        ),
        low,
    )


def context_arrays(df: DataFrame, sets: dict[str, list[str]] | None, tokens: str = "tokens") -> DataFrame:
    """Per-token arrays that the feature struct reads: forms and flags, each in one pass.

    Without ``sets`` the flag arrays ``_f_*`` must already be there.
    """
    df = df.withColumns(
        {"_low": token_lowers(tokens), "_shape": token_shapes(tokens)}
    )
    df = df.withColumn("_short", collapsed_shapes("_shape"))
    flags = {
        "_upper": F.transform(tokens, is_upper),
        "_title": F.transform(tokens, is_title),
        "_nik": F.transform(tokens, token_is_nik),
        "_phone": F.transform(tokens, token_is_phone),
    }
    df = df.withColumns(flags)
    pattern = F.exists("_nik", lambda x: x) | F.exists("_phone", lambda x: x)
    if sets is not None:
        low = F.col("_low")
        test = lambda cat: lambda word: _any(sets.get(cat, []), word)
        own = {f"_f_{name}": _in_list(low, test(cat)) for cat, name in TERM_LISTS.items()}
        own |= {f"_f_{name}": _pair_in_list(low, test(cat)) for cat, name in PHRASE_LISTS.items()}
        keywords = sets.get("negative_keywords") or NEGATIVE_KEYWORDS
        own["_f_negative"] = F.when(pattern, _in_list(low, lambda t: _negative_word(t, keywords)))
        df = df.withColumns(own)
    return df


def _feature_structs(tokens: str, use_regex: bool, use_gazetteer: bool, fields: list[str] | None) -> Column:
    """One struct per token, zipped from one array per feature.

    Neighbours are shifted arrays. A lambda reads its own token and flag only, no other column, so
    merged projections cannot put a column's expression into it.
    """
    tok, low, shape, short, upper, title, is_nik, is_phone = (
        F.col(n) for n in (tokens, "_low", "_shape", "_short", "_upper", "_title", "_nik", "_phone")
    )
    flag = lambda name: F.col(f"_f_{name}")
    n = F.size(tok)
    rest = F.array_repeat(F.lit(False), n - 1)
    each = lambda fn, arr=tok: F.transform(arr, lambda x: fn(x))
    where = lambda hits, fn: F.zip_with(tok, hits, lambda w, hit: F.when(hit, fn(w)).otherwise(False))

    def at(arr, k):  # what is over is cut, and what is missing is null, once arrays are zipped
        if k > 0:
            return F.slice(arr, k + 1, n)
        return F.concat(F.array_repeat(F.lit(None), -k), arr)

    cols = {
        "bias": F.array_repeat(F.lit(1.0), n),
        "word_identity": tok,
        "word_lower": low,
        "word_shape": shape,
        "word_shape_simple": short,
        "word_isupper": upper,
        "word_istitle": title,
        "word_isdigit": each(is_digits),
        "word_length": each(F.length),
    }
    for k in (2, 3, 4):
        cols[f"word_prefix_{k}"] = each(lambda t: F.left(t, F.lit(k)), low)
        cols[f"word_suffix_{k}"] = each(lambda t: F.right(t, F.lit(k)), low)
    cols["bos"], cols["eos"] = F.concat(F.array(F.lit(True)), rest), F.concat(rest, F.array(F.lit(True)))
    for name, k in (("m1", -1), ("p1", 1)):
        cols[f"{name}_lower"], cols[f"{name}_shape"] = at(low, k), at(shape, k)
        cols[f"{name}_istitle"], cols[f"{name}_isupper"] = at(title, k), at(upper, k)
    for name, k in (("m2", -2), ("p2", 2)):
        cols[f"{name}_lower"], cols[f"{name}_shape"] = at(low, k), at(shape, k)
    if use_regex:
        checked = lambda fn: where(is_nik, lambda w: fn(nik.checks_range(w)))
        none = F.array_repeat(F.lit(False), n)
        # the negative flags are only there for rows with such a token
        negative = lambda hits: F.when(
            F.exists(hits, lambda x: x),
            F.zip_with(hits, _near(flag("negative"), n, after=True), lambda hit, x: F.when(hit, x).otherwise(False)),
        ).otherwise(none)
        context = lambda name: F.when(F.exists(flag(name), lambda x: x), _near(flag(name), n)).otherwise(none)
        cols |= {
            "matches_nik_pattern": is_nik,
            "matches_phone_pattern": is_phone,
            "has_nik_label_context": context("nik_label"),
            "has_phone_label_context": context("phone_label"),
            "in_form_field_position": F.zip_with(
                at(tok, -1), at(tok, -2), lambda a, b: F.coalesce(a.isin(":", "=") & is_alpha(b), F.lit(False))
            ),
            "nik_structure_complete": checked(lambda c: c["is16"] & c["province_ok"] & c["date_ok"]),
            "nik_province_valid": checked(lambda c: c["province_ok"]),
            "nik_date_valid": checked(lambda c: c["date_ok"]),
            "phone_valid_prefix": where(is_phone, phone.prefix_valid),
            "nik_has_negative_context": negative(is_nik),
            "phone_has_negative_context": negative(is_phone),
        }
    if use_gazetteer:
        cols |= {name: flag(name) for name in ("in_jabatan_dict", "is_jabatan_prefix", "in_lokasi_dict", "in_nama_dict")}
        cols["has_title_marker"] = each(has_title_marker)
        cols |= {name: flag(name) for name in ("bigram_jabatan", "bigram_lokasi")}
    cols = {name: c for name, c in cols.items() if fields is None or name in fields}
    if fields is not None and cols:  # the arrays of the chosen ones may have no place for null tokens
        name, arr = next(iter(cols.items()))
        cols[name] = F.concat(arr, F.array_repeat(F.lit(None), n - F.size(arr)))
    return F.slice(F.arrays_zip(*[c.alias(name) for name, c in cols.items()]), 1, n)


def has_title_marker(word) -> Column:
    return F.rlike(word, F.lit("|".join(re.escape(m) for m in TITLE_MARKERS)))


NEGATIVE = "negative_keywords"


def _pairs_and_words(low: Column) -> Column:
    """The distinct words of a row and its pairs of neighbours."""
    pair = lambda ws: F.transform(F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(0))), lambda t, i: F.concat(t, F.lit(" "), F.get(ws, i + 1)))
    return let(lambda ws: F.array_distinct(F.concat(ws, pair(ws))), low)


def negative_words(df: DataFrame, keywords: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``term``: the words of ``df`` that hold a keyword anywhere, or are one once cleaned.

    For keyword lists of any size: the distinct words' pieces of the keywords' lengths are joined
    to the keywords.
    """
    keywords = materialize(keywords.select(F.col("term").alias("_k")).where("_k <> ''").distinct())
    lengths = [r[0] for r in keywords.select(F.length("_k").alias("n")).distinct().collect()]  # as many as a word has characters
    seen = materialize(explode_rows(df, [], F.array_distinct(token_lowers(tokens)), "term").distinct())
    clean = F.regexp_replace("term", r"[^\p{L}\p{N}_]", "")
    n = F.length("term")
    cut = lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring("term", i, F.lit(k)))
    pieces = F.flatten(F.array(F.array(clean), *[F.when(n >= k, cut(k)).otherwise(F.array().cast("array<string>")) for k in lengths]))
    return explode_rows(seen, ["term"], F.array_distinct(pieces), "_k").join(keywords, "_k", "left_semi").select("term").distinct()


def _term_table(df: DataFrame, gazetteer: DataFrame, tokens: str) -> tuple[DataFrame, list[str] | None]:
    """The term lists that features read, and the negative keywords if they are few enough for a
    plan; if not, the words that hold one are a list of their own."""
    keywords = gz.keywords(gazetteer)
    terms = gazetteer.where(F.col("category").isin([*TERM_LISTS, *PHRASE_LISTS])).select("category", "term")
    if keywords is None:
        words = negative_words(df, gazetteer.where(F.col("category") == NEGATIVE), tokens)
        terms = terms.unionByName(words.select(F.lit(NEGATIVE).alias("category"), "term"))
    return materialize(terms.distinct()), keywords


def _negative_flags(words, keywords: list[str] | None, listed) -> Column:
    return listed if keywords is None else F.transform(words, lambda t: _negative_word(t, keywords))


def _flags_by_trie(df: DataFrame, terms: DataFrame, keywords: list[str] | None, trie: TokenTrie, tokens: str) -> DataFrame:
    """Term-list flags by one sweep of a trie that travels to the tasks; no row is shuffled."""
    lengths = dict.fromkeys([*TERM_LISTS, NEGATIVE], 1) | dict.fromkeys(PHRASE_LISTS, 2)
    out = df.withColumn("_low", token_lowers(tokens))
    out = out.withColumn("_bits", term_bits(out, F.col("_low"), trie, lengths))
    bit = lambda c: 1 << trie.categories.index(c) if c in trie.categories else 0
    test = lambda c: F.transform("_bits", lambda b: b.bitwiseAND(F.lit(bit(c)).cast("long")) != 0)
    flags = {f"_f_{n}": test(c) for c, n in (TERM_LISTS | PHRASE_LISTS).items()}
    flags["_f_negative"] = _negative_flags("_low", keywords, test(NEGATIVE))
    return out.withColumns(flags).drop("_bits")


def _flags_by_join(df: DataFrame, terms: DataFrame, keywords: list[str] | None, tokens: str) -> DataFrame:
    """Term-list flags for term lists too large for a task: distinct words of the samples meet
    the term table by a skew-safe join, and each sample's flags are put back together."""
    df = with_row_key(df)
    lists = TERM_LISTS | PHRASE_LISTS | {NEGATIVE: "negative"}
    bit = {c: 1 << i for i, c in enumerate(lists)}
    own = F.coalesce(*[F.when(F.col("category") == c, b) for c, b in bit.items()])
    masks = terms.groupBy(F.col("term").alias("_w")).agg(F.bit_or(own).alias("_m"))
    pairs = explode_rows(df, ["_row"], _pairs_and_words(token_lowers(tokens)), "_w")
    hits = lookup_join(pairs, masks, "_w").where("_m is not null")
    found = hits.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("_w", "_m"))).alias("_words"))
    out = df.join(found, "_row", "left").withColumn("_low", token_lowers(tokens))
    # one look at the row's map per token and per pair, whatever the number of lists
    mask = lambda word: F.coalesce(F.try_element_at(F.col("_words"), word), F.lit(0))
    two = lambda ws: F.transform(ws, lambda t, i: mask(F.concat(t, F.lit(" "), F.get(ws, i + 1))))
    out = out.withColumns({"_one": F.transform("_low", mask), "_two": let(two, "_low")})
    test = lambda bits, c: F.transform(bits, lambda m: m.bitwiseAND(F.lit(bit[c])) != 0)
    flags = {f"_f_{n}": test("_one", c) for c, n in TERM_LISTS.items()}
    flags |= {f"_f_{n}": test("_two", c) for c, n in PHRASE_LISTS.items()}
    flags["_f_negative"] = _negative_flags("_low", keywords, test("_one", NEGATIVE))
    return out.withColumns(flags).drop("_row", "_words", "_one", "_two")


def token_features(
    df: DataFrame,
    gazetteer: DataFrame | dict | None = None,
    use_regex: bool = True,
    use_gazetteer: bool = True,
    tokens: str = "tokens",
    small_terms: int = gz.SMALL_TERMS,
    fields: list[str] | None = None,
    trie_bytes: int = MODEL_BYTES,
) -> DataFrame:
    """Add ``features``: one struct per token, of all features or of those named in ``fields``.

    Term lists up to a checked size go into the plan as literal sets, larger ones to the tasks as a
    trie of at most ``trie_bytes``, and nothing is shuffled; beyond that they are joined.
    """
    sets = gazetteer
    if isinstance(gazetteer, DataFrame):
        sets = gz.as_sets(gazetteer, small_terms)
        if sets is None:
            terms, keywords = _term_table(df, gazetteer, tokens)
            trie = token_trie(terms, trie_bytes)
            df = _flags_by_join(df, terms, keywords, tokens) if trie is None else _flags_by_trie(df, terms, keywords, trie, tokens)
    elif gazetteer is None:
        sets = {}
    before = [c for c in df.columns if not c.startswith("_")]
    df = context_arrays(df, sets, tokens)
    return df.withColumn("features", _feature_structs(tokens, use_regex, use_gazetteer, fields)).select(*before, "features")


def _fields(df: DataFrame) -> list[str]:
    return df.schema["features"].dataType.elementType.names


def feature_strings(df: DataFrame, names: list[str] | None = None) -> Column:
    """Per token an array of ``name=value`` strings; false and absent features are left out, and
    all but those of ``names`` where these are given."""
    fields = [f for f in _fields(df) if names is None or f in names]
    kinds = {f.name: f.dataType for f in df.schema["features"].dataType.elementType}

    def word(t, f):
        text = F.concat(F.lit(f"{f}="), t[f].cast("string"))
        return F.when(t[f], text) if isinstance(kinds[f], T.BooleanType) else text

    return F.transform(
        "features", lambda t: F.array_compact(F.array(*[word(t, f) for f in fields]).cast("array<string>"))
    )


def long_features(df: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """(id, pos, name, value): one row per feature that is present.

    Both explodes and the values between them are compiled together; a lambda that made the values
    would run interpreted for every feature of every token.
    """
    fields = _fields(df)
    tokens = explode_rows(df, [id_col], "features", "_f", "pos")
    values = F.array(*[F.col("_f")[f].cast("string") for f in fields])
    return (
        tokens.select(id_col, "pos", F.posexplode(values).alias("_k", "value"))
        .where("value is not null")
        .select(id_col, "pos", F.get(F.lit(fields), "_k").alias("name"), "value")
    )
