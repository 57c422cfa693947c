"""Quality rules from public tokenizers: characters per token, byte fallback, token entropy.

Every word of a text is looked up in two public vocabularies: a byte-level one (tokens per word,
ids) and one with byte fallback (pieces that are bare bytes). Per document this gives the
characters per token, the share of byte pieces and the entropy of the token ids; per language
(or script, where there is no language) all documents together give the expectation, scatter and quartiles from which the rejection bands follow.
"""

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame, functions as F

from tagmill.operators.common import checked_join, materialize

from . import words

BYTE_VOCABULARY, PIECE_VOCABULARY = "byte_bpe_50k", "piece_bpe_32k"
MIN_WORDS, MAX_REPEATED, FENCE = 50, 50, 2.0
MEASURES = ("chars_per_token", "byte_share", "entropy")
# Measures with an expectation by length; fits with outliers left out, ridge in documents.
FITTED, ROUNDS, RIDGE = ("chars_per_token", "entropy"), 3, 2.0
_CACHE = 400_000
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
_SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_tokens long, chars_per_token double, byte_share double, entropy double"
)


class _Vocabulary:
    """Tokens of a word by its hash: ids of the byte-level vocabulary (as one flat array),
    number of pieces and of byte pieces of the other."""

    def __init__(self) -> None:
        import sentencepiece
        import tiktoken

        with open(public_tokenizers.path(f"{BYTE_VOCABULARY}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(f"{PIECE_VOCABULARY}.model"))
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])
        self.known: dict[int, tuple[list[int], int, int]] = {}

    def look_up(self, hashes: list[int], data: bytes, starts: list[int], ends: list[int]):
        if len(self.known) > _CACHE:
            self.known.clear()
        missing = [i for i, h in enumerate(hashes) if h not in self.known]
        texts = [data[starts[i] : ends[i]].decode("utf-8", "replace") for i in missing]
        for i, text, pieces in zip(missing, texts, self.pieces.encode(texts, num_threads=1) if texts else []):
            n_bytes = 0 if text.isascii() else int(self.is_byte[pieces].sum())
            self.known[hashes[i]] = (self.encode(" " + text), len(pieces), n_bytes)
        return [self.known[h] for h in hashes]


def _per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values)))
    return total[first[1:]] - total[first[:-1]]


def _repeated(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which words lie in a run of three that occurs again in the same text."""
    out = np.zeros(len(h), bool)
    g = words.grams(h, 3)
    inside = text[: len(g)] == text[2:] if len(g) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    key = g[at] ^ words.mix(text[at] + 1)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    for i in range(3):
        out[at[again] + i] = True
    return out


def _duplicate_lines(text: bytes) -> int:
    seen: set[bytes] = set()
    again = 0
    for line in text.split(b"\n"):
        if line in seen:
            again += 1
        elif line.strip():
            seen.add(line)
    return again


def measure(rows: DataFrame) -> DataFrame:
    """From (``doc_id``, ``band``, ``text``): counts and the three measures, null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _Vocabulary()
        for batch in batches:
            for b in words.blocks(batch.column(0)):
                h, n = b.hashes(), b.counts()
                text = np.repeat(np.arange(len(n)), n)
                distinct, where, inverse = np.unique(h, return_index=True, return_inverse=True)
                data = b.data.tobytes()
                known = vocabulary.look_up(distinct.tolist(), data, b.starts[where].tolist(), b.ends[where].tolist())
                n_ids = np.array([len(k[0]) for k in known], np.int64)
                n_pieces, n_bytes = (np.array([k[i] for k in known], np.int64) for i in (1, 2))
                flat = np.array([x for k in known for x in k[0]], np.int64)
                begin = np.concatenate(([0], np.cumsum(n_ids)))[:-1]
                per_word = n_ids[inverse]
                tokens = _per_text(per_word, b.first)
                shift = np.concatenate(([0], np.cumsum(per_word)))[:-1]
                ids = flat[np.repeat(begin[inverse] - shift, per_word) + np.arange(int(per_word.sum()))] if len(h) else flat
                pair = np.sort(np.repeat(text, per_word) << 20 | ids)
                edge = np.flatnonzero(np.concatenate((np.ones(min(len(pair), 1), bool), pair[1:] != pair[:-1])))
                count = np.diff(np.concatenate((edge, [len(pair)]))).astype(float)
                owner = pair[edge] >> 20
                plogp = np.bincount(owner, count * np.log2(count), len(n)) if len(pair) else np.zeros(len(n))
                with np.errstate(divide="ignore", invalid="ignore"):
                    entropy = np.where(tokens > 0, np.log2(tokens) - plogp / tokens, np.nan)
                    chars = np.concatenate(([0], np.cumsum(((b.data & 0xC0) != 0x80) & ~words._SPACE[b.data])))
                    chars = chars[b.offsets[1:]] - chars[b.offsets[:-1]]
                    symbols = np.concatenate(([0], np.cumsum(_SYMBOL[b.data])))
                    symbols = symbols[b.offsets[1:]] - symbols[b.offsets[:-1]]
                    byte_share = _per_text(n_bytes[inverse], b.first) / _per_text(n_pieces[inverse], b.first)
                    fertility = chars / tokens
                repeat = _per_text(_repeated(h, text).astype(np.int64), b.first)
                lines = [_duplicate_lines(data[i:j]) for i, j in zip(b.offsets[:-1].tolist(), b.offsets[1:].tolist())]
                columns = [pa.array(x, pa.int64()) for x in (n, chars, symbols, lines, repeat, tokens)]
                columns += [pa.array(x, pa.float64(), from_pandas=True) for x in (fertility, byte_share, entropy)]
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(b.lo, b.hi - b.lo) for i in (1, 2)], *columns], ["doc_id", "band", *names])

    names = [c.split()[0] for c in _SCHEMA.split(", ")]
    return rows.select("text", "doc_id", "band").mapInArrow(run, f"doc_id long, band string, {_SCHEMA}")


def script_of(text) -> Column:
    """The script that the first letter belongs to, as the stand-in for a missing language."""
    letter = F.regexp_extract(text, r"\p{L}", 0)
    kinds = ("Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Han", "Hiragana", "Katakana", "Hangul", "Devanagari", "Thai")
    out = F.lit("other")
    for kind in kinds:
        out = F.when(letter.rlike(rf"\p{{Is{kind}}}"), kind.lower()).otherwise(out)
    return out


def _words() -> Column:
    return F.greatest(F.col("n_words"), F.lit(1)).cast("double")


def _length() -> Column:
    return (F.log2(_words()) - 8.0) / 2.0


def _solved(sums: DataFrame, powers: int, ridge: float, name: str) -> DataFrame:
    """Per ``band`` the coefficients of a least-squares fit of each measure from its sums ``{m}_p``
    (of the powers of the regressor) and ``{m}_y`` (of their products with the target). A weak ridge
    on all but the constant keeps the fit of few or equally long texts flat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [b.column(0)]
            for m in FITTED:
                p, y = (np.array(b.column(b.schema.get_field_index(f"{m}_{k}")).to_pylist(), float).reshape(b.num_rows, -1) for k in "py")
                got = []
                for u, v in zip(p, y):
                    a = u[np.add.outer(np.arange(powers), np.arange(powers))] + np.diag([1e-9] + [ridge] * (powers - 1))
                    got.append(np.linalg.solve(a, v).tolist())
                out.append(pa.array(got, pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays(out, ["band", *[f"{m}_{name}" for m in FITTED]])

    return materialize(sums.mapInArrow(run, "band string, " + ", ".join(f"{m}_{name} array<double>" for m in FITTED)))


def _sums(rows: DataFrame, powers: int, x, y, used) -> DataFrame:
    each = []
    for m in FITTED:
        take = lambda v, m=m: F.coalesce(F.sum(F.when(used(m), v)), F.lit(0.0))
        each.append(F.array(*[take(F.pow(x, F.lit(float(i)))) for i in range(2 * powers - 1)]).alias(f"{m}_p"))
        each.append(F.array(*[take(F.pow(x, F.lit(float(i))) * y(m)) for i in range(powers)]).alias(f"{m}_y"))
    return rows.groupBy("band").agg(*each)


def _deviation(m: str) -> Column:
    """How far a text lies from what its length and band let expect."""
    x, c = _length(), F.col(f"{m}_mean")
    return F.col(m) - (c[0] + c[1] * x + c[2] * x * x)


def _standardized(m: str) -> Column:
    v = F.col(f"{m}_var")
    scatter = F.sqrt(F.greatest(v[0] + v[1] / _words(), 0.05 * v[0], F.lit(1e-6)))
    return _deviation(m) / scatter


def _inside(m: str) -> Column:
    z = _standardized(m)
    return (z >= F.col(f"{m}_low")) & (z <= F.col(f"{m}_high"))


def rejection_bands(measured: DataFrame, fence: float = FENCE) -> DataFrame:
    """Per ``band`` what each measure is expected to be and how far it may lie from that, from all
    documents that pass the base rules, copies counted once.

    Characters per token and entropy (relative to the logarithm of the number of tokens) have an expectation quadratic in
    the logarithm of the length (``_mean``) and a variance of a constant and a part that falls with the length (``_var``);
    ``_low`` and ``_high`` bound the deviation in units of that scatter: quartiles widened by ``fence`` times their
    distance, more where a band has few documents. What falls outside is left out and all is fitted again, ``ROUNDS`` times.
    Byte pieces are rare events: their upper quartile is widened by 0.02 as well.
    """
    good = materialize(measured.where("not base_failed").select("band", "n_words", *MEASURES).distinct())
    top = F.percentile_approx("byte_share", [0.25, 0.75], 10_000)
    bytes_high = good.groupBy("band").agg(top.alias("q")).select("band", (F.col("q")[1] + fence * (F.col("q")[1] - F.col("q")[0]) + 0.02).alias("byte_share_high"))
    bands, limits = None, [f"{m}_{k}" for m in FITTED for k in ("mean", "var", "low", "high")]
    for _ in range(ROUNDS):
        rows = good.select("band", "n_words", *FITTED, *[F.lit(True).alias(f"{m}_in") for m in FITTED])
        if bands is not None:
            rows = checked_join(good, bands, "band", "inner").select("band", "n_words", *FITTED, *[_inside(m).alias(f"{m}_in") for m in FITTED])
        used = lambda m: F.col(f"{m}_in")
        mean = _solved(_sums(rows, 3, _length(), F.col, used), 3, RIDGE, "mean")
        rows = checked_join(rows, mean, "band", "inner")
        var = _solved(_sums(rows, 2, 50.0 / _words(), lambda m: F.pow(_deviation(m), F.lit(2.0)), used), 2, 0.1 * RIDGE, "var")
        var = var.select("band", *[F.transform(f"{m}_var", lambda v, i: F.greatest(v, F.lit(0.0)) * F.when(i == 1, 50.0).otherwise(1.0)).alias(f"{m}_var") for m in FITTED])
        rows = checked_join(rows, materialize(var), "band", "inner")
        cut = [F.percentile_approx(F.when(used(m), _standardized(m)), [0.25, 0.75], 10_000).alias(m) for m in FITTED]
        q = rows.groupBy("band").agg(F.count("*").alias("n"), *cut)
        # the scatter is 1, so quartiles nearer than 1 come from many texts alike
        span = lambda m: fence * (1 + 10 / F.col("n")) * F.greatest(F.col(m)[1] - F.col(m)[0], F.lit(1.0))
        edges = [e for m in FITTED for e in ((F.col(m)[0] - span(m)).alias(f"{m}_low"), (F.col(m)[1] + span(m)).alias(f"{m}_high"))]
        bands = materialize(q.select("band", *edges).join(mean, "band").join(var, "band").select("band", *limits))
    return bands.join(bytes_high, "band")


def judge_documents(docs: DataFrame, fence: float = FENCE) -> DataFrame:
    """One row per document: ``doc_id``, the base counts, ``base_failed``, the measures,
    ``reason`` (null, ``base`` or the first measure outside its band) and ``kept``.

    The base fails with fewer than 50 words, or more than half of the words in repeated runs of
    three. Null and empty texts have no words and fail it. Languages are bands of their own;
    without a language the script decides. A band without any document that passes the base
    rejects nothing more; expectation and scatter follow the length (``rejection_bands``). Repeated rows are judged alike; an
    empty table gives an empty one; other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", script_of(text)).alias("band"), text.alias("text"))
    measured = measure(rows)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    relative = F.try_divide("entropy", F.log2(F.greatest(F.col("n_tokens"), F.lit(2)).cast("double")))
    measured = materialize(measured.withColumn("base_failed", failed).withColumn("entropy", relative))
    judged = checked_join(measured, rejection_bands(measured, fence), "band")
    reason = F.when(F.col("base_failed"), "base")
    rare = F.sqrt(1 + 4.0 * MIN_WORDS / _words())  # a few byte pieces weigh more in short texts
    for m in MEASURES:
        outside = ~_inside(m) if m in FITTED else F.col(m) > F.col(f"{m}_high") * rare
        reason = reason.when(outside, m)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        *MEASURES, "band", reason.alias("reason"), reason.isNull().alias("kept"),
    )
