"""Text and token column functions."""

from pyspark.sql import Column, functions as F

from .let import let

# Phone with country code, digit run, Latin word, or one symbol. The last class spells out
# the Unicode word and space characters, which Java's \w and \s leave to ASCII.
TOKEN_PATTERN = (
    r"\+62\p{Nd}{8,12}|\p{Nd}+|[a-zA-ZÀ-ſ]+"
    r"|[^\p{L}\p{N}_\p{Z}\t\n\x0b\f\r\x1c-\x1f\x85]"
)
# No token holds this character, so it can join tokens into one searchable string.
SEP = "\x1f"


def tokenize(text) -> Column:
    """Tokens of a text; an empty array when it has none, NULL for a NULL text."""
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def token_gaps(text) -> Column:
    """The texts around the tokens: one more than there are tokens, possibly empty."""
    return F.split(text, TOKEN_PATTERN, -1)


def join_tokens(tokens) -> Column:
    """Tokens as one string with SEP before, between and after them."""
    return F.concat(F.lit(SEP), F.array_join(tokens, SEP), F.lit(SEP))


def map_tokens(tokens, fn) -> Column:
    """Apply a string function that keeps SEP to all tokens in one pass."""
    return let(
        lambda ts: F.when(F.size(ts) == 0, F.array().cast("array<string>")).otherwise(
            F.split(fn(F.array_join(ts, SEP)), SEP, -1)
        ),
        tokens,
    )


def url_unquote(text) -> Column:
    """Percent-decode; a plus sign stays, and a percent sign without two hex digits too."""
    escaped = F.replace(
        F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B")
    )
    text = F.col(text) if isinstance(text, str) else text
    return F.when(text.contains("%"), F.url_decode(escaped)).otherwise(text)


def url_quote(text) -> Column:
    """Percent-encode; a slash stays, a space becomes %20."""
    out = F.url_encode(text)
    for old, new in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def decoded_payload(payload, fmt) -> Column:
    """Payload as it is tokenised: only form data is percent-decoded."""
    payload = F.col(payload) if isinstance(payload, str) else payload
    fmt = F.col(fmt) if isinstance(fmt, str) else fmt
    return F.when(fmt == "formdata", url_unquote(payload)).otherwise(payload)


def word_shape(word, keep: str = "") -> Column:
    """Digits to d, upper case to X, lower case to x, the rest to a dot.

    ``keep`` names a character to leave alone, so that joined tokens can be mapped at once.
    """
    out = F.regexp_replace(word, rf"[^\p{{Nd}}\p{{Lu}}\p{{Ll}}{keep}]", ".")
    out = F.regexp_replace(out, r"\p{Ll}", "x")
    out = F.regexp_replace(out, r"\p{Lu}", "X")
    return F.regexp_replace(out, r"\p{Nd}", "d")


def word_shape_simple(word) -> Column:
    """Word shape with runs of one character collapsed."""
    return F.regexp_replace(word_shape(word), r"(.)\1+", "$1")


def token_shapes(tokens) -> Column:
    return map_tokens(tokens, lambda s: word_shape(s, SEP))


def collapsed_shapes(shapes) -> Column:
    """Token shapes with runs of one character collapsed."""
    return map_tokens(shapes, lambda s: F.regexp_replace(s, r"([dXx.])\1+", "$1"))


def token_shapes_simple(tokens) -> Column:
    return collapsed_shapes(token_shapes(tokens))


def token_lowers(tokens) -> Column:
    return map_tokens(tokens, F.lower)


def is_upper(word) -> Column:
    """At least one cased letter, and none in lower or title case."""
    return F.rlike(word, F.lit(r"\p{Lu}")) & ~F.rlike(word, F.lit(r"[\p{Ll}\p{Lt}]"))


def is_title(word) -> Column:
    """Every run of cased letters starts with an upper one and goes on in lower case."""
    return F.rlike(
        word,
        F.lit(r"^[^\p{Lu}\p{Ll}\p{Lt}]*+(?:[\p{Lu}\p{Lt}]\p{Ll}*+(?:[^\p{Lu}\p{Ll}\p{Lt}]++|$))++$"),
    )


def is_digits(word) -> Column:
    return F.rlike(word, F.lit(r"^[\p{Nd}²³¹]+$"))


def is_alpha(word) -> Column:
    return F.rlike(word, F.lit(r"^\p{L}+$"))


def prefix(word, n: int) -> Column:
    return F.lower(F.left(word, F.lit(n)))


def suffix(word, n: int) -> Column:
    return F.lower(F.right(word, F.lit(n)))


def clean_word(word) -> Column:
    """Lower case without anything that is not a letter, number or underscore."""
    return F.regexp_replace(F.lower(word), r"[^\p{L}\p{N}_]", "")


def sample_code(sample_id) -> Column:
    return F.format_string("sample_%03d", sample_id)


def is_json(payload) -> Column:
    """Whether a payload parses as JSON."""
    return F.try_parse_json(payload).isNotNull()


def json_field(payload, *path: str) -> Column:
    return F.get_json_object(payload, "$." + ".".join(path))
