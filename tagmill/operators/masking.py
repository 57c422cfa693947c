"""Replace detected entities in the payload, by a policy per entity type."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import decoded_payload, token_gaps, tokenize

# entity type -> (characters kept on the left, on the right, mask character), per token.
DEFAULT_POLICY = {
    "NIK": (6, 0, "X"),
    "PHONE": (4, 2, "X"),
    "NAMA": (1, 0, "*"),
    "JABATAN": (0, 0, "*"),
    "LOKASI": (0, 0, "*"),
}


def mask_token(token: Column, label: Column, policy=DEFAULT_POLICY) -> Column:
    """The token masked by the policy of its label's type; unknown types are left alone."""
    out = token
    n = F.length(token)
    kind = F.substr(label, F.lit(3))
    for entity, (left, right, char) in policy.items():
        hidden = F.greatest(n - left - right, F.lit(0))
        masked = F.concat(
            F.left(token, F.lit(left)),
            F.repeat(F.lit(char), hidden),
            F.right(token, F.least(F.lit(right), F.greatest(n - left, F.lit(0)))),
        )
        out = F.when((label != "O") & (kind == entity), masked).otherwise(out)
    return out


def mask_text(gaps, tokens, labels, policy=DEFAULT_POLICY) -> Column:
    """Gaps and tokens put together again, with the labelled tokens masked."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    masked = F.zip_with(tokens, labels, lambda t, l: mask_token(t, F.coalesce(l, F.lit("O")), policy))
    joined = F.zip_with(gaps, masked, lambda g, t: F.concat(g, F.coalesce(t, F.lit(""))))
    return F.array_join(joined, "")


def mask_entities(df: DataFrame, payload="payload", fmt="format", labels="labels", policy=DEFAULT_POLICY, out="masked") -> DataFrame:
    """Add the masked payload; form data is masked in decoded form.

    ``labels`` must stand on the tokens of the same payload.
    """
    text = decoded_payload(payload, fmt)
    return (
        df.withColumn("_gaps", token_gaps(text))
        .withColumn("_tokens", tokenize(text))
        .withColumn(out, mask_text("_gaps", "_tokens", labels, policy))
        .drop("_gaps", "_tokens")
    )
