"""Phone number column functions."""

from pyspark.sql import Column, functions as F

from .fixed import PHONE_PREFIXES, PHONE_TOKEN


def is_phone(token) -> Column:
    return F.rlike(token, F.lit(PHONE_TOKEN))


def prefix_valid(token) -> Column:
    """First five characters of +62..., or first four of 0..., in the accepted list."""
    return (
        F.when(F.startswith(token, F.lit("+62")), F.left(token, F.lit(5)).isin(PHONE_PREFIXES))
        .when(F.startswith(token, F.lit("0")), F.left(token, F.lit(4)).isin(PHONE_PREFIXES))
        .otherwise(False)
    )


def to_international(phone) -> Column:
    return F.regexp_replace(phone, "^0", "+62")
