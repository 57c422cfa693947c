"""Bind a value once inside an expression.

A lambda that reads another computed column is unsafe at scale: when the optimizer merges
projections it may put that column's whole expression into the lambda, where it runs once per
array element. ``let`` evaluates its values once per row whatever is merged.
"""

from pyspark.sql import Column, functions as F


def let(fn, *values) -> Column:
    cols = [F.col(v) if isinstance(v, str) else v for v in values]
    bound = F.struct(*[c.alias(f"v{i}") for i, c in enumerate(cols)])
    return F.get(
        F.transform(F.array(bound), lambda s: fn(*[s[f"v{i}"] for i in range(len(cols))])), F.lit(0)
    )
