"""Plain output types shared by queries and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilescope.functions.scalars import as_bigint as bi
from tilescope.functions.scalars import round6


def keyed(df, keys, ints=(), floats=()):
    """Project to plain types: text keys stay, whole numbers become bigint, doubles six decimals."""
    out = []
    for c in keys:
        out.append(F.col(c) if dict(df.dtypes)[c] == "string" else bi(c).alias(c))
    out += [bi(c).alias(c) for c in ints]
    out += [round6(c).alias(c) for c in floats]
    return df.select(*out)


def R(x, name=None):
    return f"round({x}, 6) + 0.0 AS {name or x}"


def B(x, name=None):
    return f"CAST({x} AS BIGINT) AS {name or x}"
