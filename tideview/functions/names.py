"""Field naming: underscore names to camelCase, for driver-side names and for map keys."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_camel_case(name: str) -> str:
    """``order_date`` -> ``orderDate``; names made only of underscores stay as they are."""
    body = name.lstrip("_")
    if not body:
        return name
    return re.sub(r"_(.)|_$", lambda m: (m.group(1) or "").upper(), body)


def camel_case(col: Column) -> Column:
    """The same renaming as a native expression.

    Each underscore and the character after it are marked first, so that a pair is consumed
    from left to right; then the parts are put together with their first letter raised.
    """
    mark = "\u0001"
    body = F.regexp_replace(col, "^_+", "")
    marked = F.regexp_replace(body, "(?s)_(.)|_$", mark + "$1")
    parts = F.split(marked, mark, -1)
    rest = F.transform(
        F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda p: F.concat(F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p))),
    )
    joined = F.concat(parts[0], F.array_join(rest, ""))
    return F.when(F.length(body) == 0, col).otherwise(joined)


def rename_fields(df: DataFrame) -> DataFrame:
    """Rename all columns to camelCase; two names that collide are refused."""
    new = [to_camel_case(c) for c in df.columns]
    if len(set(new)) != len(new):
        raise ValueError("two columns would get the same name")
    return df.toDF(*new)


def rename_keys(col: Column) -> Column:
    """Rename the keys of a map."""
    return F.transform_keys(col, lambda k, v: camel_case(k))
