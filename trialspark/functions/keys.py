"""Key construction and scalar helpers.

Environment keys are ``<Field_Location>_<Year>`` strings; hybrid-by-environment
keys join a hybrid id and an environment with a separator.  Everything here
returns a ``Column`` so callers stay inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Sub-site weather/EC codes merged into one environment.
# Keys are sub-site environment codes, values the environment they belong to.
ENV_RECODE = {
    "MOH1_1_2018": "MOH1_2018",
    "MOH1_1_2020": "MOH1_2020",
    "MOH1_2_2018": "MOH1_2018",
    "MOH1_2_2020": "MOH1_2020",
}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def build_key(*parts, sep: str = "_") -> Column:
    """Concatenate parts with ``sep`` (NULL if any part is NULL; keys are built non-null)."""
    cols: list[Column] = []
    for i, p in enumerate(parts):
        if i:
            cols.append(F.lit(sep))
        cols.append(_c(p).cast("string"))
    return F.concat(*cols)


def split_key(c, names: Iterable[str] = ("Field_Location", "Year"), sep: str = "_") -> list[Column]:
    """Split into named fields: extra pieces are dropped, missing ones are NULL.

    ``L1_1_2018`` -> (``L1``, ``1``); ``A`` -> (``A``, NULL).
    """
    pieces = F.split(_c(c), sep)
    return [F.get(pieces, i).alias(n) for i, n in enumerate(names)]


def strip_pattern(c, pattern: str) -> Column:
    """Remove every match of a regular expression."""
    return F.regexp_replace(_c(c), pattern, "")


def round_half_even(c, scale: int = 0) -> Column:
    """Banker's rounding (0.5 -> 0, 1.5 -> 2, 2.5 -> 2)."""
    return F.bround(_c(c), scale)


def recode(c, mapping: Mapping[str, str]) -> Column:
    """Replace listed values, keep all others unchanged."""
    c = _c(c)
    if not mapping:
        return c
    expr = None
    for old, new in mapping.items():
        expr = (F.when(c == old, F.lit(new)) if expr is None
                else expr.when(c == old, F.lit(new)))
    return expr.otherwise(c)


def nan_to_null(c) -> Column:
    """NaN -> NULL, so NULL is the single missing marker downstream."""
    c = _c(c)
    return F.when(F.isnan(c), F.lit(None).cast(T.DoubleType())).otherwise(c)
