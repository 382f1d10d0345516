"""B*: projections and scalar expressions as Column helpers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The function-type pattern of dataset names.
FUNCTION_TYPE_PATTERN = r"_(linear|exponential|quadratic|cubic)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def function_type(col) -> Column:
    """B1: equation family from a dataset name; no match -> NULL."""
    return F.nullif(F.regexp_extract(_c(col), FUNCTION_TYPE_PATTERN, 1), F.lit(""))


def to_numeric(col) -> Column:
    """B2: tolerant numeric coercion ('NA', '', junk -> NULL); NaN -> NULL."""
    v = _c(col).cast("string").try_cast("double")
    return F.when(~F.isnan(v), v)


def standardize_summary(df: DataFrame, renames: Mapping[str, str]) -> DataFrame:
    """Rename / flatten headers."""
    return df.withColumnsRenamed(dict(renames))


def map_labels(col, mapping: Mapping) -> Column:
    """Code -> label through a literal map; unmapped -> NULL."""
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.try_element_at(F.create_map(*pairs), _c(col))


def binarize(col, threshold: float = 0, yes="1", no="0") -> Column:
    """``col > threshold`` -> yes else no (a missing value is "no", as in pandas)."""
    return F.when(_c(col) > threshold, F.lit(yes)).otherwise(F.lit(no))


def text_from_cols(cols: Sequence[str]) -> Column:
    """``"{c1} {c2} ..."`` with missing printed as ``nan``."""
    return F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in cols])


def row_sentence(cols: Sequence[str], skip: Sequence[str] = ("outcome", "ca")) -> Column:
    """Value 0 -> ``no <col>``, 1 -> ``<col>``, missing -> ``nan <col>``,
    else ``<value> <col>``; columns in ``skip`` are left out."""
    parts = []
    for c in cols:
        if c in skip:
            continue
        v = F.col(c)
        parts.append(F.when(v.isNull(), F.lit(f"nan {c}"))
                     .when(v == 0, F.lit(f"no {c}"))
                     .when(v == 1, F.lit(c))
                     .otherwise(F.concat(v.cast("string"), F.lit(f" {c}"))))
    return F.concat_ws(" ", *parts)


def parse_list(col) -> Column:
    """``'a, b,c'`` -> ``['a','b','c']`` (trimmed, empty items dropped)."""
    return F.filter(F.transform(F.split(_c(col), ","), lambda s: F.trim(s)), lambda s: s != "")


def join_list(col, sep: str = ", ") -> Column:
    """Array -> ``'a, b, c'``."""
    return F.array_join(_c(col), sep)


def round_cols(df: DataFrame, cols: Sequence[str], digits: int) -> DataFrame:
    """Half-up rounding of the given columns (output projection only)."""
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


def split_by_dtype(df: DataFrame) -> tuple[list[str], list[str]]:
    """(numeric columns, other columns) from the schema."""
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    return num, [c for c in df.columns if c not in num]


def select_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """Keep the columns that start with ``prefix``."""
    return df.select([c for c in df.columns if c.startswith(prefix)])


def drop_prefix(df: DataFrame, prefix: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(prefix)])


def better_flag(a, b, higher_is_better: bool = True) -> Column:
    """Strict improvement of ``b`` over ``a``; ties are not better,
    a missing side is not better."""
    a, b = _c(a), _c(b)
    return F.coalesce(b > a if higher_is_better else b < a, F.lit(False))


def match_features(name, chosen) -> Column:
    """True when any chosen name is a substring of the encoded ``name``."""
    return F.exists(_c(chosen), lambda f: F.instr(_c(name), f) > 0)


def usable_features(requested, available, target: str) -> Column:
    """Requested features that exist, never the target."""
    return F.array_except(F.array_intersect(_c(requested), _c(available)), F.array(F.lit(target)))


def mean_pm(mean, sem, digits: int = 3) -> Column:
    """``'m ± s'`` annotation."""
    return F.format_string(f"%.{digits}f ± %.{digits}f", _c(mean), _c(sem))


def p_text(p, digits: int = 4) -> Column:
    """``'p = x.xxxx'``."""
    return F.format_string(f"p = %.{digits}f", _c(p))


def verdict(p, alpha: float = 0.05) -> Column:
    """Significance verdict text."""
    return F.when(_c(p) < alpha, F.lit(f"significant (p<{alpha})")).otherwise(F.lit("not significant"))


def equation_text(intercept, coefs: Mapping[str, Column], target: str = "y", digits: int = 3) -> Column:
    """``'y = b0 + b1*x1 + ...'``."""
    parts = [F.format_string(f"%.{digits}f", _c(intercept))]
    for name, c in coefs.items():
        parts.append(F.format_string(f"%.{digits}f*{name}", _c(c)))
    return F.concat(F.lit(f"{target} = "), F.concat_ws(" + ", *parts))
