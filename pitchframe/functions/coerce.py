"""Coercions that never throw: what can't be read is null. NaN counts as null everywhere."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def has(df: DataFrame, name: str) -> bool:
    return name in df.columns


def number(column: Column | str) -> Column:
    """As a double; unreadable text and NaN are null."""
    column = F.col(column) if isinstance(column, str) else column
    value = column.try_cast("double")
    return F.when(~F.isnan(value), value)


def number_or_null(df: DataFrame, name: str) -> Column:
    return number(F.col(name)) if has(df, name) else F.lit(None).cast("double")


def flag(column: Column | str, default: bool = False, words: tuple[str, str] | None = None) -> Column:
    """true/1 and false/0 in any case (and a further pair of words); all else is the default."""
    column = F.col(column) if isinstance(column, str) else column
    yes, no = ["true", "1"], ["false", "0"]
    if words:
        yes, no = [*yes, words[0]], [*no, words[1]]
    text = F.lower(column.cast("string"))
    return F.when(text.isin(yes), True).when(text.isin(no), False).otherwise(F.lit(default))


def flag_or_default(df: DataFrame, name: str, default: bool = False, words: tuple[str, str] | None = None) -> Column:
    """The flag of `<name>_bool` if there is one, else of `name`, else the default."""
    own = next((c for c in (f"{name}_bool", name) if has(df, c)), None)
    return flag(F.col(own), default, words) if own else F.lit(default)


def label(df: DataFrame, name: str) -> Column:
    """Lower-case text, '' if there is none."""
    return F.lower(F.coalesce(F.col(name).cast("string"), F.lit(""))) if has(df, name) else F.lit("")


def identity(column: Column | str) -> Column:
    """Ids are compared as trimmed text."""
    column = F.col(column) if isinstance(column, str) else column
    return F.trim(column.cast("string"))


def first_number(df: DataFrame, names: list[str]) -> Column:
    """The first readable number among the columns that exist."""
    found = [number(F.col(n)) for n in names if has(df, n)]
    return F.coalesce(*found) if found else F.lit(None).cast("double")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def ratio_or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(ratio(a, b), F.lit(0.0))


def no_nan(df: DataFrame) -> DataFrame:
    """All NaN of a table as null, once, where it enters."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, k in kinds.items() if k in ("double", "float")})


def require(df: DataFrame, names: list[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")


def any_of(*conditions: Column) -> Column:
    """True if one condition is true; null counts as false."""
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in conditions])


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for c in conditions])


def renamed_by_alias(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Each wanted name takes the first of its aliases that the table has."""
    for wanted, names in aliases.items():
        if wanted not in df.columns and (own := next((n for n in names if n in df.columns), None)):
            df = df.withColumnRenamed(own, wanted)
    return df
