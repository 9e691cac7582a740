"""Personal data: which kinds a text has, and the text with them masked."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import values as V
from .text import blank


@F.pandas_udf(T.StringType())
def nfkc(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility characters (full-width digits and such) in their standard form; no built-in function does this."""
    for s in parts:
        yield s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def folded(text: Column) -> Column:
    """NFKC of the text; a text of ASCII alone, its own NFKC, does not go to Python."""
    return F.when(text.rlike(r"^\p{ASCII}*$"), text).otherwise(nfkc(F.when(~text.rlike(r"^\p{ASCII}*$"), text)))


def scan(text: Column, patterns: list[tuple[str, str]] = V.PERSONAL) -> Column:
    """Kinds found in a folded text, in their order."""
    return F.array_compact(F.array(*[F.when(blank(text).rlike(p), F.lit(k)) for k, p in patterns]))


def redact(text: Column, patterns: list[tuple[str, str]] = V.PERSONAL) -> tuple[Column, Column]:
    """The folded text masked kind by kind, each seeing what the kinds before left, and the kinds found."""
    found = []
    for kind, pattern in patterns:
        found.append(F.when(text.rlike(pattern), F.lit(kind)))
        text = F.regexp_replace(text, pattern, V.MASK.format(kind))
    return text, F.array_compact(F.array(*found))


def _deep_nfkc(value: object) -> object:
    """The value with all strings in it folded, keys of maps excepted."""
    if isinstance(value, str):
        return unicodedata.normalize("NFKC", value)
    if isinstance(value, Row):
        return Row(*map(_deep_nfkc, value))
    if isinstance(value, dict):
        return {k: _deep_nfkc(x) for k, x in value.items()}
    return [_deep_nfkc(x) for x in value] if isinstance(value, (list, tuple)) else value


def redact_nested(value: Column, kind: T.DataType) -> Column:
    """The value with every string in it folded and masked, whatever it is nested in.

    Python folds within lambdas don't exist, so a nested value with characters beyond ASCII is folded as a whole first.
    """
    if isinstance(kind, T.StringType):
        return redact(folded(value))[0]
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        plain = F.coalesce(F.to_json(F.struct(value.alias("v"))).rlike(r"^\p{ASCII}*$"), F.lit(True))
        value = F.when(plain, value).otherwise(F.udf(_deep_nfkc, kind)(F.when(~plain, value)))
    return _native(value, kind)


def _native(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return redact(value)[0]
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _native(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda k, x: _native(x, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[_native(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return value


def notice(kinds: Column) -> Column:
    """One line naming the kinds, or null if there are none."""
    return F.when(F.size(kinds) > 0, F.concat(F.lit("개인정보 감지: "), F.array_join(kinds, ", ")))


def mask(df: DataFrame, column: str, kinds: str = "pii_kinds") -> DataFrame:
    """df with the text column masked and an array of the kinds found. A null text stays null, without kinds."""
    safe, found = redact(F.col("__folded"))
    return df.withColumn("__folded", folded(F.col(column))).withColumn(kinds, found).withColumn(column, safe).drop("__folded")
