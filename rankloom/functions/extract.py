"""First usable text of a nested value, as an expression built from its type."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.constants import NESTED_TEXT_KEYS
from rankloom.functions.text import normalize_whitespace


#: The one field of a column that holds JSON values as the reader found them.
JSON_TEXT = "_json_text"


def first_text(col: Column, dtype: T.DataType) -> Column:
    """Text of a scalar, of the first list element that has one, or of the first field
    that has one (well-known keys before the others); '' if there is none."""
    if isinstance(dtype, T.ArrayType):
        texts = F.transform(col, lambda item: first_text(item, dtype.elementType))
        return _first_of_list(texts)
    if isinstance(dtype, T.StructType) and dtype.names == [JSON_TEXT]:
        return first_text_raw(col.getField(JSON_TEXT))
    if isinstance(dtype, T.StructType):
        known = [k for k in NESTED_TEXT_KEYS if k in dtype.names]
        fields = known + [n for n in dtype.names if n not in known]
        return _first_of([first_text(col.getField(n), dtype[n].dataType) for n in fields])
    if isinstance(dtype, T.MapType):
        values = F.map_values(col)
        known = []
        if isinstance(dtype.keyType, T.StringType):
            known = [
                first_text(F.try_element_at(col, F.lit(k)), dtype.valueType) for k in NESTED_TEXT_KEYS
            ]
        rest = _first_of_list(F.transform(values, lambda v: first_text(v, dtype.valueType)))
        return _first_of([*known, rest])
    if isinstance(dtype, T.VariantType):
        return first_text_variant(col)
    if isinstance(dtype, T.BooleanType):
        return F.when(col, "True").when(~col, "False").otherwise("")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.coalesce(float_text(col.cast("double")), F.lit(""))
    return normalize_whitespace(col.cast("string"))


def _first_of(texts: list[Column]) -> Column:
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts], F.lit(""))


def _first_of_list(texts: Column) -> Column:
    return F.coalesce(F.get(F.filter(texts, lambda t: t != ""), F.lit(0)), F.lit(""))


def float_text(x: Column) -> Column:
    """A double as Python prints it: plain digits from 1e-4 up to 1e16."""
    shown = x.cast("string")
    digits = F.regexp_replace(shown.cast("decimal(38,20)").cast("string"), "0+$", "")
    plain = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
    mantissa = F.regexp_replace(F.substring_index(shown, "E", 1), r"\.0$", "")
    exponent = F.substring_index(shown, "E", -1).cast("int")
    power = F.concat(
        F.when(exponent < 0, "e-").otherwise("e+"), F.lpad(F.abs(exponent).cast("string"), 2, "0")
    )
    size = F.abs(x)
    return (
        F.when(F.isnan(x), "nan")
        .when(size == float("inf"), F.when(x > 0, "inf").otherwise("-inf"))
        .when(~shown.contains("E"), shown)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(F.concat(mantissa, power))
    )


def _json_text_function():
    """Everything the function needs is local to it, so it travels to the executors by
    value and they need no copy of this package."""
    keys = list(NESTED_TEXT_KEYS)

    def texts(value):
        """All texts inside a decoded JSON value, best candidate first."""
        if isinstance(value, dict):
            for key in keys:
                yield from texts(value.get(key))
            for inner in value.values():
                yield from texts(inner)
        elif isinstance(value, list):
            for inner in value:
                yield from texts(inner)
        elif value is not None:
            yield " ".join(str(value).split())

    def decoded(text):
        try:
            return json.loads(text)
        except ValueError:  # a plain text that only begins like an object
            return text

    @F.pandas_udf(T.StringType())
    def first_json_text(raw: pd.Series) -> pd.Series:
        found = [None if r is None else next(filter(None, texts(decoded(r))), "") for r in raw]
        return pd.Series(found, dtype="object")

    return first_json_text


_first_json_text = _json_text_function()


def first_text_json(raw: Column) -> Column:
    """First text of JSON source text; keys keep the order they have in the text."""
    return F.coalesce(_first_json_text(raw), F.lit(""))


def first_text_raw(raw: Column) -> Column:
    """First text of a value of any shape, given as JSON source text, strings without their
    quotes. Plain strings stay in the JVM; objects and lists keep the order of the text."""
    nested = F.ltrim(raw).startswith("{") | F.ltrim(raw).startswith("[")
    return F.when(nested, F.coalesce(_first_json_text(F.when(nested, raw)), F.lit(""))).otherwise(normalize_whitespace(raw))


def first_text_variant(col: Column) -> Column:
    """First text of a value whose shape differs by row. Plain strings stay in the JVM;
    only nested and other values go through the Arrow batch function. A variant keeps
    object keys by name, so 'the other fields' come in that order."""
    kind = F.schema_of_variant(col)
    is_text = F.coalesce(kind == "STRING", F.lit(False))
    nested = _first_json_text(F.when(~is_text, F.to_json(col)))
    plain = normalize_whitespace(F.try_variant_get(col, "$", "string"))
    return F.when(col.isNull(), "").when(is_text, plain).otherwise(F.coalesce(nested, F.lit("")))
