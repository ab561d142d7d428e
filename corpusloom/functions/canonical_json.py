"""Canonical JSON of any nested value, and its digest: keys sorted at every depth, no blanks, no NaN.

The text is the one that a JSON writer with sorted keys, compact separators and plain Unicode gives for the same value, so
digests agree with those of other programs.  The expression is built from the schema, so it stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that are written with a short escape.
SHORT = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")]
LONG = [chr(i) for i in range(32) if chr(i) not in "\n\r\t\b\f"]


def quoted(text: Column) -> Column:
    """A JSON string; characters beyond ASCII stand for themselves."""
    out = text
    for plain, escaped in SHORT:
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    rare = out
    for c in LONG:
        rare = F.replace(rare, F.lit(c), F.lit(f"\\u{ord(c):04x}"))
    return F.concat(F.lit('"'), F.when(out.rlike(r"[\x00-\x1f]"), rare).otherwise(out), F.lit('"'))


def number(value: Column) -> Column:
    """A double with the fewest digits that tell it: plain from 1e-4 to below 1e16, with an exponent else; NaN and infinities are refused."""
    refuse = F.raise_error(F.lit("JSON has no NaN and no infinity"))
    java = F.abs(value).cast("string")  # 123.0, 1.0E7 or 1.2E-5
    mantissa, power = F.substring_index(java, "E", 1), F.when(F.contains(java, F.lit("E")), F.substring_index(java, "E", -1)).otherwise(F.lit("0")).cast("int")
    whole, part = F.substring_index(mantissa, ".", 1), F.substring_index(mantissa, ".", -1)
    point = F.length(whole) + power  # digits before the point
    raw = F.concat(whole, F.when(part == "0", "").otherwise(part))
    lead = F.length(raw) - F.length(F.ltrim(raw, F.lit("0")))
    digits, at = F.rtrim(F.ltrim(raw, F.lit("0")), F.lit("0")), point - lead  # value = 0.digits * 10^at
    # some JVMs tell a value with a digit more than it needs: take one off if the rest still reads as the value
    n = F.length(digits)
    up = F.round(digits.cast("decimal(20,0)") / 10).cast("decimal(20,0)").cast("string")
    fewer, fewer_at = F.rtrim(up, F.lit("0")), at + F.when(F.length(up) == n, 1).otherwise(0)
    same = F.concat(F.lit("0."), fewer, F.lit("E"), fewer_at.cast("string")).try_cast("double") == F.abs(value)
    short = ((n >= 16) | (at < -300)) & (n > 1) & F.coalesce(same, F.lit(False))
    digits, at = F.when(short, fewer).otherwise(digits), F.when(short, fewer_at).otherwise(at)
    n = F.length(digits)
    plain = (
        F.when(at <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -at), digits))
        .when(at >= n, F.concat(digits, F.repeat(F.lit("0"), at - n), F.lit(".0")))
        .otherwise(F.concat(F.substring(digits, F.lit(1), at), F.lit("."), F.substring(digits, at + 1, n)))
    )
    exponent = at - 1
    told = F.concat(F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    told = F.when(F.abs(exponent) >= 100, F.concat(F.when(exponent < 0, "-").otherwise("+"), F.abs(exponent).cast("string"))).otherwise(told)
    small = F.concat(F.substring(digits, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(""), F.lit("e"), told)
    body = F.when(value == 0, "0.0").when((exponent >= -4) & (exponent < 16), plain).otherwise(small)
    minus = (value < 0) | (value.cast("string") == "-0.0")
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), refuse).otherwise(F.concat(F.when(minus, "-").otherwise(""), body))


def canonical_json(value: Column, kind: T.DataType, sets: frozenset[str] = frozenset(), path: str = "") -> Column:
    """The canonical JSON of a value of a type.  ``sets`` names the arrays, by dotted path, whose order does not count.

    Structs and maps are objects with sorted keys (map keys as text), arrays keep their order, a null is null.  Dates, binaries and decimals have no
    JSON form and are refused when the expression is built; floats are written as the doubles they stand for.
    """
    inside = lambda name: f"{path}.{name}" if path else name
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        parts = [F.concat(quoted(F.lit(f.name)), F.lit(":"), canonical_json(value.getField(f.name), f.dataType, sets, inside(f.name))) for f in fields]
        text = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    elif isinstance(kind, T.MapType):
        if not isinstance(kind.keyType, (T.StringType, T.IntegralType)):
            raise TypeError(f"a key of type {kind.keyType.simpleString()} has no JSON form")
        held = F.transform(F.map_entries(value), lambda e: F.struct(e["key"].cast("string").alias("k"), e["value"].alias("v")))
        spelled = F.transform(F.array_sort(F.transform(held, lambda e: F.struct(e["k"].alias("k"), canonical_json(e["v"], kind.valueType, sets, path).alias("v")))), lambda e: F.concat(quoted(e["k"]), F.lit(":"), e["v"]))
        text = F.concat(F.lit("{"), F.array_join(spelled, ","), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        own = F.array_distinct(F.array_sort(value)) if path in sets else value
        text = F.concat(F.lit("["), F.array_join(F.transform(own, lambda x: canonical_json(x, kind.elementType, sets, path)), ","), F.lit("]"))
    elif isinstance(kind, T.StringType):
        text = quoted(value)
    elif isinstance(kind, T.BooleanType):
        text = F.when(value, "true").otherwise("false")
    elif isinstance(kind, T.IntegralType):
        text = value.cast("string")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        text = number(value.cast("double"))
    elif isinstance(kind, T.NullType):
        return F.lit("null")
    else:
        raise TypeError(f"{kind.simpleString()} at {path or 'the top'} has no JSON form")
    return F.when(value.isNull(), F.lit("null")).otherwise(text)


def canonical_digest(value: Column, kind: T.DataType, sets: frozenset[str] = frozenset()) -> Column:
    """The SHA-256 of a value's canonical JSON."""
    return F.sha2(canonical_json(value, kind, sets), 256)
