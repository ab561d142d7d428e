"""Canonical JSON against the standard library's writer."""

import hashlib
import json
import random
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.canonical_json import canonical_digest, canonical_json

DDL = ("id int, v struct<zeta:string,alpha:bigint,`é key`:array<array<double>>,m:map<string,struct<b:boolean,a:array<string>>>,n:map<int,double>,tags:array<string>,deep:struct<y:struct<q:string,p:float>,x:array<struct<k:int,j:string>>>>")


def dumps(v):
    return json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def plain(v):
    return v.asDict(recursive=True) if isinstance(v, T.Row) else v


def test_nested_values_against_the_library(spark):
    SCHEMA = T.StructType.fromDDL(DDL)  # noqa: N806
    rnd = random.Random(3)
    text = lambda: "".join(rnd.choice('ab"\\\n\t\r\b\f\x00\x1f\x7f /é日\U0001f600') for _ in range(rnd.randrange(6)))
    num = lambda: rnd.choice([0.0, -0.0, 1.0, -1.5, 1e16, 123456789012345680.0, 1e-4, 1e-5, 0.1, 1e7, 12345678.9, 5e-324, 1.7976931348623157e308, rnd.uniform(-1e9, 1e9), rnd.random() * 10 ** rnd.randrange(-30, 30)])
    some = lambda f: rnd.choice([None, f()]) if rnd.random() < 0.3 else f()
    single = lambda: struct.unpack("f", struct.pack("f", rnd.uniform(-100, 100)))[0]
    value = lambda: {
        "zeta": some(text), "alpha": some(lambda: rnd.randrange(-(2**63), 2**63)), "é key": some(lambda: [some(lambda: [some(num) for _ in range(3)]) for _ in range(2)]),
        "m": some(lambda: {text(): some(lambda: {"b": some(lambda: rnd.random() < 0.5), "a": some(lambda: [some(text) for _ in range(2)])}) for _ in range(3)}),
        "n": some(lambda: {rnd.randrange(-50, 500): some(num) for _ in range(4)}), "tags": some(lambda: [text() for _ in range(3)]),
        "deep": some(lambda: {"y": some(lambda: {"q": some(text), "p": some(single)}), "x": some(lambda: [some(lambda: {"k": some(lambda: rnd.randrange(9)), "j": some(text)}) for _ in range(2)])}),
    }
    rows = [(i, value()) for i in range(300)] + [(300, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    kind = SCHEMA["v"].dataType
    out = df.select("id", canonical_json(F.col("v"), kind).alias("j"), canonical_digest(F.col("v"), kind).alias("d")).collect()
    for r in out:
        v = rows[r["id"]][1]
        want = dumps(None if v is None else v | {"n": None if v["n"] is None else {str(k): x for k, x in v["n"].items()}})
        assert r["j"] == want and r["d"] == hashlib.sha256(want.encode()).hexdigest()


def test_sets_and_refusals(spark):
    df = spark.createDataFrame([(["b", "a", "b"], ["b", "a", "b"], float("nan"))], "s array<string>, l array<string>, x double")
    v, kind = F.struct("s", "l"), T.StructType.fromDDL("s array<string>, l array<string>")
    assert df.select(canonical_json(v, kind, frozenset({"s"})).alias("j")).first()["j"] == '{"l":["b","a","b"],"s":["a","b"]}'
    with pytest.raises(Exception, match="NaN"):
        df.select(canonical_json(F.col("x"), T.DoubleType())).collect()
    with pytest.raises(TypeError, match="date"):
        canonical_json(F.struct(F.current_date().alias("d")), T.StructType.fromDDL("d date"))
