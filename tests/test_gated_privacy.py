"""Recognizers run only on texts with what they need, and find the same."""

from pyspark.sql import functions as F

from corpusloom.functions import fixed, gates, privacy

TEXTS = [
    "mail A.B@x.org, www, http://a.b/c?d=1 and 10.0.0.12.", "NIR 1 85 05 78 006 084 36; 2850578006084", "Patient ID: ab-12, MRN 12345 nº dossier: X99", "NÉE le 03/04/1985; Date of Birth: 1985-04-03. Born on 1.2.85",
    "My name is Ann Lee. Je m'appelle Zoé", "+33 612 34 56 78 or 01.23.45.67", "Dr. House", "plain words 12 3", "", None, "١٢ 1٢٣٤٥٦٧٨٩٠١٢٣٤", "MY NAME İS X, daTe of bIrth 1.1.01",
]


def test_gated_recognizers_equal_plain_ones(spark):
    d = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    plain, values = F.col("t"), []
    for c, token, p in fixed.RECOGNIZERS:
        values.append(F.regexp_extract_all("t", F.lit(privacy._pattern(c, p)), F.lit(0)))
        plain = F.regexp_replace(plain, privacy._pattern(c, p), token)
    digests = F.transform(F.flatten(F.array(*values)), lambda v: F.sha2(v, 256))
    tests = {c: F.col("t").rlike(privacy._pattern(c, p)) for c, _, p in fixed.RECOGNIZERS} | {"PERSON": F.col("t").rlike(privacy.PERSON_AFTER_TITLE)}
    found = F.array_compact(F.array(*[F.when(tests[c], c) for c in sorted(tests)]))
    out = d.select(plain.alias("a"), privacy.redact(F.col("t")).alias("b"), digests.alias("c"), privacy.matches(F.col("t"))["value_hash"].alias("d"), found.alias("e"), privacy.categories(F.col("t")).alias("f"))
    rows = out.collect()
    assert all(r.a == r.b and r.c == r.d and r.e == r.f for r in rows) and sum(len(r.c or ()) for r in rows) > 8
    assert out._jdf.queryExecution().optimizedPlan().toString().lower().count("contains(") > len(fixed.RECOGNIZERS)


def test_lower_case_needs_no_translation():
    assert "translate" not in str(gates.lowered(F.col("t"))).lower()
