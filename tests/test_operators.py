import random

import pytest
from pyspark.sql import functions as F

from corpusloom import sources, streaming
from corpusloom.functions import curation, extraction, fingerprints, flags, privacy, records, text
from corpusloom.operators import contracts, graph, rules, select


def one(spark, column, schema="x string", value=None):
    return spark.createDataFrame([(value,)], schema).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("raw, want", [("  a\t b \r\n\r\n c d ", "a b\n\nc d"), (None, ""), ("", ""), ("x y", "x\ny"), ("\n\n", "")])
def test_clean_text(spark, raw, want):
    got = one(spark, text.clean_text(F.col("x")), value=raw)
    assert got == want
    assert one(spark, text.clean_text(F.col("x")), value=got) == got


def test_fold_and_words(spark):
    assert one(spark, text.fold_term(F.col("x")), value=" Fièvre, ÉLEVÉE ") == "fievre elevee"
    assert one(spark, text.word_count(F.col("x")), value=" a  b\nc ") == 3
    assert one(spark, text.word_count(F.col("x")), value=None) == 0


@pytest.mark.parametrize("raw, want", [("A", ["A"]), ("B,A", ["A", "B"]), ("ABD", ["A", "B", "D"]), ("AA", None), ("A?", None), ("", None), (None, None)])
def test_parse_labels(spark, raw, want):
    assert one(spark, records.parse_labels(F.col("x")), value=raw) == want


def test_completion(spark):
    p, e = records.parse_completion(F.col("x"))
    assert one(spark, p, value="PRIORITY: P1\nEXPLANATION: Détresse respiratoire.<|im_end|>") == 1
    assert one(spark, e, value="PRIORITY: P1\nEXPLANATION: Détresse respiratoire.<|im_end|>") == "Détresse respiratoire."
    assert one(spark, p, value="<think>\nP3 ?\n</think>\nPRIORITY: P2\nEXPLANATION: x") == 2
    assert one(spark, p, value="EXPLANATION: no priority") is None


def test_redaction(spark):
    t = "mail a.b@c.org from 10.0.0.1, see https://x.org/y and patient id: AB-123"
    out = one(spark, privacy.redact(F.col("x")), value=t)
    assert out == "mail [EMAIL] from [IP], see [URL] and [IDENTIFIER]"
    assert one(spark, F.size(privacy.matches(F.col("x"))), value=out) == 0
    assert one(spark, privacy.age_at(F.col("x"), F.lit("2020-06-15").cast("date")), value="14/06/1990") == 30
    assert one(spark, privacy.age_at(F.col("x"), F.lit("2020-06-15").cast("date")), value="1850-01-01") is None


def test_privacy_decisions(spark):
    r = spark.createDataFrame([(i, "bad text", "h") for i in range(5)], "id int, text string, content_hash string")
    d = spark.createDataFrame([(0, "approve", "h", None, None), (1, "redact", "h", "bad", "good"), (2, "exclude", "h", None, None), (3, "approve", "old", None, None)], "id int, decision string, content_hash string, target string, replacement string")
    got = {x["id"]: (x["text"], x["privacy_status"]) for x in privacy.apply_decisions(r, d).collect()}
    assert got == {0: ("bad text", "APPROVED"), 1: ("good text", "REDACTED"), 2: ("bad text", "EXCLUDED"), 3: ("bad text", "STALE"), 4: ("bad text", "PENDING")}


def test_flags(spark):
    assert one(spark, flags.text_flags(F.col("x")), value="no no no <|im_end|>") == ["CHAT_CONTROL_TOKEN", "TEXT_ANOMALY"]
    assert one(spark, flags.open_answer_flags(F.col("x")), value="Why?") == ["QUESTION_AS_ANSWER"]
    assert one(spark, flags.semantic_open_flags(F.col("x")), value="visit us at the desk?") == ["NAVIGATION_ONLY_ANSWER", "QUESTION_AS_ANSWER"]
    assert one(spark, flags.semantic_open_flags(F.col("x")), value="more information") == ["UNINFORMATIVE_ANSWER", "VERY_SHORT_OPEN_ANSWER"]
    assert one(spark, flags.semantic_open_flags(F.col("x")), value="  ") == []
    assert one(spark, flags.open_answer_flags(F.col("x")), value=None) == ["EMPTY_ANSWER"]
    assert one(spark, flags.target_leakage(F.lit("x" * 40), F.col("x")), value="x" * 30) is True


def test_extraction(spark):
    t = "Femme de 34 ans, TA 12/8 cmHg, FC 90, SpO2: 97, temp 101.3 °F, depuis 3 jours"
    s, d = extraction.blood_pressure(F.col("x"))
    assert (one(spark, s, value=t), one(spark, d, value=t)) == (120.0, 80.0)
    assert one(spark, extraction.temperature(F.col("x")), value=t) == 38.5
    assert one(spark, extraction.age_years(F.col("x")), value=t) == 34.0
    assert one(spark, extraction.sex(F.col("x")), value=t) == "female"
    assert one(spark, extraction.duration_minutes(F.col("x")), value=t) == 4320.0
    assert one(spark, extraction.vital(F.col("x"), "heart_rate"), value="FC 90 puis FC 120") is None
    assert one(spark, extraction.tri_state(F.col("x"), "fever", "no fever"), value="fever then no fever") == "UNKNOWN"


@pytest.mark.parametrize("a", [True, False, None])
@pytest.mark.parametrize("b", [True, False, None])
def test_kleene(spark, a, b):
    value = {True: 2.0, False: 0.0, None: None}
    c = rules.Compiler({"a": F.col("a"), "b": F.col("b")})
    leaf = lambda f: {"field": f, "operator": ">", "value": 1}
    df = spark.createDataFrame([(value[a], value[b])], "a double, b double")
    both, either, empty = df.select(c.match({"all": [leaf("a"), leaf("b")]}), c.match({"any": [leaf("a"), leaf("b")]}), c.match({"all": []})).first()
    assert both == (False if False in (a, b) else None if None in (a, b) else True)
    assert either == (True if True in (a, b) else None if None in (a, b) else False)
    assert empty is True


def test_decisions(spark):
    from corpusloom.plans.clinical import PROTOCOL

    rows = [(1, 50, 1600.0, "x", ["M1"]), (2, 5, 900.0, "x", ["M1"]), (3, None, 1000.0, "x", ["M2"]), (4, 10, 2000.0, "x", ["M2"]), (5, 1, 1.0, "x", []), (6, 1, 1.0, "x", ["M9"]), (7, 5, 1.0, "brass", ["M1", "M3"]), (8, 15, 2000.0, "x", ["M1"])]
    df = spark.createDataFrame(rows, "id int, size int, price double, type string, ids array<string>")
    out = rules.decide(df, rules.flatten_protocol(PROTOCOL), {f: F.col(f) for f in ("size", "price", "type")}, "ids", "id")
    got = {r["id"]: (r["method"], r["priority"], r["level"]) for r in out.collect()}
    assert got[1] == ("exact_rule", 1, "1") and got[2] == ("exact_rule", 2, "3A")
    assert got[3] == ("deterministic_unique", 3, "4")
    assert got[4][0] == "no_matching_criterion" and got[5][0] == "no_patient_motif" and got[6][0] == "unsupported_protocol_rule"
    assert got[7] == ("exact_rule_conflict", None, None)
    assert got[8] == ("deterministic_unique", 1, "1")
    assert rules.unresolved_motifs(PROTOCOL) == ["M2"]


def test_group_ids_are_component_minima(spark):
    rnd = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(rnd.randrange(100, 200), rnd.randrange(100, 200)) for _ in range(60)]
    label = list(range(201))
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = graph.group_ids(spark.range(201).withColumnRenamed("id", "node"), spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["group_id"] for r in got.collect()} == dict(enumerate(label))


def test_cycles_and_review(spark):
    p = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 1), (2, 1, 2), (2, 2, 3)], "prompt int, chosen int, rejected int")
    assert [r["prompt"] for r in graph.cyclic_groups(p).collect()] == [1]
    g = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "node long, group_id long")
    near = spark.createDataFrame([(1, 2)], "a long, b long")
    assert sorted((r["node"], r["near_review"]) for r in graph.near_review(g, near).collect()) == [(1, True), (2, True), (3, False)]


def test_allocation(spark):
    rnd = random.Random(1)
    for _ in range(6):
        cap = {i: rnd.randrange(0, 40) for i in range(rnd.randrange(1, 9))}
        target = rnd.randrange(0, 200)
        df = spark.createDataFrame(list(cap.items()), "s int, capacity long")
        q = {r["s"]: r["quota"] for r in select.quotas(df, ["s"], target).collect()}
        assert sum(q.values()) == min(target, sum(cap.values())) and all(q[k] <= cap[k] for k in cap)


def test_fill_validation():
    groups = [(f"g{i}", {"a": i % 3, "b": (i + 1) % 2}) for i in range(20)]
    names = select.fill_validation(groups, {"a": 5, "b": 4})
    total = {k: sum(c.get(k, 0) for n, c in groups if n in names) for k in ("a", "b")}
    assert total == {"a": 5, "b": 4}


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,v\n1,NA\n2,"x, ""y"""\n')
    (tmp_path / "a.json").write_text('[{"id": 1}, {"id": 2}]')
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n\n{"id": 3}\n')
    assert [tuple(r) for r in sources.read_any(spark, str(tmp_path / "a.csv")).collect()] == [("1", "NA"), ("2", 'x, "y"')]
    assert sources.read_any(spark, str(tmp_path / "a.json")).count() == 2
    assert sources.read_any(spark, str(tmp_path / "a.jsonl")).count() == 2
    assert sources.read_jsonl(spark, str(tmp_path / "none.jsonl"), "id int").count() == 0
    df = spark.range(5)
    assert sources.write_same_or_fail(df, str(tmp_path / "t")) == "written"
    assert sources.write_same_or_fail(df.orderBy(F.desc("id")), str(tmp_path / "t")) == "unchanged"
    with pytest.raises(ValueError):
        sources.write_same_or_fail(spark.range(6), str(tmp_path / "t"))
    assert sources.validate(df, ["id", "x"], 4) == ["missing column x", "5 rows instead of 4"]
    assert len(sources.file_hashes(spark, str(tmp_path / "a.csv")).first()["sha256"]) == 64


def test_streaming_rates(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    e.write.json(str(tmp_path / "in"))
    s = streaming.sliding_rates(streaming.audit_stream(spark, str(tmp_path / "in")), width="1 hour", step="15 minutes")
    q = s.writeStream.format("memory").queryName("rates").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    batch = streaming.sliding_rates(e, width="1 hour", step="15 minutes")
    assert spark.table("rates").groupBy("start", "event_type").count().count() == batch.count()


def test_ratios():
    from corpusloom.functions import similarity

    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    rnd = random.Random(0)
    for _ in range(200):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randrange(12))) for _ in range(2))
        assert similarity.common_subsequence(a, b) == slow(a, b)
    assert similarity.indel("", "") == 100.0 and similarity.token_set("a b c", "c b") == 100.0


def test_minhash_recall_at_the_registered_ratio(spark):
    from corpusloom.functions import similarity
    from corpusloom.operators import near

    rnd = random.Random(21)
    letters = "abcdefghijklmnopqrstuvwxyz "
    texts = []
    for k in range(150):
        t = "x" + "".join(rnd.choice(letters) for _ in range(400)) + "x"
        other = list(t)
        for i in rnd.sample(range(1, 401), 20 + k % 20):  # 5 to 10 % scattered edits
            other[i] = rnd.choice(letters)
        texts += [" ".join(t.split()), " ".join("".join(other).split())]
    want = {(2 * k, 2 * k + 1) for k in range(150) if similarity.indel(texts[2 * k], texts[2 * k + 1]) >= 90}
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {(r["a"], r["b"]) for r in near.minhash_edges(df, "id", least_ratio=90.0).collect()}
    assert len(want) > 100 and got <= want
    assert len(got) >= 0.9 * len(want)


def test_answer_ratios_of_whole_texts(spark, tmp_path):
    from corpusloom.functions import similarity
    from corpusloom.plans import more

    a, b = "same words " * 30 + "left end", "same words " * 30 + "another right close"
    spark.createDataFrame([(1, 0, "user", a), (1, 1, "assistant", b)], "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    r = more.answer_ratios(spark, str(tmp_path)).first()
    assert (r["indel"], r["token_set"]) == (similarity.indel(a, b), similarity.token_set(a, b)) and r["indel"] < 100 and r["sequence"] < 1


def test_mcnemar_of_large_counts(spark):
    from fractions import Fraction
    from math import comb

    from corpusloom.operators import metrics

    for only_a, only_b in ((20_000, 20_300), (0, 9), (7, 0), (3, 3), (0, 0)):
        n, k = only_a + only_b, min(only_a, only_b)
        rows = spark.range(n).select((F.col("id") < only_a).alias("x"), (F.col("id") >= only_a).alias("y"))
        r = metrics.mcnemar(rows, F.col("x"), F.col("y")).first()
        term = tail = 1
        for i in range(1, k + 1):
            term = term * (n - i + 1) // i
            tail += term
        assert (r["only_a"], r["only_b"]) == (only_a, only_b) and comb(n, k) == term
        assert r["p"] == pytest.approx(float(min(Fraction(1), Fraction(2 * tail, 2**n))), rel=1e-6)


def test_spans(spark):
    from corpusloom.functions import spans

    df = spark.createDataFrame([("fever and cough",), ("no fever. cough",), ("no fever but fever",), (None,)], "x string")
    got = [r[0] for r in df.select(spans.signed_state([r"\bfever\b"], [r"\bno fever\b"])("x")).collect()]
    assert got == ["PRESENT", "ABSENT", "UNKNOWN", "UNKNOWN"]
    assert [r[0] for r in df.select(spans.not_negated("cough|fever")("x")).collect()] == [["fever", "cough"], ["cough"], [], []]
    assert spark.createDataFrame([("Mr Smith met Anna Lee in Paris",)], "x string").select(spans.person_candidates("x")).first()[0] == ["Mr Smith", "Anna Lee"]


def test_canonical_schema_error(spark):
    from corpusloom.operators import canonical, checks

    raw = spark.createDataFrame([("1", "q")], "id string, question string")
    r = canonical.canonicalize(raw, "d", "open").first()
    assert r["schema_error"] == "missing answer" and r["answer"] == "" and len(r["id"]) == 24
    assert checks.schema_difference(raw, spark.range(1)) == [("id", "string <> bigint"), ("question", "left only")]


def test_record_flags_on_fixtures(spark):
    rows = [
        ("mcqu", "q", "", None, {"A": "x", "B": "y", "C": "z", "D": "w"}, ["A"], None, None, []),
        ("mcqm", "q", "", None, {"A": "x", "B": "y", "C": "z", "D": "w"}, ["A", "B"], None, None, []),
        ("mcqu", "voir plus haut", "", None, {"A": "x", "B": "x", "C": "z", "D": "w", "E": "v"}, ["A", "B"], None, None, []),
        ("mcqu", "voir plus haut", "", "a context", {"A": "x", "B": "y", "C": "z", "D": "w", "E": "v"}, ["E"], None, None, ["PERSON"]),
        ("open", "", "Topics", None, None, [], None, None, ["URL"]),
        ("open", "q", "Is it?", None, None, [], None, None, []),
        ("open", "q", "See your doctor <|im_end|>", None, None, [], None, None, []),
        ("open", "q", " ", None, None, [], None, None, []),
        ("dpo", "q", None, None, None, [], "a b c d e f", "a", []),
        ("dpo", "q", None, None, None, [], "a  b", "a b", []),
        ("open", "q", "no no no, voir figure ci-jointe", None, None, [], None, None, []),
    ]
    want = [[], ["INVALID_QCM"], ["DUPLICATE_OPTIONS", "INVALID_QCM_MODE", "NEEDS_CONTEXT"], ["PII_CANDIDATE", "PII_HUMAN_REVIEW"],
            ["EMPTY_QUESTION", "PII_REDACTION_FAILED", "UNINFORMATIVE_ANSWER"], ["QUESTION_AS_ANSWER"], ["CHAT_CONTROL_TOKEN"], ["EMPTY_ANSWER"],
            ["DPO_LENGTH_BIAS"], ["IDENTICAL_DPO_RESPONSES"], ["EXTERNAL_REFERENCE", "TEXT_ANOMALY"]]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, family string, question string, answer string, context string, choices map<string,string>, labels array<string>, chosen string, rejected string, pii array<string>")
    c = F.col
    f = flags.record_flags(c("family"), c("question"), c("answer"), c("context"), F.coalesce("choices", F.create_map().cast("map<string,string>")), c("labels"), c("chosen"), c("rejected"), F.lit(None).cast("string"), c("pii"), F.concat_ws(" ", "question", "answer"))
    assert [list(r["f"]) for r in df.select("i", f.alias("f")).orderBy("i").collect()] == want


def test_privacy_categories_and_redaction(spark):
    rows = [("n° dossier: AB-123", "PATIENT_ID"), ("née le 03/04/1970", "DATE_OF_BIRTH"), ("Je m'appelle Anne Martin", "IDENTITY_INTRODUCTION"), ("a@b.org", "EMAIL_ADDRESS"), ("née un lundi", None)]
    df = spark.createDataFrame(rows, "t string, want string").select("t", "want", privacy.categories(F.col("t")).alias("c"), privacy.matches(F.col("t")).alias("m"), privacy.redact(F.col("t")).alias("r"))
    for r in df.select("*", privacy.residual(F.col("r")).alias("left")).collect():
        assert list(r["c"]) == ([r["want"]] if r["want"] else []) and [x["category"] for x in r["m"]] == list(r["c"]) and not r["left"]


def test_records_keys_and_scores(spark):
    m = "array<struct<role:string,content:string>>"
    df = spark.createDataFrame([(1, [("assistant", " a  b ")]), (2, [("user", "p  q"), ("assistant", "x")]), (3, [("user", "other"), ("assistant", "x")]), (4, [("user", "p q")])], f"i int, m {m}")
    assert [r[0] for r in df.orderBy("i").select(records.completion(F.col("m"), F.lit("p q"))).collect()] == ["a b", "x", None, None]
    one = spark.range(1)
    choices = F.create_map(F.lit("B"), F.lit("two"), F.lit("A"), F.lit("one"))
    assert one.select(records.assemble_input(F.lit("c"), F.lit("q"), choices)).first()[0] == "c\n\nq\nA. one\nB. two"
    assert one.select(records.unique_texts(F.array(*map(F.lit, ["Ab", "c", "aB ", "", "C", "d"])))).first()[0] == ["Ab", "c", "d"]
    keys = lambda ctx, labels: fingerprints.grouping_keys(F.lit("mcqm"), F.lit(ctx), F.lit("q"), choices, F.array(*map(F.lit, labels)), *[F.lit(None).cast("string")] * 3, F.lit("i"))
    a, b, c = one.select(keys("x", ["B", "A"]).alias("a"), keys("x", ["A", "B"]).alias("b"), keys("", ["A"]).alias("c")).first()
    assert a == b and c["context_key"] is None and a["target_key"] != c["target_key"] and a["question_key"] != c["question_key"]
    got = one.select(text.grounding(F.lit("patient assessment"), F.lit("")), text.grounding(F.lit("Pneumonia, seriously"), F.lit("a pneumonic case")), text.has_repeated_sentence(F.lit("Yes. Yes. It is a dog. It is a dog. ok"))).first()
    assert tuple(got) == (1.0, 0.5, True)
    q = curation.pair_quality(F.lit(True), F.lit(40), F.lit(131), F.lit(25), F.lit(False), F.lit(True), F.lit(False), F.lit(0.0))
    assert one.select(q).first()[0] == 1.0


def test_contracts(spark):
    r = spark.createDataFrame([(1, 1, 1), (2, 1, 2)], "id int, expected int, predicted int")
    half = spark.createDataFrame([(1, 1, 2)], "id int, expected int, predicted int")
    assert contracts.compare_covered(r, half, "id").first()["rows"] is None
    assert tuple(contracts.compare_covered(half, r, "id").first()) == (1, 0, 1, 0, 1)
    assert contracts.weakest_full(r.withColumn("v", F.lit("free")), "v", ["full", "free"], F.lit(True)).first()[0] == "free"
    assert [x.count() for x in contracts.partition_by(r, F.col("predicted") == 1)] == [1, 1]
    df = spark.createDataFrame([(1, None), (2, 0.5), (3, 2.0)], "id int, score double")
    assert {x["rule"]: x["n"] for x in contracts.violations(df, {"range": F.col("score").between(0, 1), "id": F.col("id") > 0}).collect()} == {"range": 2, "id": 0}


def test_allocation_values(spark):
    df = spark.createDataFrame([("a", 1), ("b", 100), ("c", 400), ("d", 0)], "s string, capacity long")
    assert {r["s"]: r["quota"] for r in select.quotas(df, ["s"], 31).collect()} == {"a": 1, "b": 10, "c": 20, "d": 0}


@pytest.mark.parametrize("raw, want", [
    ("Patient âgé de 4 jours", None), ("Nourrisson de 40 jours, âge : 2 mois", ("age_months", 2)), ("Femme de soixante et onze ans", ("age_years", 71)),
    ("homme de quatre-vingt-dix ans", ("age_years", 90)), ("a 34-year-old woman, 35 years old", None), ("garçon de 12 ans", ("age_years", 12)), ("depuis 12 ans", None),
])
def test_ages(spark, raw, want):
    got = one(spark, extraction.age(F.col("x")), value=raw)
    assert (tuple(got) if got else None) == (want if raw[:7] != "Patient" else ("age_days", 4))


def test_vitals_near_misses(spark):
    at = lambda f, v: one(spark, f(F.col("x")), value=v)
    pressure = lambda v: tuple(at(lambda c, k=k: extraction.blood_pressure(c)[k], v) for k in (0, 1))
    assert pressure("TA 12/8 cmHg") == (120.0, 80.0) and pressure("TA 12/8") == (None, None) and pressure("TA 80/120 mmHg") == (None, None)
    assert pressure("PAS 110 mmHg") == (110.0, None) and pressure("systolic 130 and diastolic 70") == (130.0, 70.0)
    assert at(extraction.temperature, "temp 101,3 F") == 38.5 and at(extraction.temperature, "38 °C puis 39 °C") is None and at(extraction.temperature, "temp 99 C") is None
    vital = lambda n, v: at(lambda c: extraction.vital(c, n), v)
    assert vital("heart_rate", "FC 90, pouls 90 bpm") == 90.0 and vital("heart_rate", "FC 900") is None and vital("spo2", "SpO2: 97 %") == 97.0
    assert vital("gcs", "Glasgow 14/15") == 14.0 and vital("blood_glucose_mmol_l", "glycémie 5,4 mmol/L") == 5.4 and vital("blood_glucose_mmol_l", "glycémie 1,4 g/L") is None
    assert vital("pain_score", "douleur cotée à 7/10") == 7.0 and vital("respiratory_rate", "FR 18/min") == 18.0 and vital("ketones_mmol_l", "ketones 0.6 mmol/l") == 0.6
    assert at(extraction.sex, "un homme et sa fille") is None
