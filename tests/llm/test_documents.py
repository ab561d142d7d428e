"""Document operators against brute force, on odd rows and empty tables."""

import collections
import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from corpusloom.llm import common, langid, mixing, pieces, quality_rules, simhash, substring, suffix
from corpusloom.llm.queries import OP7_SQL, OP10_SQL, PIECE_MODEL

from ..compare import same
from . import odd

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
NULL_ID = [(None, "a row without an id " * 3, "en", "s1", 1, *["clash"] * 27)]


def by_id(frame):
    out = collections.defaultdict(list)
    for r in frame.collect():
        out[r["doc_id"]].append(r)
    return out


def source_rows(more=()):
    return [(r[0], r[1] or "") for r in [*odd.rows(), *more]]


def test_substring_against_brute_force(spark):
    rows = sorted(set(source_rows(NULL_ID)), key=lambda r: (-1 if r[0] is None else r[0], r[1]))
    seen, want = set(), {}
    for i, t in rows:
        w = t.encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(key)
        want[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    for batches in (1, 3):
        got = by_id(substring.remove_repeated_windows(odd.table(spark, NULL_ID), digest=True, batches=batches))
        assert {k: {(r["n_words"], r["n_removed"], r["kept"]) for r in v} for k, v in got.items()} == {k: {v} for k, v in want.items()}
        assert len(got[3]) == 2
    assert substring.remove_repeated_windows(odd.empty(spark)).count() == 0


def test_substring_sql(spark, tmp_path):
    import duckdb

    df = odd.table(spark).dropDuplicates(["doc_id"])
    df.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    got = substring.remove_repeated_windows(df, digest=True).withColumnRenamed("kept", "kept_sha256")
    same(got, con.execute(OP10_SQL))


def test_index_survives_compaction_and_storage(spark, tmp_path):
    rnd = random.Random(1)
    lines = [" ".join(str(rnd.randrange(10**6)) for _ in range(60)) for _ in range(12)]
    docs = spark.createDataFrame([(i, lines[i % 8]) for i in range(16)], "doc_id long, text string")
    index = substring.FingerprintIndex(spark, ranges=3, groups=4, max_runs=1)
    assert index.add(docs.where("doc_id < 4")).count() == 0
    assert index.add(docs.where("doc_id between 4 and 7")).count() == 0
    assert len(index.runs) == 1
    index.write(str(tmp_path / "index"))
    other = substring.FingerprintIndex(spark, ranges=3, groups=4)
    other.read(str(tmp_path / "index"))
    for ix in (index, other):
        assert ix.add(docs.where("doc_id >= 8")).count() > 0


@pytest.mark.parametrize("cap", [200_000, 2])
def test_suffix_against_brute_force(spark, cap):
    rows = source_rows(NULL_ID)
    count = collections.Counter()
    for _, t in rows:
        b = t.encode()
        count.update(b[k : k + 200] for k in range(len(b) - 199))
    want = collections.defaultdict(set)
    for i, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        spans = len(re.findall(b"\1+", bytes(gone)))
        want[i].add((len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    got = by_id(suffix.remove_repeated_bytes(odd.table(spark, NULL_ID), bucket_cap=cap))
    assert {k: {(r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in v} for k, v in got.items()} == dict(want)
    assert suffix.remove_repeated_bytes(odd.empty(spark)).count() == 0


def test_interval_tree_lists_all_intervals():
    rnd = random.Random(4)
    for _ in range(200):
        text = "".join(rnd.choice("ab") for _ in range(rnd.randrange(2, 14))).encode()
        order = sorted(text[i:] + b"$" for i in range(len(text)))
        common_ = [suffix.common_prefix(a, b) for a, b in zip(order, order[1:], strict=False)]
        got = {(d, a, b) for d, a, b, _ in suffix.interval_tree(common_)}
        want = set()
        for a in range(len(order)):
            for b in range(a + 1, len(order)):
                d = min(common_[a:b])
                if (a == 0 or common_[a - 1] < d) and (b == len(order) - 1 or common_[b] < d):
                    want.add((d, a, b))
        assert got == want


def test_bucket_repeats_against_all_pairs():
    rnd = random.Random(6)
    for _ in range(150):
        sides = list({("".join(rnd.choice("ab") for _ in range(rnd.randrange(0, 6))).encode(), "".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 6))).encode()) for _ in range(rnd.randrange(2, 9))})
        lefts, rights = [a for a, _ in sides], [b for _, b in sides]
        best_l, best_r = suffix.repeats_in_bucket(lefts, rights, 4)
        for i in range(len(sides)):
            pairs = [(suffix.common_prefix(lefts[i][::-1], lefts[j][::-1]), suffix.common_prefix(rights[i], rights[j])) for j in range(len(sides)) if j != i]
            ok = [(a, b) for a, b in pairs if a + b >= 4]
            assert (best_l[i], best_r[i]) == (max((a for a, _ in ok), default=0), max((b for _, b in ok), default=0))


def test_maximal_repeats_have_all_occurrences(spark):
    rnd = random.Random(2)
    part = "".join(rnd.choice("abcdefgh ") for _ in range(260))
    pad = lambda: "".join(rnd.choice("stuvwxyz") for _ in range(90))
    docs = spark.createDataFrame([(i, pad() + part + pad()) for i in range(5)], "doc_id long, text string")
    best = max(suffix.maximal_repeats(docs).collect(), key=lambda r: (len(r["occurrences"]), r["length"]))
    assert len(best["occurrences"]) == 5 and best["length"] >= 200


def test_simhash_against_brute_force(spark):
    more = [*NULL_ID, *[(200 + i, " ".join(f"w{j}" for j in range(400)) + f" {'tail' + str(i % 9)}", "en", "s1", 1, *["clash"] * 27) for i in range(80)]]
    rows = source_rows(more)

    def print_of(t):
        w = WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in t.encode()))
        s = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fp = [(i, print_of(t)) for i, t in rows]
    big = 1 << 62
    label = [big if i is None else i for i, _ in fp]
    for _ in fp:
        for a in range(len(fp)):
            for b in range(a):
                if (fp[a][1] ^ fp[b][1]).bit_count() <= 2:
                    label[a] = label[b] = min(label[a], label[b])
    want = {(i, f"{x:016x}", None if c == big else c) for (i, x), c in zip(fp, label, strict=True)}
    got = [tuple(r) for r in simhash.simhash_components(odd.table(spark, more)).collect()]
    assert set(got) == want and len(got) == len(rows)
    assert simhash.simhash_components(odd.empty(spark)).count() == 0


def test_simhash_without_ids(spark):
    body = " ".join(f"w{j}" for j in range(1500))
    print_of = lambda t: simhash.fingerprint(t.encode(), 3, xxhash.xxh64_intdigest, 42)
    near = next(t for t in (f"{body} tail{k}" for k in range(500)) if 0 < (print_of(t) ^ print_of(body)).bit_count() <= 2)
    clean = [" ".join(f"v{k}x{j}" for j in range(50)) for k in range(3)]
    docs = [(1, body), *[(None, t) for t in [near, *clean]]]
    got = {(r["fingerprint"], r["component_id"]) for r in simhash.simhash_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {(f"{print_of(t):016x}", 1 if t in (body, near) else None) for _, t in docs}


def test_simhash_dense_cells(spark):
    rnd = random.Random(9)
    base = rnd.getrandbits(64)
    points = list({base} | {base ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for _ in range(300)})
    rows = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "rep long, fp long")
    comp = common.components(df.select(F.col("rep").alias("node")), simhash.fingerprint_links(df, cell_cap=4))
    got = {i: i for i, _ in rows} | {r["node"]: r["component"] for r in comp.collect()}
    label = list(range(len(points)))
    for _ in range(6):
        for a in range(len(points)):
            for b in range(a):
                if (points[a] ^ points[b]).bit_count() <= 2:
                    label[a] = label[b] = min(label[a], label[b])
    assert got == dict(enumerate(label))


def test_segment_distance_is_a_lower_bound(spark):
    rnd = random.Random(8)
    pairs = [(rnd.getrandbits(63), rnd.getrandbits(63)) for _ in range(200)]
    df = spark.createDataFrame(pairs, "x long, y long")
    code = lambda c: simhash.segment_counts(F.col(c))
    rows = df.select("x", "y", F.bit_count(code("x").bitwiseXOR(code("y"))).alias("d")).collect()
    for r in rows:
        count = lambda v, s: (v >> 2 * s & 3).bit_count()
        assert r["d"] == sum(abs(count(r["x"], s) - count(r["y"], s)) for s in range(32)) <= (r["x"] ^ r["y"]).bit_count()


def test_near_copies_against_all_pairs(spark):
    docs = odd.table(spark)
    rows = source_rows()
    sets = []
    for _, t in rows:
        w = t.lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    label = [i for i, _ in rows]
    for _ in range(4):
        for a in range(len(rows)):
            for b in range(a):
                x, y = sets[a], sets[b]
                if len(x & y) >= 0.8 * len(x | y) and (rows[a][1] == rows[b][1] or x or not y):
                    label[a] = label[b] = min(label[a], label[b])
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_copies(docs).collect()}
    assert got == {(i, c) for (i, _), c in zip(rows, label, strict=True)}
    kept = simhash.without_near_copies(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for c in label})
    assert kept.columns == docs.columns
    assert simhash.without_near_copies(odd.empty(spark)).count() == 0


def test_near_copies_in_dense_cells(spark):
    rnd = random.Random(12)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rnd.sample(words, 60)) for _ in range(300)]  # equal word sets: all share their cells
    for k in range(20):
        w = texts[k].split()
        texts[280 + k] = " ".join([*w[:-2], w[-1], w[-2]])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs).collect()}
    assert got == {i: i - 280 if i >= 280 else i for i in range(300)}


def test_near_copies_with_contiguous_edits(spark):
    rnd = random.Random(13)
    docs, n = [], 0
    for k in range(150):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(200)]
        cut = 20 + k % 20  # the paragraph that is cut; at 39 words Jaccard is still 157 of 196
        docs += [(k, " ".join(words)), (1000 + k, " ".join(words[cut:]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(df).collect()}
    assert got == {i: i % 1000 for i, _ in docs}


def test_near_copies_without_ids(spark):
    rnd = random.Random(14)
    texts = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(60)) for _ in range(4)]
    docs = [(1, texts[0]), (None, texts[0] + " end"), (None, texts[1]), (None, texts[2]), (None, texts[2] + " end"), (7, texts[3]), (7, texts[1] + " end")]
    kept = {(r["doc_id"], r["text"]) for r in simhash.without_near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {(1, texts[0]), (7, texts[3]), (7, texts[1] + " end")} < kept and len(kept) == 4
    assert len(kept & {(None, texts[2]), (None, texts[2] + " end")}) == 1


def test_mixing_invariants_and_sql(spark, tmp_path):
    import duckdb

    df = odd.table(spark, NULL_ID)
    out = mixing.mix_sources(df)
    rows = out.collect()
    assert len(rows) == df.count() and sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix_sources(df).collect()), key=str)
    taken = collections.Counter()
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for r in rows:
        assert abs(taken[r["source"]] - r["target"]) <= max(8, 0.02 * r["target"])
    df.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    same(out.drop("source"), con.execute(OP7_SQL))
    assert mixing.mix_sources(odd.empty(spark)).count() == 0
    assert mixing.mixed_documents(odd.empty(spark)).count() == 0
    assert mixing.mixed_documents(df).columns == df.columns


def test_quota_is_sainte_lague(spark):
    rnd = random.Random(12)
    for seats in (0, 1, 7, 100, 1003):
        values = {f"s{i:02d}": rnd.choice([0, 1, 3, 50, 1000, 1000]) for i in range(23)}
        df = spark.createDataFrame([("g", k, float(v)) for k, v in values.items()], "g string, k string, v double")
        got = {r["k"]: r["quota"] for r in mixing.quota_by_quotients(df, ["g"], ["k"], "v", F.lit(seats)).collect()}
        want = dict.fromkeys(values, 0)
        for _ in range(seats):
            k = min((k for k in values if values[k]), key=lambda k: (-values[k] / (2 * want[k] + 1), k))
            want[k] += 1
        assert got == want


def test_quality_statistics(spark):
    got = by_id(quality_rules.text_statistics(odd.table(spark), ["doc_id"]))
    word = re.compile(r"[^\x20\x09-\x0D]+")
    for i, t in source_rows():
        w = word.findall(t)
        g = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {j for k in range(len(w) - 7) if g[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        lines = [x for x in t.split("\n") if word.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        for r in got[i]:
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want


def test_decision_list_learns_and_stays_honest(spark):
    rnd = random.Random(7)
    rows = [{f: rnd.random() for f in quality_rules.FEATURES} for _ in range(900)]
    for r in rows:
        r["low"] = r["symbol_share"] > 0.8 and r["n_words"] < 0.6
    rules = quality_rules.learn_rules(rows)
    fires = lambda r: any(all(c.holds(r) for c in rule) for rule in rules)
    assert sum(fires(r) == r["low"] for r in rows) > 0.95 * len(rows)
    noise = [r | {"low": rnd.random() < 0.3} for r in rows]
    assert sum(len(r) for r in quality_rules.learn_rules(noise)) <= 4
    assert quality_rules.learn_rules([]) == []
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1), (None, 1, 0), (0, None, 0)], "doc_id long, quality int, toxic int")
    out = quality_rules.judge_quality(odd.table(spark), labels)
    assert out.count() == len(odd.rows())
    assert quality_rules.judge_quality(odd.empty(spark), labels).count() == 0
    assert quality_rules.judge_quality(odd.table(spark), labels.limit(0)).where("kept = base_failed").count() == 0


def test_gradients_by_differences():
    import numpy as np

    net = langid.train([b"abcabc" * 20, b"xyzxyz" * 20], ["a", "b"], units=3, steps=1, rows=4)
    rng = np.random.default_rng(0)
    x = rng.integers(97, 123, (4, 5)).astype(np.uint8)
    for k in net.w:
        net.w[k] = net.w[k].astype(np.float64)
    pick = rng.standard_normal((5, 4, 3))
    trace: list = []
    net.states(x, "f", trace)
    grad: dict = {}
    langid._backward(net, "f", x, trace, pick, grad)
    for name, place in (("in_f", (int(x[0, 2]), 1)), ("zr_f", (0, 4)), ("n_f", (2, 1))):
        value = lambda: float((net.states(x, "f").astype(np.float64) * pick).sum())
        w, step = net.w[name], 1e-2
        w[place] += step
        up = value()
        w[place] -= 2 * step
        down = value()
        w[place] += step
        assert abs((up - down) / (2 * step) - grad[name][place]) < 2e-2


def test_language_id_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    net = langid.fit(docs, units=6, steps=120)
    out = langid.identify_languages(docs, net, ["doc_id", "lang"]).select("carried.*", "lang_pred", "score").withColumn("held", F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
    n, ok = out.where("held").agg(F.count(F.lit(1)), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert ok >= 0.95 * n
    odd_out = by_id(langid.identify_languages(odd.table(spark), net, ["doc_id", "text"]).select("carried.*", "lang_pred", "score"))
    for i, t in source_rows():
        for r in odd_out[i]:
            assert 0 <= r["score"] <= 1 and (r["lang_pred"] == "und") == (not any(c.isalpha() for c in t))
    assert langid.fit(odd.empty(spark)) is None
    assert langid.identify_languages(odd.table(spark), None, ["doc_id"]).where("lang_pred <> 'und'").count() == 0


def test_pieces_match_the_library(spark):
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=PIECE_MODEL)
    model = pieces.PieceModel.load(PIECE_MODEL)
    rnd = random.Random(1)
    texts = ["", " ", "   \n\t x", "日本語テキスト", "🙂 naïve <s> <0x41>", "▁▁a b", "aaaa" * 60, "the" * 50 + " " + "ing" * 60, "\r\n\r\n", "12.50"]
    texts += ["".join(rnd.choice("abcdeth ing\n▁é.0🙂日") for _ in range(rnd.randint(1, 300))) for _ in range(200)]
    enc = pieces.Encoder(model)
    ids, ends = enc.encode(texts)
    for k, t in enumerate(texts):
        assert ids[ends[k] : ends[k + 1]].tolist() == sp.encode(t)
    assert [d.decode("utf-8", "replace") for d in enc.decode(ids, ends)] == [sp.decode(sp.encode(t)) for t in texts]
    out = pieces.encode_documents(odd.table(spark), model, ["doc_id", "size"])
    back = by_id(pieces.decode_documents(out, model, ["doc_id"]))
    for i, t in source_rows():
        assert {r["decoded"] for r in back[i]} == {t}
    for r in out.collect():
        assert r["round_trip"] and list(r["ids"]) == sp.encode(dict(source_rows())[r["doc_id"]])
    assert pieces.encode_documents(odd.empty(spark), model, ["doc_id"]).count() == 0
