"""Vectors, URLs and conversations against brute force; the pipeline stage by stage."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import chat, urls, vectors

from . import odd


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((30, 16))
    rows = []
    for i in range(300):
        v = base[i % 30] + rng.standard_normal(16) * rng.choice([0.0, 0.03, 0.12, 0.5])
        rows.append((i, [float(np.float32(x)) for x in v], [None, 1, 1, 2][i % 4], "clash"))
    rows += [(300, None, 1, ""), (301, [0.0] * 16, 1, ""), (302, [None, 1.0], 1, ""), (303, [float("nan")] * 16, 1, ""), (304, [float("inf")] + [1.0] * 15, 1, ""), (305, [1.0, 2.0], 1, ""), (306, [2.0, 4.0], 1, ""), (307, [], 1, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(df).collect()}
    ok = {i: np.array(v, dtype=np.float64) for i, v, k, _ in rows if k is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    lab = {r[0]: r[2] for r in rows}
    label, n = {r[0]: r[0] for r in rows}, dict.fromkeys((r[0] for r in rows), 0)
    links = [(a, b) for a in ok for b in ok if a < b and lab[a] == lab[b] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= 0.98]
    for a, b in links:
        n[a] += 1
        n[b] += 1
    for _ in range(20):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {i: (n[i], label[i], label[i] == i) for i in label}
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_vectors_without_ids(spark):
    x, near, y, z = [1.0, 0.0, 0.0], [1.0, 0.1, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(1, x, 1), (None, near, 1), (None, y, 1), (None, x, 2), (None, z, 1), (5, z, 2)]
    got = [tuple(r) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()]
    want = [(1, 1, 1, True), (None, 1, 1, False), (5, 0, 5, True), *[(None, 0, None, True)] * 3]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_calibration_meets_the_wanted_recall():
    rng = np.random.default_rng(1)
    window, count = vectors.calibrate(0.98, 48, 3, 0.001)
    a = rng.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    r = rng.standard_normal((4000, 64))
    r -= (r * a).sum(1, keepdims=True) * a
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * r / np.linalg.norm(r, axis=1, keepdims=True)
    d = vectors.directions(48, 64, 9)
    close = np.abs(a @ d.T - b @ d.T) <= window
    found = close[:, :3].all(axis=1) & (close[:, 3:].sum(axis=1) >= count)
    assert found.mean() > 0.99


def test_half_steps_meet_every_pair_of_cells_once():
    for n in (1, 2, 3):
        steps = set(vectors._half_steps(n))
        assert len(steps) == (3**n + 1) // 2
        assert all(tuple(-x for x in s) not in steps for s in steps if any(s))


URLS = [
    (1, "http://A.Example.ORG/es/1?x", ("a.example.org", "/es/1"), "example.org/es/"),
    (2, "http://example.org/en/12", ("example.org", "/en/12"), "example.org/en/1"),
    (3, "http://example.org/fr/", ("example.org", "/fr/"), "org/"),
    (4, "http://org", ("org", ""), None),
    (5, "http://shop.com/fr/1#t", ("shop.com", "/fr/1"), "com/fr/"),
    (6, "http://shop.com/de/1", ("shop.com", "/de/1"), "com/de/"),
    (7, "http://notcom/de/1", ("notcom", "/de/1"), None),
    (8, None, ("", ""), None),
    (9, "no scheme/de/", ("", ""), None),
    (10, "x://h?q=/de/", ("h", ""), None),
]


def test_url_parts_and_rules(spark):
    df = spark.createDataFrame([(i, u, "<a href='http://h/x'>", "clash") for i, u, *_ in URLS], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in urls.filter_urls(df.drop("host"), tolerance=0.2).collect()}
    for i, _, (host, path), rule in URLS:
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        if rule:
            assert got[i]["verdict"] == ("block" if rule in ("example.org/es/", "example.org/en/1", "com/de/") else "allow")
    assert urls.filter_urls(df, tolerance=0.2).count() == len(URLS)
    assert urls.filter_urls(df.limit(0)).count() == 0


def test_propagation_against_matrices(spark):
    rnd = random.Random(3)
    n = 12
    w = np.zeros((n, n))
    for _ in range(30):
        a, b = rnd.sample(range(n), 2)
        w[a, b] += 1
    good, bad = np.zeros(n), np.zeros(n)
    good[0], bad[5] = 1, 1
    out = np.divide(w, w.sum(1, keepdims=True), where=w.sum(1, keepdims=True) > 0, out=np.zeros_like(w))
    into = np.divide(w, w.sum(0, keepdims=True), where=w.sum(0, keepdims=True) > 0, out=np.zeros_like(w))
    t, d = np.linalg.inv(np.eye(n) - 0.85 * out.T) @ good, np.linalg.inv(np.eye(n) - 0.85 * into) @ bad
    t, d = t / t.sum(), d / d.sum()
    hosts = spark.createDataFrame([(f"h{i}", float(good[i]), float(bad[i])) for i in range(n)], "host string, good double, bad double")
    links = spark.createDataFrame([(f"h{a}", f"h{b}", float(w[a, b])) for a in range(n) for b in range(n) if w[a, b]], "src string, dst string, weight double")
    got = {r["host"]: (r["trust"], r["distrust"]) for r in urls.propagate(hosts, links, tolerance=1e-4).collect()}
    for i in range(n):
        assert np.allclose(got[f"h{i}"], (t[i], d[i]), atol=1e-3)


def test_host_links(spark):
    pages = spark.createDataFrame([("a.x.com", '<a href="https://B.com/p"> <img src=//x.com/i> <a href="/local">'), ("b.com", None), ("x.com", "<a href='http://unknown.net'>")], "host string, html string")
    got = {(r["src"], r["dst"]): r["weight"] for r in urls.host_links(pages, pages.select("host")).collect()}
    assert got == {("a.x.com", "b.com"): 1.0, ("a.x.com", "x.com"): 2.0, ("x.com", "a.x.com"): 1.0}


@pytest.mark.parametrize("budget, history", [(512, 128), (20, 5), (1, 0), (60, 200)])
def test_chat_round_trip(spark, budget, history):
    rnd = random.Random(2)
    bits = ["<|im_end|>", "<|im_start|>assistant\n", "\\", "<", "|", "<\\|", "word", " ", "\n", "é🙂"]
    rows = []
    for c in [None, 0, 1, 2, 3, 4]:
        for t in range(rnd.randrange(1, 12)):
            role = rnd.choice(["system" if t == 0 else "user", "assistant", "user", None, "odd\nrole<|"])
            rows.append((c, rnd.choice([t, t, None]), role, rnd.choice([None, "", "".join(rnd.choice(bits) for _ in range(30))]), "clash"))
    rows += [rows[0], (7, 0, "system", "be brief", ""), *[(7, k, ["assistant", "user"][k % 2], "w " * k, "") for k in range(1, 30)]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window string")
    windows = chat.format_conversations(df, budget=budget, history=history)
    got = {r["conv_id"]: r for r in chat.conversation_digests(windows).collect()}
    order = lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())
    for c in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=order)]
        loss = "".join(t for role, t in turns if role == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    seven = [w for w in windows.where("conv_id = 7").orderBy("window").collect()]
    assert all(w["text"].startswith("<|im_start|>system\nbe brief") for w in seven)
    assert chat.conversation_digests(chat.format_conversations(df.limit(0))).count() == 0


def test_windows_keep_to_the_budget():
    turns = [("system", "s")] + [("user" if k % 2 else "assistant", "w " * 10) for k in range(40)]
    sizes = []
    for text, repeated, _, _ in chat.format_conversation(turns, 100, 30):
        got = list(chat.TURN.finditer(text))
        sizes.append(sum(len(m[2].split()) + chat.MARKS for m in got))
        assert len(got) > repeated
    assert max(sizes) <= 100 and len(sizes) > 3


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["language ID", "SimHash near-dedup", "substring dedup", "mixing sources to target weights", "SentencePiece encoding and decoding"]
    docs = odd.table(spark)
    columns = docs.columns
    seen = []
    for k, (_, stage) in enumerate(p.STAGES):
        stage(spark, docs, None).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(docs)
        assert k == 4 or docs.columns == columns
    lettered = {r[0] for r in odd.rows() if r[1] and any(c.isalpha() for c in r[1])}
    assert {r["doc_id"] for r in seen[0].collect()} <= lettered
    one, two = ([r["doc_id"] for r in seen[k].collect()] for k in (0, 1))
    assert set(two) <= set(one) and len(two) == len(set(two)) and 1 not in two and 3 not in two
    before, passages = {r["doc_id"]: r["text"] for r in seen[1].collect()}, set()
    for r in seen[2].orderBy("doc_id").collect():
        assert r["n_chars"] == len(r["text"]) and r["text"].split()
    after = {r["doc_id"]: r["text"] for r in seen[2].collect()}
    for i in sorted(before):  # each later window of 20 words that stood before is gone
        w = before[i].encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in passages:
                gone[k : k + 20] = [True] * 20
            passages.add(key)
        left = [x for x, g in zip(w, gone, strict=True) if not g]
        assert after.get(i, "").encode().split() == left
    texts = {r["doc_id"]: r["text"] for r in seen[2].collect()}
    copies = seen[3].groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("text").alias("t")).collect()
    assert all(1 <= r["n"] <= 2 and texts[r["doc_id"]] == r["t"] for r in copies)
    assert seen[4].count() == seen[3].count() and seen[4].where("not round_trip").count() == 0


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline as p

    odd.empty(spark).write.parquet(str(tmp_path / "documents.parquet"))
    assert p.run(spark, str(tmp_path)).count() == 0
