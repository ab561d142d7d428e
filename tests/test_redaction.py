"""Spans, overlaps and redaction by offsets, against loops over characters."""

import hashlib
import random
import re

import pyarrow as pa

from corpusloom.functions import redaction
from corpusloom.functions.fixed import CASED, RECOGNIZER_SCORES, RECOGNIZERS

PIECES = ["mail a.b@c.org", "http://x.org/?q=a@b.com", "my name is Jane Doe", "né le 01/02/1990", "MRN: 12345", "10.0.0.1", "+33 12 34 56 78", "1 85 05 78 006 084 36", "patient id AB-12", "je m'appelle Zoë", "plain words", "née 1990-01-02", "dob 1/2/99", "x@y.fr z@w.fr", "10.0.0.1 10.0.0.2", "\n", "https://10.0.0.1/a"]


def texts():
    rnd = random.Random(7)
    return [None, "", "no data at all", *PIECES, *[rnd.choice([" ", "", ", "]).join(rnd.choices(PIECES, k=rnd.randrange(1, 6))) for _ in range(200)]]


def spans_by_loop(text):
    out = set()
    for c, _, patterns in RECOGNIZERS:
        for p in patterns:
            out |= {(c, m.start(), m.end(), RECOGNIZER_SCORES[c]) for m in re.finditer(p, text, 0 if c in CASED else re.IGNORECASE)}
    return out


def redacted_by_loop(text, spans):
    """Owner of each character: the last span to start there that is inside no other."""
    while True:  # spans of a category that touch or overlap become one
        pair = next(((x, y) for x in spans for y in spans if x != y and x[0] == y[0] and x[1] <= y[1] and (y[1] < x[2] or text[x[2] : y[1]].strip(" ") == "")), None)
        if pair is None:
            break
        x, y = pair
        spans = (spans - {x, y}) | {(x[0], x[1], max(x[2], y[2]), max(x[3], y[3]))}
    beats = lambda o, s: (o[1], o[2]) != (s[1], s[2]) and o[1] <= s[1] and s[2] <= o[2] or (o[1], o[2]) == (s[1], s[2]) and (-o[3], o[0]) < (-s[3], s[0])
    left = [s for s in spans if not any(beats(o, s) for o in spans if o != s)]
    owner = [max((s for s in left if s[1] <= i < s[2]), key=lambda s: s[1], default=None) for i in range(len(text))]
    out, last = [], None
    for ch, o in zip(text, owner, strict=True):
        if o is None:
            out.append(ch)
        elif o != last:
            out.append(redaction.TOKENS[o[0]])
        last = o
    return "".join(out)


def test_spans_and_redaction_against_loops(spark):
    rows = list(enumerate(texts()))
    scans = redaction.scan_texts(spark.createDataFrame([*rows, rows[5]], "doc_id int, text string"))
    got = {}
    for r in redaction.redaction_log(scans).collect():
        got.setdefault(r["doc_id"], set()).add((r["category"], r["start"], r["end"], r["score"], r["value_hash"], r["replacement"]))
    want = {i: {(c, a, b, s, hashlib.sha256(t[a:b].encode()).hexdigest(), redaction.TOKENS[c]) for c, a, b, s in spans_by_loop(t)} for i, t in rows if t}
    assert got == {i: v for i, v in want.items() if v}
    told = redaction.redacted_digests(scans).collect()
    assert len(told) == len(rows) + 1
    assert {r["doc_id"]: r["redacted_sha256"] for r in told} == {i: hashlib.sha256(redacted_by_loop(t or "", spans_by_loop(t or "")).encode()).hexdigest() for i, t in rows}


def test_overlaps():
    spans = [("URL", 0, 30, 0.6), ("EMAIL_ADDRESS", 10, 20, 1.0), ("FR_NIR", 40, 50, 0.85), ("PHONE_NUMBER", 45, 60, 0.6), ("IP_ADDRESS", 70, 80, 0.6), ("PHONE_NUMBER", 70, 80, 0.6)]
    assert redaction.resolved(spans, "x" * 100) == [("URL", 0, 30), ("FR_NIR", 40, 45), ("PHONE_NUMBER", 45, 60), ("IP_ADDRESS", 70, 80)]
    assert redaction.merged([("URL", 0, 3, 0.6), ("URL", 4, 6, 0.6), ("URL", 8, 9, 0.6)], "aaa bb,,c") == [("URL", 0, 6, 0.6), ("URL", 8, 9, 0.6)]


def test_scans_come_in_small_batches():
    batch = pa.RecordBatch.from_pydict({"text_hash": [str(i) for i in range(1000)], "text": ["mail a@b.example.org"] * 1000})
    out = list(redaction._scanned([batch]))
    assert sum(b.num_rows for b in out) == 1000 and max(b.num_rows for b in out) <= redaction.AT_ONCE
    assert [x.as_py() for b in out for x in b.column("text_hash")] == [str(i) for i in range(1000)] and out[0].column("scan")[0].as_py()["spans"]
