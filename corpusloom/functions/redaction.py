"""Personal data by its places in a text: spans, what is left of overlapping ones, and redaction by offsets.

Spans need the places of matches, which Spark has no expression for, so one Arrow function finds and resolves
them.  Texts without any match are told by one alternation in the JVM and never go to Python.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fixed import CASED, RECOGNIZER_SCORES, RECOGNIZERS

SPAN = "struct<category:string,start:int,end:int,score:double,value_hash:string,replacement:string>"
SCAN = f"struct<spans:array<{SPAN}>,places:array<struct<category:string,start:int,end:int>>,redacted:string>"
PLACED = [("category", pa.string()), ("start", pa.int32()), ("end", pa.int32())]
SCANNED = pa.struct([("spans", pa.list_(pa.struct([*PLACED, ("score", pa.float64()), ("value_hash", pa.string()), ("replacement", pa.string())]))), ("places", pa.list_(pa.struct(PLACED))), ("redacted", pa.string())])
#: Texts that Python holds with their spans at once.
AT_ONCE = 64
TOKENS = {c: token for c, token, _ in RECOGNIZERS}
Found = tuple[str, int, int, float]


def compiled() -> list[tuple[str, re.Pattern]]:
    return [(c, re.compile(p, 0 if c in CASED else re.IGNORECASE)) for c, _, patterns in RECOGNIZERS for p in patterns]


def found_in(text: str, recognizers: list[tuple[str, re.Pattern]]) -> list[Found]:
    """(category, start, end, score) of all matches, by place; of one category at one place the best score."""
    best: dict[tuple[str, int, int], float] = {}
    for category, pattern in recognizers:
        for m in pattern.finditer(text):
            if m.end() > m.start():
                key = (category, m.start(), m.end())
                best[key] = max(best.get(key, 0.0), RECOGNIZER_SCORES[category])
    return sorted(((c, a, b, s) for (c, a, b), s in best.items()), key=lambda x: (x[1], x[2], x[0]))


def merged(spans: list[Found], text: str) -> list[Found]:
    """Spans of one category that overlap, or have only spaces between them, as one."""
    out: list[Found] = []
    last: dict[str, int] = {}
    for c, a, b, s in spans:
        k = last.get(c)
        if k is not None and (a < out[k][2] or not text[out[k][2] : a].strip(" ")):
            out[k] = (c, out[k][1], max(b, out[k][2]), max(s, out[k][3]))
        else:
            last[c] = len(out)
            out.append((c, a, b, s))
    return out


def resolved(spans: list[Found], text: str) -> list[tuple[str, int, int]]:
    """Places that do not overlap, in order.

    A span inside another one goes; of two at the same place the surer one stays, then the first category by name; where two
    overlap in part, the earlier one ends where the later one starts.
    """
    out: list[tuple[str, int, int]] = []
    reach = -1
    for c, a, b, _ in sorted(merged(spans, text), key=lambda x: (x[1], -x[2], -x[3], x[0])):
        if b <= reach:
            continue
        if out and out[-1][2] > a:
            out[-1] = (out[-1][0], out[-1][1], a)
        out.append((c, a, b))
        reach = b
    return out


def replaced(text: str, places: list[tuple[str, int, int]]) -> str:
    parts, at = [], 0
    for c, a, b in places:
        parts += [text[at:a], TOKENS[c]]
        at = b
    return "".join([*parts, text[at:]])


def _scan(texts: list[str], recognizers: list[tuple[str, re.Pattern]]) -> list[dict]:
    rows = []
    for t in texts:
        spans = found_in(t, recognizers)
        places = resolved(spans, t)
        told = [{"category": c, "start": a, "end": b, "score": s, "value_hash": hashlib.sha256(t[a:b].encode()).hexdigest(), "replacement": TOKENS[c]} for c, a, b, s in spans]
        rows.append({"spans": told, "places": [{"category": c, "start": a, "end": b} for c, a, b in places], "redacted": replaced(t, places)})
    return rows


def _scanned(batches):
    """text_hash and scan, a few texts at a time: memory does not grow with the batches that Spark sends."""
    recognizers = compiled()
    for batch in batches:
        for first in range(0, batch.num_rows, AT_ONCE):
            part = batch.slice(first, AT_ONCE)
            scans = pa.array(_scan(part.column("text").to_pylist(), recognizers), SCANNED)
            yield pa.RecordBatch.from_arrays([part.column("text_hash"), scans], names=["text_hash", "scan"])


def any_match(text: Column) -> Column:
    """Whether some recognizer may match, by one alternation that is no narrower than their union."""
    loose = r"(?i)@|https?://|[0-9][^0-9]?[0-9]|patient|dossier|medical\s*record|mrn|n[ée]e?\s|born|birth|dob|name\s+is|called|m['’]appelle|mon\s+nom"
    return text.rlike(loose)


def scan_texts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, text_hash and scan (spans by place, resolved places, redacted text) of every row; each distinct text is scanned once.

    Null texts are empty.  Rows that repeat a key are rows of their own.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(key, text.alias("text"), F.sha2(text, 256).alias("text_hash"))
    may = keyed.where(any_match(F.col("text"))).groupBy("text_hash").agg(F.any_value("text").alias("text"))
    once = may.select("text_hash", "text").mapInArrow(_scanned, f"text_hash string, scan {SCAN}")
    none = F.struct(F.array().cast(f"array<{SPAN}>").alias("spans"), F.array().cast("array<struct<category:string,start:int,end:int>>").alias("places"), F.lit(None).cast("string").alias("redacted"))
    return keyed.select(key, "text_hash").join(once, "text_hash", "left").select(key, "text_hash", F.coalesce("scan", none).alias("scan"))


def redaction_log(scans: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row a span that was found: category, place, score, digest of its value, and what replaces it."""
    return scans.select(key, F.explode("scan.spans").alias("s")).select(key, "s.*")


def redacted_digests(scans: DataFrame, key: str = "doc_id") -> DataFrame:
    """n_spans, n_replaced and the digest of the redacted text of every row."""
    return scans.select(key, F.size("scan.spans").alias("n_spans"), F.size("scan.places").alias("n_replaced"), F.coalesce(F.sha2("scan.redacted", 256), "text_hash").alias("redacted_sha256"))
