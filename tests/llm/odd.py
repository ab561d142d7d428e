"""A small table with every odd case: nulls, empty and long texts, ties, repeats and clashing extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, fp string, db string, kept string, score string, lang_pred string, rep string, n_words string, component string, label string, draw string, word string, _bytes string, _id string, _size string, _letters string, _predicted string, _confidence string, _content string, _doc_id string, _source string, carried string, row string, rest string, k1 string, shards string, copies string"


def texts():
    rnd = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "the", "of", "une", "pour", "und", "der", "für", "ñandú", "日本"]
    make = lambda n: " ".join(rnd.choice(words) + str(rnd.randrange(40)) for _ in range(n))
    passage, body = make(60), make(300)
    near = body.split()
    near[7], near[150] = "changed", "other"
    out = [body, body, body + "\n", " ".join(near), make(120) + " " + passage + " " + make(50), passage + "\t" + make(20), make(20) + "\n" + passage, "", "   \n", None, "a", "1234 5678", "!!! ???", "x" * 5000, "same words " * 400, make(4000), passage, make(19), make(20), "a\x00b c"]
    return out + [make(rnd.randrange(1, 80)) for _ in range(40)]


def rows():
    out = []
    for i, t in enumerate(texts()):
        lang = [None, "en", "fr", "de"][i % 4]
        source = [None, "s1", "s2", "s1", "hot", "hot"][i % 6]
        out.append((i, t, lang, source, len(t) if t else 0, *["clash"] * 27))
    out.append((3, out[3][1], "en", "s1", 1, *["clash"] * 27))  # a repeated row
    return out


def table(spark, more=()):
    return spark.createDataFrame([*rows(), *more], SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
