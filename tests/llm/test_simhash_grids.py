"""The SimHash grids of the pipeline's near-dedup."""

import random

import numpy as np

from corpusloom.llm import common, simhash


def test_wide_simhash_and_cells_against_loops():
    rnd = np.random.default_rng(3)
    sets = [np.unique(rnd.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 4, 0, 7, 140_000, 2)]
    got = simhash.wide_simhash(sets)
    for s, words in zip(sets, got, strict=True):
        s = s if len(s) else np.zeros(1, dtype=np.uint64)
        for f, word in zip(common.stream64(len(simhash.KS), simhash.SHINGLE_SEED + 1), words.astype(">u8").view(np.uint8).reshape(-1, 8), strict=True):
            bits = np.unpackbits(common.mix64(s * f).view(np.uint8).reshape(-1, 8), axis=1)
            assert np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(s)).tolist() == word[::-1].tolist()
    cell = lambda x: simhash.count_cells(np.array([[x, 0, 0, 0]], dtype=np.uint64), 1, 128)[0, 0]
    assert cell(1) == cell(2) != cell(3) != cell(0) != cell(1)  # 01 and 10 have the same count
    one = simhash.count_cells(np.array([[0, 0, 0, 0], [0, 1 << 40, 0, 0]], dtype=np.uint64), 200, 20)
    assert 10 < (one[0] != one[1]).sum() < 60  # a grid holds 20 of 128 segments


def test_near_copies_meet_in_the_grids_of_segment_counts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GRIDS", 1)
    monkeypatch.setattr(simhash, "JOINED", 800)  # no minwise cell holds two different sets
    rnd = random.Random(15)
    docs = []
    for k in range(40):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(200)]
        docs += [(k, " ".join(words)), (100 + k, " ".join([*words[:-1], "other"]))]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: i % 100 for i, _ in docs}
