"""The near-dedup stage of the pipeline."""

import random

import pytest

import corpus_pipeline as C
from monthlens.llm import minhash
from monthlens.llm.minhash import near_duplicates


def copies(rnd, changes):
    """207 words and a copy with single words changed: 203 shingles, five lost for each change."""
    words = [f"w{rnd.randint(0, 10**9)}" for _ in range(207)]
    other = list(words)
    for k in range(changes):
        other[20 + 40 * k] = f"v{rnd.randint(0, 10**9)}"
    return " ".join(words), " ".join(other)


def test_pairs_between_080_and_085(spark, documents):
    rnd = random.Random(11)
    rows = []
    for k in range(12):
        a, b = copies(rnd, 4)  # 183 of 223: 0.8206
        rows += [(2 * k, a), (2 * k + 1, b)]
    a, b = copies(rnd, 5)  # 178 of 228: 0.781
    rows += [(100, a), (101, b)]
    docs = documents(rows)
    assert sorted(r.doc_id for r in C.near(spark, docs, "").collect()) == [*range(0, 24, 2), 100, 101]
    assert all(r.kept for r in near_duplicates(docs).collect())  # op9 stays at 85


def test_matches_follow_the_threshold():
    assert minhash.matches(85) == 36 and minhash.matches(80) == 31 and minhash.matches(100) == 64


@pytest.mark.parametrize("sent", [1_000_000, 0])
def test_rows_of_one_id_and_different_texts(spark, documents, monkeypatch, sent):
    monkeypatch.setattr(C, "BROADCAST_ROWS", sent)
    rnd = random.Random(12)
    a, b = copies(rnd, 2)
    alone = copies(rnd, 0)[0]
    docs = documents([(1, a), (7, b), (7, alone), (7, alone), (8, alone + " x")], extra=("thash", "_text_hash"))
    got = C.near(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted([(1, a), (7, alone)])
