"""op9 against brute force, connected components, and posting lists."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from monthlens.llm import minhash
import monthlens.llm.components as C
from monthlens.llm.components import components
from monthlens.llm.minhash import near_duplicates

SPLIT = re.compile("[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, percent=85):
    sets = {}
    for i, text in rows:
        w = SPLIT.findall(lower(text or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus():
    rnd = random.Random(8)
    words = [f"W{k}" for k in range(3000)]
    text = lambda n: [rnd.choice(words) for _ in range(n)]
    rows, k = [], 0
    passage = text(60)

    def add(w):
        nonlocal k
        rows.append((k, " ".join(w)))
        k += 1

    for _ in range(40):
        add(text(rnd.randint(1, 300)))
    for n in (40, 150, 400):  # groups of near copies, some just off the threshold
        base = text(n)
        for _ in range(25):
            w = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 3])):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            add(w)
    chain = text(200)  # each is like the one before, the ends are not alike
    for _ in range(15):
        chain = chain[8:] + text(8)
        add(chain)
    for _ in range(30):  # mostly one passage, otherwise different
        add(passage + text(rnd.randint(3, 40)))
    for w in ([], ["a"], ["a"], ["A"], ["a", "b", "c", "d"], ["a", "b", "c", "d"], ["a"] * 50, ["a"] * 70):
        add(w)
    rows += [(k + 1, None), (k + 2, " \n"), (k + 3, rows[50][1].lower()), (k + 4, rows[50][1].replace(" ", "\t\n"))]
    return rows


@pytest.mark.parametrize("block", [1024, 4])
def test_components_as_brute_force(documents, block):
    rows = corpus()
    got = near_duplicates(documents(rows, extra=("node", "n_shingles", "label")), block=block).collect()
    want = brute(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == want
    assert len(got) == len(rows)


def test_null_ids_and_rows_given_twice(documents):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(None, text), (7, text), (7, text), (9, text + " x"), (None, "alone on this"), (None, None), (3, "")]
    got = sorted([tuple(r) for r in near_duplicates(documents(rows)).collect()], key=str)
    assert got == sorted([(None, 36, 7, False), (7, 36, 7, True), (7, 36, 7, True), (9, 37, 7, False), (None, 1, None, True), (None, 0, None, True), (3, 0, 3, True)], key=str)
    assert near_duplicates(documents([])).collect() == []


def test_components_of_paths_and_stars(spark):
    rnd = random.Random(1)
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 520)] + [(900, 900), (7, 8), (8, 7)]
    rnd.shuffle(edges)
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{k: 100 for k in range(100, 161)}, **{k: 500 for k in range(500, 520)}, 7: 7, 8: 7}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_components_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(C, "BROADCAST_EDGES", 0)
    edges = [(k, k + 1) for k in range(100, 110)] + [(50, k) for k in range(106, 120)] + [(7, 8), (8, 7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{k: 50 for k in (50, *range(100, 120))}, 7: 7, 8: 7}


def test_stars_take_no_round(spark, monkeypatch):
    written = []
    monkeypatch.setattr(C, "stored", lambda df, real=C.stored: (written.append(1), real(df))[1])
    edges = [(500, k) for k in range(501, 520)] + [(7, 8)]
    assert dict(components(spark.createDataFrame(edges, "a long, b long")).collect()) == {**{k: 500 for k in range(500, 520)}, 7: 7, 8: 7}
    assert len(written) == 2                                    # the edges and the labels


def test_lists_keep_state_between_batches():
    rnd = random.Random(2)
    rows = sorted((rnd.randint(0, 30), n) for n in range(60))
    by = defaultdict(list)
    for e, n in rows:
        by[e].append(n)
    want = sorted((e, n, min(m)) for e, m in by.items() if len(m) > 1 for n in m)
    for size in (1, 2, 7, 60):
        parts = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[k : k + size]], pa.int64()), pa.array([r[1] for r in rows[k : k + size]], pa.int64())], ["e", "node"]) for k in range(0, 60, size)]
        got = sorted(t for b in minhash.lists(iter(parts)) for t in zip(*(c.to_pylist() for c in b.columns)))
        assert got == want


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 62, 20000).astype(np.uint64)
    b = np.concatenate([a[:17000], rng.integers(0, 1 << 62, 3000).astype(np.uint64)])
    share = (minhash.signature(np.unique(a)) == minhash.signature(np.unique(b))).mean()
    assert abs(share - 17 / 23) < 0.2
