"""Vector codes against plain loops over Python integers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from monthlens.llm import vectors
from monthlens.llm.vectors import Block, compress, decompressed, digest, whole, with_group_error


def brute(rows, parts, entries, rounds, scale=4096):
    """By the contract: (vec_id -> (code, error)), codebooks; floor of a Fraction-free product."""
    from fractions import Fraction

    kept = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    if not kept:
        return [], []
    cut = lambda v: [[math.floor(Fraction(x) * scale) for x in p] for p in np.array_split(np.array(v, object), parts)]
    dims = len(kept[0][1])
    own = [(i, cut(v)) for i, v in kept if len(v) == dims]
    books = [[c[p] for _, c in own[:entries]] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), e) for e, entry in enumerate(book))

    for _ in range(rounds):
        new = []
        for p, book in enumerate(books):
            members = {}
            for _, c in own:
                members.setdefault(nearest(c[p], book)[1], []).append(c[p])
            new.append([[sum(col) // len(members[e]) for col in zip(*members[e])] if e in members else entry for e, entry in enumerate(book)])
        books = new
    out = []
    for i, c in own:
        found = [nearest(c[p], books[p]) for p in range(parts)]
        out.append((i, bytes(e for _, e in found), sum(d for d, _ in found)))
    return out, books


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, k % 3 if k % 5 else None, "x") for k, (i, v) in enumerate(rows)], f"vec_id long, embedding array<{kind}>, label int, CODE string").repartition(4)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_against_loops(spark, kind):
    rnd = random.Random(1)
    real = (lambda: float(np.float32(rnd.gauss(0, .3)))) if kind == "float" else (lambda: rnd.gauss(0, .3))
    rows = [(k, [real() for _ in range(16)]) for k in range(200)]
    rows += [(300 + k, rows[0][1]) for k in range(90)]                                   # a third alike
    rows += [(400, None), (401, [None] * 16), (402, [float("nan")] + [0.0] * 15), (403, [float("inf")] + [0.0] * 15)]
    rows += [(None, rows[1][1]), (None, rows[2][1]), (5, rows[3][1]), (5, rows[3][1]), (-7, [0.0] * 16)]
    codes, books = compress(frame(spark, rows, kind), parts=4, entries=8, rounds=5)
    want, want_books = brute(rows, 4, 8, 5)
    assert books == want_books
    got = [(r.vec_id, bytes(r.code), r.error) for r in codes.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert codes.columns == ["vec_id", "label", "code", "error"]
    grouped = with_group_error(codes.withColumn("label_error", F.lit("old")), "label").collect()
    for r in grouped:
        assert r.label_error == sum(x.error for x in grouped if x.label == r.label) and type(r.label_error) is int
    middle = {r.vec_id: r.vector for r in decompressed(codes, books).collect()}
    one = next(g for g in got if g[0] == 10)
    assert middle[10] == [(x + 0.5) / 4096 for p, e in enumerate(one[1]) for x in books[p][e]]


def test_ties_unused_entries_and_few_rows(spark):
    same = [(k, [0.5, -0.5, 0.25, 1.0]) for k in range(40)]
    codes, books = compress(frame(spark, same), parts=2, entries=4)
    assert {bytes(r.code) for r in codes.collect()} == {b"\0\0"}
    assert books == [[[2048, -2048]] * 4, [[1024, 4096]] * 4]
    three = [(k, [float(k)] * 4) for k in range(3)]
    codes, books = compress(frame(spark, three), parts=2)
    assert sorted(bytes(r.code) for r in codes.collect()) == [b"\0\0", b"\1\1", b"\2\2"] and len(books[0]) == 3


def test_other_lengths_and_parts_that_do_not_divide(spark):
    rows = [(k, [k / 7, k / 5, k / 3, 1.0, 2.0]) for k in range(30)] + [(100, [1.0]), (101, [])]
    codes, books = compress(frame(spark, rows, "double"), parts=2, entries=4)
    want, want_books = brute(rows, 2, 4, 6)
    assert books == want_books and [len(b[0]) for b in books] == [3, 2]
    got = {r.vec_id: (r.code and bytes(r.code), r.error) for r in codes.collect()}
    assert got[100] == got[101] == (None, None) and got == {i: (c, e) for i, c, e in want} | {100: (None, None), 101: (None, None)}


def test_very_large_components(spark):
    rnd = random.Random(8)
    rows = [(k, [rnd.choice([-1, 1]) * 10.0 ** rnd.randint(-3, 300) for _ in range(4)]) for k in range(60)]
    codes, books = compress(frame(spark, rows, "double"), parts=2, entries=4)
    want, want_books = brute(rows, 2, 4, 6)
    assert books == want_books
    assert sorted((r.vec_id, bytes(r.code), r.error) for r in codes.collect()) == sorted((i, c, e if e < 1 << 63 else None) for i, c, e in want)
    assert with_group_error(codes, "label").count() == 60


def test_blocks_of_any_size_agree(spark, monkeypatch):
    rnd = random.Random(2)
    rows = [(k, [rnd.gauss(0, 1) for _ in range(6)]) for k in range(150)]
    whole_blocks = compress(frame(spark, rows, "double"), parts=3, entries=5)
    monkeypatch.setattr(vectors, "ROWS", 7)
    small = compress(frame(spark, rows, "double"), parts=3, entries=5)
    assert small[1] == whole_blocks[1] and digest(small[1]) == digest(whole_blocks[1])
    assert sorted(map(tuple, small[0].collect())) == sorted(map(tuple, whole_blocks[0].collect()))


def test_block_reads_what_it_wrote():
    cells = np.array([[1, -5], [3, -5], [1, 7]])
    again = Block.read(Block.of(cells).row())
    assert [v.tolist() for v in again.values] == [[1, 3], [-5, 7]] and [c.tolist() for c in again.codes] == [[0, 1, 0], [0, 0, 1]]
    big = whole(np.array([[1e300, -0.5]]), 4096)
    assert big.tolist() == [[int(1e300) * 4096, -2048]] and [v.tolist() for v in Block.read(Block.of(big).row()).values] == [[int(1e300) * 4096], [-2048]]


def test_nothing(spark):
    codes, books = compress(frame(spark, []))
    assert codes.count() == 0 and books == [] and digest(books) == digest([])
    codes, books = compress(frame(spark, [(1, None), (2, [float("nan")])]))
    assert codes.count() == 0 and books == []
    codes, books = compress(frame(spark, [(1, []), (2, [])]))
    assert sorted((r.vec_id, r.error) for r in codes.collect()) == [(1, 0), (2, 0)]
