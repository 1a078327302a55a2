"""op6 and op3 against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from monthlens.llm import lines as L
from monthlens.llm.decontaminate import decontaminate, leaks


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows, most=2, shortest=40):
    """Kept text of each (doc_id, text), by classes of lines."""
    rows = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    place, order = {}, []
    for i, text in rows:
        for k, line in enumerate((text or "").split("\n") if text is not None else []):
            if line.strip(" "):
                place.setdefault(line, len(order))
                order.append(line)
    kinds = list(place)
    root = {x: x for x in kinds}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    long = [x for x in kinds if len(x) >= shortest]
    for n, a in enumerate(long):
        for b in long[n + 1 :]:
            if abs(len(a) - len(b)) <= most and find(a) != find(b) and edits(a, b) <= most:
                x, y = find(a), find(b)
                root[x if place[x] > place[y] else y] = x if place[x] < place[y] else y
    out, seen, texts = {}, set(), set()
    for i, text in rows:
        if text is None:
            out[i, text] = (0, 0, 0, None)
            continue
        kept, gone, near = [], 0, 0
        for line in text.split("\n"):
            if line.strip(" ") and find(line) in seen:
                gone += 1
                near += line not in texts
            else:
                kept.append(line)
            if line.strip(" "):
                seen.add(find(line))
                texts.add(line)
        out[i, text] = (len(text.split("\n")), gone, near, "\n".join(kept))
    return out


def corpus(rnd):
    alphabet = "abcdefgh é"
    line = lambda n: "".join(rnd.choice(alphabet) for _ in range(n)).strip()

    def change(s):
        s = list(s)
        for _ in range(rnd.randint(0, 3)):
            k = rnd.randrange(len(s))
            s[k : k + rnd.randint(0, 1)] = rnd.choice(["", "x", "zé"])
        return "".join(s)

    bases = [line(rnd.randint(41, 120)) for _ in range(12)]
    stamp = "2024-01-01 12:{:02d}:{:02d} GET /index.html HTTP/1.1 status 200 ok"  # one list for all
    rows = []
    for k in range(60):
        text = []
        for _ in range(rnd.randint(0, 6)):
            text.append(rnd.choice([lambda: change(rnd.choice(bases)), lambda: line(rnd.randint(1, 80)), lambda: "", lambda: "short line", lambda: stamp.format(rnd.randint(0, 59), rnd.randint(0, 59))])())
        rows.append((k, "\n".join(text)))
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, bases[0] + "\n" + bases[0]), (203, bases[0] + "\n" + bases[0]), (None, bases[1]), (204, rows[3][1])]
    return rows


@pytest.mark.parametrize("limit", [64, 2])
def test_lines_against_brute_force(documents, monkeypatch, limit):
    monkeypatch.setattr(L, "LIST", limit)  # 2: the refined and the pivot path
    monkeypatch.setattr(L, "REFINED", limit)
    rows = corpus(random.Random(3))
    got = L.dedup_lines(documents(rows, extra=("gone", "n_lines", "pos"))).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    assert sorted([(r.doc_id, r.n_lines, r.n_removed, r.n_near, r.kept_text) for r in got], key=key) == sorted([(r[0], *want[r]) for r in rows], key=key)


def test_verification_and_keys(spark):
    rnd = random.Random(4)
    pairs = []
    for _ in range(600):
        a = "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 25)))
        b = list(a)
        for _ in range(rnd.randint(0, 4)):
            k = rnd.randrange(len(b) + 1)
            b[k : k + rnd.randint(0, 1)] = rnd.choice(["", "a", "é"])
        pairs.append(tuple(sorted((a, "".join(b)), key=len)))
    df = spark.createDataFrame(pairs, "a string, b string")
    assert df.filter(L.within(F.col("a"), F.col("b"), 2) != (F.levenshtein("a", "b") <= 2)).count() == 0
    df = df.filter("length(a) >= 3 and levenshtein(a, b) <= 2")
    df = df.withColumn("id", F.monotonically_increasing_id()).cache()
    salted = lambda c: df.select("id", F.col(c).alias("line"), F.lit(0).cast("long").alias("salt"))
    index = L.posted(salted("a"), L.index_places(2), 2)
    probe = L.posted(salted("b"), L.index_places(2) + L.probe_places(2), 2)
    assert len(L.probe_places(2)) == 9 and df.count() > 100
    assert index.join(probe, ["id", "key"]).select("id").distinct().count() == df.count()      # a shared key for every pair
    at = probe.join(df, "id").where(F.substr("b", F.col("first"), F.col("n")).isNull() | (F.col("first") + F.col("n") - 1 > F.length("b")))
    assert at.count() == 0
    c, d = L.counts_of(F.col("a")), L.counts_of(F.col("b"))
    counted = df.select(c[0].alias("c0"), c[1].alias("c1"), d[0].alias("d0"), d[1].alias("d1"))
    assert counted.where(~L.alike(2)).count() == 0                                             # no pair within two edits is ruled out


def test_counts_tell_lines_apart(spark):
    rows = [("x" * 300, "x" * 300 + "é", True), ("the same words", "the same wards", True), ("abc " * 20, "abd " * 20, False), ("", "", True), ("\u00ff" * 400, "e" * 400, False), ("0" * 5, "4" * 5, False)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    c, d = L.counts_of(F.col("a")), L.counts_of(F.col("b"))
    got = df.select("want", c[0].alias("c0"), c[1].alias("c1"), d[0].alias("d0"), d[1].alias("d1")).withColumn("is", L.alike(2)).collect()
    assert all(r["is"] == r.want for r in got)


def test_lists_that_stay_long_are_compared_in_blocks(documents, monkeypatch):
    monkeypatch.setattr(L, "LIST", 2)
    monkeypatch.setattr(L, "REFINED", 4)
    monkeypatch.setattr(L, "LEVELS", 0)
    monkeypatch.setattr(L, "BLOCK", 3)
    rows = corpus(random.Random(5))
    got = L.dedup_lines(documents(rows)).collect()
    want = brute(rows)
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    assert sorted([(r.doc_id, r.n_lines, r.n_removed, r.n_near, r.kept_text) for r in got], key=key) == sorted([(r[0], *want[r]) for r in rows], key=key)


def test_no_lines(documents):
    assert L.dedup_lines(documents([])).collect() == []
    assert [tuple(r) for r in L.dedup_lines(documents([(1, None)])).collect()] == [(1, 0, 0, 0, None)]


QUESTIONS = [
    (1, "A train leaves Paris at 9:30 and travels 120 km to Lyon in 2 hours. How fast does it go on average?"),
    (2, "Yesterday Tom had 5 apples and Mary had 7 apples. How many apples do Tom and Mary have together in the basket?"),
    (3, "What is the capital of the country whose flag shows a red disc on a plain white ground?"),
    (4, None), (5, ""), (None, "nobody asks this question here or there or anywhere at all"),
]


@pytest.mark.parametrize("broadcast", [2_000_000, 0])
def test_templates(spark, documents, monkeypatch, broadcast):
    from monthlens.llm import decontaminate as D
    monkeypatch.setattr(D, "BROADCAST_WINDOWS", broadcast)
    bench = spark.createDataFrame(QUESTIONS, "item_id long, text string").withColumn("doc_id", F.lit(7))
    pad = "Some other words stand before it and some stand after it too. "
    rows = [
        (1, pad + QUESTIONS[0][1] + " " + pad),  # as it is
        (2, pad + "A train leaves Rome at 7:15 and travels 300 km to Milan in 4 hours. How fast does it go on average?"),  # other values
        (3, pad + "Yesterday Tom had 5 apples and Mary had 7 apples. How many apples do Ann and Mary have together in the basket?"),  # slots clash
        (4, "Yesterday Jim had 8 apples and Sue had 9 apples. How many apples do Jim and Sue have together in the basket?"),
        (5, pad * 40), (6, None), (7, ""), (8, "What is the capital of the country whose flag shows"),  # too little of it
        (9, QUESTIONS[2][1].upper()), (9, QUESTIONS[2][1].upper()), (None, QUESTIONS[2][1]), (10, "x " * 30000 + QUESTIONS[2][1]),
    ]
    got = leaks(documents(rows, extra=("hash", "item_id", "shift")), bench).collect()
    assert sorted([(r.doc_id is not None, r.doc_id or 0, r.item_id) for r in got]) == [(False, 0, 3), (True, 1, 1), (True, 2, 1), (True, 4, 2), (True, 9, 3), (True, 10, 3)]
    by = {r.doc_id: r for r in got}
    assert by[1].n_changed == 0 and by[2].n_changed >= 4 and by[1].coverage == 1.0
    kept = decontaminate(documents(rows, extra=("hash",)), bench)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "hash"]
    assert {5, 6, 7, 8, 3} <= {r.doc_id for r in kept.collect()} and not {1, 2, 4, 9, 10} & {r.doc_id for r in kept.collect()}


def test_templates_of_nothing(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert leaks(documents([]), none).collect() == []
    assert decontaminate(documents([(1, "a")]), none).count() == 1
