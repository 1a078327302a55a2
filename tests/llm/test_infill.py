"""Fill-in-middle against cuts made directly, ranks against counting, and the way back."""

import hashlib
import random

import pytest
import regex
from pyspark.sql import functions as F

from monthlens.llm.infill import MARKERS, SkipList, draws, fill_in_middle, restored

ALPHABET = "aé字\U0001f600 \n<PSM>"


def expected(doc_id, text):
    """By the contract of the query, with slices."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(text)
    if not text or any(m in text for m in MARKERS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, "<S>" + text[b:] + "<P>" + text[:a] + "<M>" + text[a:b]
    return n, "psm", a, b - a, "<P>" + text[:a] + "<S>" + text[b:] + "<M>" + text[a:b]


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 128, 5000, 70000])
def test_every_rank_of_code_points(n):
    text = "".join(random.Random(n).choices(ALPHABET, k=n))
    units = SkipList(text)
    ranks = range(n + 1) if n < 6000 else random.Random(1).sample(range(n + 1), 2000)
    assert units.n == n and all(units.offset(r) == r for r in ranks)
    assert n < 5000 or len(units.lanes) > 2


@pytest.mark.parametrize("n", [0, 1, 64, 65, 640, 3001])
def test_every_rank_of_words(n):
    rnd = random.Random(n)
    text = "".join("".join(rnd.choices("aé字", k=rnd.randint(1, 9))) + rnd.choice([" ", "\n  "]) for _ in range(n))
    unit = regex.compile(r"\S+")
    ends = [m.end() for m in unit.finditer(text)]
    want = [0, *ends[:-1], len(text)] if ends else [0]
    units = SkipList(text, unit)
    assert units.n == n and [units.offset(r) for r in range(n + 1)] == want


def test_a_text_without_units_is_one():
    units = SkipList("   ", regex.compile(r"\w+"))
    assert units.n == 1 and [units.offset(0), units.offset(1)] == [0, 3]


def test_lanes_hold_the_same_widths():
    units = SkipList("ab cd " * 4000, regex.compile(r"\S+"))
    for (u, p), (v, q), up in zip(units.lanes, units.lanes[1:], units.down):
        assert u.sum() == v.sum() and p.sum() == q.sum() and len(v) == len(up) < len(u)


def test_against_slices(spark, documents):
    rnd = random.Random(3)
    rows = [(k, "".join(rnd.choices(ALPHABET, k=rnd.choice([0, 1, 2, 3, 40, 700])))) for k in range(300)]
    rows += [(1000 + k, "plain words of a text " * 20) for k in range(200)]
    rows += [(2000, None), (None, "no id at all"), (2001, "twice"), (2001, "twice"), (2002, "x" * 2_000_000), (-5, "negative"), (2003, "a<P>b")]
    docs = documents(rows, extra=("FORM", "output"))
    got = fill_in_middle(docs).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    assert {"lang", "source", "n_chars"} <= set(got[0].asDict()) and len([c for c in got[0].asDict() if c.lower() == "form"]) == 1
    flat = lambda rows: sorted(rows, key=repr)
    assert flat((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in got) == \
        flat((i, *expected(i, t), t or "") for i, t in rows)
    assert {"psm", "spm", "plain"} == {r.form for r in got}


def test_words_and_other_markers(documents):
    rows = [(k, f"one two  three {k} four") for k in range(50)]
    marks = ("[pre]", "[suf]", "[mid]")
    got = fill_in_middle(documents(rows), unit=r"\S+", markers=marks, plain_percent=0, spm_percent=50, seed=9)
    got = got.withColumn("back", restored(F.col("output"), F.col("form"), marks)).collect()
    for r in got:
        a, b = sorted(x % 6 for x in draws(9, r.doc_id)[:2])
        ends = [0, *[m.end() for m in regex.finditer(r"\S+", r.text)]]
        assert r.n == 5 and r.back == r.text and (r.prefix_chars, r.middle_chars) == (ends[a], ends[b] - ends[a])
    assert {r.form for r in got} == {"psm", "spm"}


def test_markers_that_could_not_be_read_back(documents):
    for marks in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("ab", "bc", "d"), ("<P>", "<P>x", "<M>")):
        with pytest.raises(ValueError):
            fill_in_middle(documents([(1, "x")]), markers=marks)


def test_empty_table(documents):
    assert fill_in_middle(documents([])).count() == 0
