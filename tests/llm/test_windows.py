"""op2 and op4 against brute force: repeated windows of bytes and of words."""

import hashlib
import random
import re

import numpy as np
import pytest

from monthlens.llm import windows as W
from monthlens.llm.suffix import dedup_bytes, prefixes_reach, suffix_array
from monthlens.llm.superkmer import dedup_substrings

SPLIT = re.compile("[^\x20\x09-\x0D]+")


def corpus(seed=1):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(400)] + ["naïve", "日本", "a", "the"]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage, line = text(70), text(25)
    rows = [(k, text(rnd.randint(1, 120))) for k in range(60)]
    for k in range(60, 90):  # a passage in many documents, at different places
        rows.append((k, text(rnd.randint(0, 30)) + "\n" + passage + "\t " + text(rnd.randint(0, 30))))
    rows += [(k, line) for k in range(90, 110)]  # many copies
    rows += [(110, "x " * 60), (111, "ab " * 300), (112, "z" * 900), (113, ""), (114, None), (115, "  \n\t "), (116, line + " " + line)]
    rows += [(117, text(3000)), (None, passage), (118, rows[5][1]), (118, rows[5][1]), (-3, rows[7][1]), (119, "é" * 150 + passage)]
    return rows


def later_words(rows, window):
    """Words removed from each distinct (doc_id, text), in order of id."""
    order = sorted({r[:2] for r in rows}, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0))
    seen, out = set(), {}
    for i, text in order:
        words = SPLIT.findall(text or "")
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            if key in seen:
                gone[k : k + window] = [True] * window
            seen.add(key)
        out[i, text] = (len(words), sum(gone), hashlib.sha256(" ".join(w for w, g in zip(words, gone) if not g).encode()).hexdigest())
    return out


def repeated_bytes(rows, window):
    data = [(r[1] or "").encode() for r in rows]
    count = {}
    for b in data:
        for k in range(len(b) - window + 1):
            count[b[k : k + window]] = count.get(b[k : k + window], 0) + 1
    out = []
    for r, b in zip(rows, data):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - window + 1):
            if count[b[k : k + window]] > 1:
                gone[k : k + window] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((r[0], len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def key(row):
    return tuple((x is not None, x if x is not None else 0) for x in row)


@pytest.mark.parametrize("shard", [4096, 4])
def test_words(documents, monkeypatch, shard):
    if shard < 10:
        monkeypatch.setattr(W, "hot_seeds", lambda *a: np.array([], np.uint64))
    # a small shard makes one seed span several: the exchange of fingerprints must find the same
    rows = corpus()
    want = later_words(rows, 20)
    got = dedup_substrings(documents(rows, extra=("n_words", "removed", "span")), shard=shard).collect()
    assert len(got) == len(rows)
    have = sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got], key=key)
    assert have == sorted([(r[0], *want[r[:2]]) for r in rows], key=key)
    for r in got:
        assert sum(x.past - x.first for x in r.removed) == r.n_removed


@pytest.mark.parametrize("shard", [4096, 4])
def test_bytes(documents, monkeypatch, shard):
    rows = corpus(2)
    if shard < 10:
        monkeypatch.setattr(W, "hot_seeds", lambda *a: np.array([], np.uint64))
    got = dedup_bytes(documents(rows, extra=("n_bytes", "kind")), shard=shard).collect()
    have = sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got], key=key)
    assert have == sorted(repeated_bytes(rows, 200), key=key)


def test_empty_tables(documents):
    assert dedup_substrings(documents([])).collect() == []
    assert dedup_bytes(documents([])).collect() == []


def test_suffix_array_against_sorting():
    rng = np.random.default_rng(0)
    for n, letters in ((300, 2), (500, 4), (64, 1), (1, 1)):
        data = rng.integers(97, 97 + letters, n).astype(np.uint8)
        data[n // 2 : n // 2 + n // 4] = data[: n // 4]
        text = data.tobytes()
        sa, parted, h = suffix_array(data, 40)
        cut = [text[p : p + 40] for p in sa.tolist()]
        assert cut == sorted(cut) and sorted(sa.tolist()) == list(range(n))
        reach = prefixes_reach(data, sa, parted, h, 40)
        a, b = sa[1:], sa[:-1]
        want = [text[x : x + 40] == text[y : y + 40] and len(text[x : x + 40]) == 40 for x, y in zip(a.tolist(), b.tolist())]
        assert reach[1:].tolist() == want


def test_cut_finds_the_runs():
    rng = np.random.default_rng(3)
    for _ in range(50):
        grams = rng.integers(0, 30, rng.integers(8, 80)).astype(np.uint64)
        seed, first, n, inside = W.cut(grams, 8)
        low = [min(grams[k : k + 8].tolist()) for k in range(len(grams) - 7)]
        assert np.repeat(seed, n).tolist() == low
        for s, f, m, flag in zip(seed.tolist(), first.tolist(), n.tolist(), inside.tolist()):
            assert flag or grams[f : f + m + 7].tolist().count(s) == 1


def test_many_null_ids_and_rows_given_often(documents):
    """A third of the rows without an id, others given a hundred times: no group of an id."""
    rnd = random.Random(21)
    shared = " ".join(f"s{rnd.randrange(10**6)}" for _ in range(30))
    rows = [(None, f"{shared} n{k} " + " ".join(f"t{rnd.randrange(10**6)}" for _ in range(15))) for k in range(60)]
    rows += [(k, f"u{k} " * 3 + shared) for k in range(60)] + [(500, "v " + shared)] * 100
    got = dedup_substrings(documents(rows)).collect()
    assert len(got) == len(rows) and sum(r.n_removed == 0 and r.n_words > 0 for r in got if r.doc_id is not None) <= 1
    assert all(r.n_removed >= 30 for r in got if r.doc_id not in (None, 0))
    out = dedup_bytes(documents(rows)).collect()
    assert len(out) == len(rows) and all(r.n_removed >= 150 for r in out)
