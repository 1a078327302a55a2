"""Packing: pieces against the tokenizers library, sequences against their rules and brute force."""

import itertools
import json
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from monthlens.llm import packing
from monthlens.llm.packing import WordIds, best_fit, pack, places, plan, sequences, token_pieces

PATH = public_tokenizers.path("word_bpe_49k.json")
SPEC = open(PATH, encoding="utf-8").read()
LIB = Tokenizer.from_file(PATH)


def lib_ids(text):
    return LIB.encode(text or "", add_special_tokens=False).ids


def texts():
    rnd = random.Random(5)
    letters = list("abcXYZ019'.,-_<|>ÄßéΣσς字́İ   \u0085\x1c\x1f\n\t\r\x0b\x0c​") + ["<|endoftext|>", "'s", "'LL", "\U0001f600", "é", "가"]
    return ["".join(rnd.choices(letters, k=rnd.randint(0, 60))) for _ in range(3000)]


def test_words_encode_as_whole_texts():
    words = WordIds(SPEC)
    for text, got in zip(texts(), words.encode([t.encode() for t in texts()]), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == lib_ids(text), repr(text)


def test_long_texts_in_blocks(monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 1000)
    long = " ".join(texts()[:300])
    some = ["a", long, "", "x" * 5000, "b c " * 400, "tail"]
    got = list(WordIds(SPEC).encode([t.encode() for t in some]))
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [lib_ids(t) for t in some]


def test_forgets_words_that_do_not_return(monkeypatch):
    monkeypatch.setattr(packing, "WORDS", 10)
    words = WordIds(SPEC)
    for k in range(40):
        text = f"w{k} x{k} y{k} z{k} the"
        (got,) = words.encode([text.encode()])
        assert len(words) <= 10 and len(words.before) <= 10 and np.frombuffer(got, "<u4").tolist() == lib_ids(text)
    assert b"the" in words


def test_plain_words_character_by_character():
    words = WordIds(SPEC)
    rnd = random.Random(4)
    plain = [chr(c) for c in [*range(0x21, 0x7F), *range(0xC0, 0x100)] if c not in (0xD7, 0xF7)]
    some = ["a" + c for c in plain] + [c + "b" for c in plain] + ["".join(rnd.choices(plain, k=rnd.randint(1, 12))) for _ in range(20000)]
    some += ["it's", "IT'S", "we'LL've", "''s't", "<|endoftext|>", "a<|endoftext|>b", "<|STARTOFTEXT|>", "<|startoftext|", "12a3"]
    assert words.parts is not None and all(packing.PLAIN.fullmatch(w) for w in some)
    for w, e in zip(some, LIB.encode_batch(some, add_special_tokens=False), strict=True):
        assert words.ids(w) == e.ids, w


def test_other_tokenizers_are_asked_themselves():
    other = json.loads(SPEC)
    other["normalizer"] = None
    words = WordIds(json.dumps(other))
    lib = Tokenizer.from_str(json.dumps(other))
    assert words.parts is None and [words.ids(w) for w in ("Abc", "it's")] == [lib.encode(w, add_special_tokens=False).ids for w in ("Abc", "it's")]


def used_up(done, counts, capacity):
    used = {}
    for pattern, n in done:
        assert n > 0 and sum(k * t for k, t in pattern.items()) <= capacity
        for k, t in pattern.items():
            used[k] = used.get(k, 0) + n * t
    assert used == counts
    return sum(n for _, n in done)


def fewest(lengths, capacity):
    """By trying: the fewest sequences for a few pieces."""
    lengths = sorted(lengths, reverse=True)
    for k in range(1, len(lengths) + 1):
        def fits(i, gaps):
            if i == len(lengths):
                return True
            for g in set(gaps):
                if g >= lengths[i]:
                    rest = list(gaps)
                    rest.remove(g)
                    if fits(i + 1, (*rest, g - lengths[i])):
                        return True
            return False
        if fits(0, (capacity,) * k):
            return k
    return 0


def test_plan_against_trying():
    rnd, extra = random.Random(2), 0
    for _ in range(150):
        lengths = [rnd.randint(1, 20) for _ in range(rnd.randint(1, 9))]
        counts = {k: lengths.count(k) for k in set(lengths)}
        n = used_up(plan(counts, 20), counts, 20)
        best = fewest(lengths, 20)
        assert best <= n <= best + 1
        extra += n - best
    assert extra <= 8


@pytest.mark.parametrize("seed", range(4))
def test_plan_near_the_bound(seed):
    rnd = random.Random(seed)
    draw = [lambda: min(2048, max(1, int(rnd.lognormvariate(5.5, 1.2)))), lambda: rnd.randint(1, 2048), lambda: rnd.randint(300, 400), lambda: rnd.choice([1, 683, 1365])][seed]
    lengths = [draw() for _ in range(20000)]
    counts = {k: lengths.count(k) for k in set(lengths)}
    n = used_up(plan(counts, 2048), counts, 2048)
    assert n <= used_up(best_fit(list(counts.items()), 2048), counts, 2048)
    assert n <= 1.02 * max(math.ceil(sum(lengths) / 2048), sum(k > 1024 for k in lengths))


def test_exact_ends_come_first():
    # a pair, a triple and a single end, which longest-first alone would break
    counts = {10: 1, 6: 1, 4: 2, 7: 1, 2: 1, 1: 1}
    assert used_up(plan(counts, 10), counts, 10) == 4 and sum(k * n for k, n in counts.items()) == 34
    many = {1000: 10**9, 1048: 10**9, 3: 5}  # counts do not lengthen the plan
    assert used_up(plan(many, 2048), many, 2048) == 10**9 + 1 and len(plan(many, 2048)) < 5
    with pytest.raises(ValueError):
        plan({2049: 1}, 2048)


def test_places_cover_each_number_once():
    counts = {5: 7, 3: 9, 2: 11, 1: 4}
    at = places(plan(counts, 10))
    for k, n in counts.items():
        mine = at[at[:, 0] == k]
        assert mine[0, 1] == 0 and (np.diff(mine[:, 1]) > 0).all() and mine[-1, 1] < n


def check_sequences(rows, capacity):
    rows = sorted(rows, key=lambda r: (r.sequence_id, r.offset))
    for _, group in itertools.groupby(rows, key=lambda r: r.sequence_id):
        at = 0
        for r in group:
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len({r.sequence_id for r in rows})


def test_documents(spark, documents):
    rnd = random.Random(1)
    rows = [(k, " ".join(rnd.choices("the cat's Größe 字 12,5 unlikelihood".split(), k=rnd.choice([0, 1, 3, 50, 300])))) for k in range(400)]
    rows += [(1000 + k, "one and the same text") for k in range(300)] + [(None, "no id")] * 60 + [(5000, None), (5001, "word " * 9000), (5002, "twice"), (5002, "twice")]
    docs = documents(rows, extra=("OFFSET", "piece", "_text"))
    pieces = token_pieces(docs, PATH)
    packed = pack(pieces)
    got = packed.collect()
    assert {"lang", "source", "n_chars", "_text"} <= set(packed.columns) and "text" not in packed.columns and len(packed.columns) == len({c.lower() for c in packed.columns})
    want = []
    for doc_id, text in rows:
        ids = lib_ids(text) + [0]
        for k, a in enumerate(range(0, len(ids), 2048)):
            part = ids[a:a + 2048]
            want.append((doc_id, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), part))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, r.ids) for r in got), key=repr) == sorted(want, key=repr)
    n = check_sequences(got, 2048)
    total = sum(w[3] for w in want)
    full = sum(w[3] == 2048 for w in want)
    pairs = math.ceil(sum(682 < w[3] < 2048 for w in want) / 2)  # no three of these fit one sequence
    assert max(math.ceil(total / 2048), full + pairs) <= n <= max(math.ceil(total / 2048), full + pairs) + 1
    made = {r.sequence_id: r for r in sequences(packed).collect()}
    assert len(made) == n and sum(len(r.ids) for r in made.values()) == total
    for r in got:
        assert made[r.sequence_id].ids[r.offset:r.offset + r.length] == r.ids


def test_one_length_in_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET", 7)
    rows = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 4 + 1).cast("long").alias("length"))
    got = pack(rows, capacity=10).collect()
    total = sum(r.length for r in got)
    assert len({r.id for r in got}) == len(got) == 1000 and check_sequences(got, 10) == math.ceil(total / 10)


def test_nothing(documents):
    assert pack(token_pieces(documents([]), PATH)).count() == 0
    (row,) = pack(token_pieces(documents([(1, None)]), PATH, ids=False)).collect()
    assert (row.length, row.ids_crc32, row.offset) == (1, zlib.crc32(b"\0\0\0\0"), 0)
