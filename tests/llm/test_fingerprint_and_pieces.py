"""op7 by its guarantees and op10 against the sentencepiece library."""

import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from monthlens.llm import tokens
from monthlens.llm.fingerprint import LEVELS, fingerprints, level, likeness, parse, text_of
from monthlens.llm.pieces import CharacterMap, Model

PATH = public_tokenizers.path("piece_bpe_32k.model")


def prose(rnd, n):
    return " ".join("".join(rnd.choice("aeiounrstlé") for _ in range(rnd.randint(1, 9))) for _ in range(n))


def test_edited_texts_and_neighbours(documents):
    rnd = random.Random(1)
    rows = [(k, prose(rnd, rnd.randint(1, 200))) for k in range(0, 120, 2)]
    rows += [(3, "aaaa" * 500), (5, "aaaa" * 500), (7, "abab" * 300), (9, ""), (11, None), (13, "x"), (15, "日本語" * 50), (17, prose(rnd, 9000)), (17, "twice"), (17, "twice"), (None, "first of all"), (-5, "😀é")]
    got = fingerprints(documents(rows, extra=("bucket", "copy", "fingerprint"))).collect()
    order = sorted([(i is not None, i or 0, t or "", i) for i, t in rows])
    want = []
    for k, (_, _, t, i) in enumerate(order):
        nxt = order[(k + 1) % len(order)][2]
        h = len(t) // 2
        e = t[: len(t) - h] + nxt[:h]
        a, b, c = parse([t])[0], parse([e])[0], parse([nxt])[0]
        want.append((i is not None, i or 0, len(t), hashlib.sha256(e.encode()).hexdigest(), text_of(a), text_of(b), likeness(a, b), likeness(a, c)))
    have = [(r.doc_id is not None, r.doc_id or 0, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in got]
    assert sorted(have) == sorted(want)
    long = [r for r in got if r.n_chars > 600 and r.doc_id is not None and r.doc_id % 2 == 0]
    assert np.mean([r.near_edited for r in long]) > 0.35 and np.mean([r.near_next for r in long]) < 0.1


def test_one_row_and_none(documents):
    assert fingerprints(documents([])).collect() == []
    (r,) = fingerprints(documents([(4, "abcdef")])).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and r.near_next == 1.0


def test_equal_substrings_share_phrases():
    rnd = random.Random(2)
    core = prose(rnd, 400)
    names = []
    for pad in ("", prose(rnd, 3), prose(rnd, 50) + " ", "zz" * 33):
        x = np.frombuffer((pad + core + prose(rnd, 20)).encode("utf-32-le"), np.uint32)
        head = np.zeros(len(x), bool)
        head[0] = True
        sets = []
        for k in range(LEVELS):
            n = len(x)
            x, head = level(x, head, k)
            assert len(x) <= 0.6 * n + 2 and head[0] and not head[1:].any()
            sets.append(set(x.tolist()))
        names.append(sets)
    for other in names[1:]:
        for k in range(LEVELS):
            assert len(names[0][k] & other[k]) / len(names[0][k]) > 0.8


def texts():
    rnd = random.Random(5)
    alphabet = "ab e\n\t  ▁é漢😀x<s>0x41</s>​中ﬁ"
    out = ["", " ", "  ", "\n", "a\x00b", "<s>", "<0x41>", "▁", "a▁b", "hello  world ", "x" * 3000, "the" * 900, "日本語テスト" * 200, "⁇", "é", " \n ▁▁ "]
    out += ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 200))) for _ in range(300)]
    return out + [prose(rnd, 300), prose(rnd, 20000)]


def test_encoding_is_the_library_s():
    model, lib = Model(open(PATH, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=PATH)
    for text, (ids, first, past) in zip(texts(), model.encode(texts())):
        want = lib.encode(text, add_bos=True, add_eos=True)
        assert ids.tolist() == want and model.decode(ids) == lib.decode(want)
        raw = text.encode()
        assert b"".join(raw[a:b] for a, b in zip(first.tolist(), past.tolist())) == raw
        assert len(first) == len(ids) and (first[1:] >= past[:-1]).all()


def test_decoding_of_any_ids():
    model, lib = Model(open(PATH, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=PATH)
    rnd = random.Random(6)
    for _ in range(300):
        ids = [rnd.choice([rnd.randrange(0, 259), rnd.randrange(0, 32000)]) for _ in range(rnd.randint(0, 15))]
        assert model.decode(np.array(ids, np.int64)) == lib.decode(ids)


def trie(keys):
    """A double-array character map of {bytes: bytes}, in the compiled format."""
    values, where = b"", {}
    for k, v in keys.items():
        where[k] = len(values)
        values += v + b"\0"
    units = {0: 0}
    free = [1]

    def build(node, prefix):
        labels = sorted({k[len(prefix)] for k in keys if k.startswith(prefix) and len(k) > len(prefix)})
        leaf = prefix in keys
        offset = free[0] * 256
        free[0] += 1
        units[node] = units.get(node, 0) | ((offset ^ node) >> 0 if False else 0) | ((offset ^ node) << 10 if (offset ^ node) < 1 << 21 else 0) | (1 << 8 if leaf else 0)
        base = node ^ (offset ^ node)
        if leaf:
            units[base] = where[prefix] | 1 << 31
        for b in labels:
            units[base ^ b] = b
        for b in labels:
            build(base ^ b, prefix + bytes([b]))

    build(0, b"")
    size = max(units) + 1
    blob = struct.pack(f"<{size}I", *[units.get(i, 0xFF) for i in range(size)])
    return struct.pack("<I", len(blob)) + blob + values


def test_character_map_finds_longest_prefixes_and_keeps_places():
    keys = {"ﬁ".encode(): b"fi", b"A": b"a", b"AB": b"xyz", "é".encode(): b"e", b"\t": b" "}
    model = Model(open(PATH, "rb").read())
    model.map = CharacterMap(trie(keys))
    assert model.map.longest(b"ABC", 0) == (2, b"xyz") and model.map.longest(b"AC", 0) == (1, b"a") and model.map.longest(b"C", 0) is None
    text, source = model.normalise("ABcé\tﬁ日")
    assert text == "xyzce fi日"
    assert source.tolist() == [0, 0, 0, 2, 3, 5, 6, 6, 9, 9, 9, 12]
    for raw in ("ABcé\tﬁ日", "plain", "ABAB A", "éé"):
        ((ids, first, past),) = model.encode([raw])
        lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
        assert ids.tolist() == lib.encode(model.normalise(raw)[0], add_bos=True, add_eos=True)
        assert past[-2] == len(raw.encode()) and (first <= past).all()


def test_columns(spark, documents):
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = [(k, t) for k, t in enumerate(texts()[:60])] + [(None, None), (1, "again"), (1, "again")]
    out = tokens.encoded_with_digests(documents(rows, extra=("ids", "n_tokens", "first")), PATH)
    assert len(set(out.columns)) == len(out.columns)
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        want = lib.encode(r.text or "", add_bos=True, add_eos=True)
        assert r.ids == want and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(want).encode()).hexdigest()
        assert r.n_covered == len((r.text or "").encode())
    back = tokens.decoded(tokens.encode(documents(rows), PATH), PATH)
    assert all(r.decoded == lib.decode(lib.encode(r.text or "", add_bos=True, add_eos=True)) for r in back.collect())
    assert tokens.summary(documents([]), PATH).collect() == []
