"""Offset-preserving BPE pieces: a sentence-piece model's encoding and decoding, for whole texts.

A text is first normalised by the longest prefixes that the model's compiled character map
knows, and each normalised byte keeps the place of its source.  Then the text is cut where no
piece can reach across, every distinct part is merged once per batch (all parts of a length
side by side, best pair first, leftmost of equals), and the lengths of the pieces project
them to byte spans of the original text.

The model file is read on the driver and sent to the tasks; it is never trained or changed.
"""

from __future__ import annotations

import heapq
import itertools
import re
import struct

import numpy as np

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Parts longer than this are merged with a queue instead of side by side.
LONG = 64
#: Parts remembered from batch to batch, at most.
REMEMBER = 400_000
NONE = np.int32(2**31 - 1)


def _fields(data: bytes):
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        x = shift = 0
        while True:
            b = data[at]
            at += 1
            x |= (b & 127) << shift
            shift += 7
            if b < 128:
                return x

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield key >> 3, data[at : at + n]
            at += n


class CharacterMap:
    """The compiled map: a double-array trie over UTF-8 keys, then the replacements."""

    def __init__(self, blob: bytes):
        self.units: list[int] = []
        self.heads: set[int] = set()
        if not blob:
            return
        (size,) = struct.unpack("<I", blob[:4])
        self.units = list(struct.unpack(f"<{size // 4}I", blob[4 : 4 + size]))
        self.values = blob[4 + size :]
        root = self._offset(self.units[0])
        self.heads = {b for b in range(1, 256) if (root ^ b) < len(self.units) and self._label(self.units[root ^ b]) == b}

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    @staticmethod
    def _label(unit: int) -> int:
        return unit & 0x800000FF

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that starts at ``at``."""
        units, found = self.units, None
        node = self._offset(units[0])
        for k in range(at, len(text)):
            b = text[k]
            node ^= b
            if b == 0 or node >= len(units) or self._label(units[node]) != b:
                break
            leaf = (units[node] >> 8) & 1
            node ^= self._offset(units[node])
            if leaf:
                start = units[node] & 0x7FFFFFFF
                found = k + 1 - at, self.values[start : self.values.index(b"\0", start)]
        return found


class Model:
    def __init__(self, blob: bytes):
        self.blob = blob
        pieces, scores, kinds, charsmap = [], [], [], b""
        self.dummy, self.trim, self.escape, self.bytes, self.suffix, model_type = True, True, True, False, False, 1
        for n, v in _fields(blob):
            if n == 1:
                f = dict(_fields(v))
                pieces.append(f.get(1, b"").decode())
                scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                kinds.append(f.get(3, NORMAL))
            elif n == 2:
                f = dict(_fields(v))
                model_type, self.bytes, self.suffix = f.get(3, 1), bool(f.get(35, 0)), bool(f.get(24, 0))
            elif n == 3:
                f = dict(_fields(v))
                charsmap, self.dummy, self.trim, self.escape = f.get(2, b""), bool(f.get(3, 1)), bool(f.get(4, 1)), bool(f.get(5, 1))
        if model_type != 2 or USER_DEFINED in kinds or UNUSED in kinds or self.suffix or self.trim or not self.escape:
            raise ValueError("only BPE models that keep white space and have no user-defined or unused pieces are supported")
        self.map = CharacterMap(charsmap)
        self.size = len(pieces)
        own = {p: i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == NORMAL}
        self.unknown = kinds.index(UNKNOWN)
        control = {p: i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == CONTROL}
        self.begin, self.end = control["<s>"], control["</s>"]
        self.byte_ids = [0] * 256
        for i, (p, k) in enumerate(zip(pieces, kinds)):
            if k == BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
        # what a piece says: bytes with white space as it was
        self.said = [p.replace(SPACE, " ").encode() if k == NORMAL else b"" for p, k in zip(pieces, kinds)]
        for b, i in enumerate(self.byte_ids):
            if kinds[i] == BYTE:
                self.said[i] = bytes([b])
        self.said[self.unknown] = " ⁇ ".encode()
        self.n_said = np.array([len(x) for x in self.said], np.int64)
        self.is_byte = np.array([k == BYTE for k in kinds])
        self.leads = [p.startswith(SPACE) for p in pieces]
        # symbols: ids of pieces, or size + code point
        self.of_char = np.arange(0x110000, dtype=np.int64) + self.size
        for p, i in own.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        # pieces by falling score; equal scores share a rank, so the leftmost goes first
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in own.values()}, reverse=True))}
        symbol = lambda p: own.get(p, self.size + ord(p) if len(p) == 1 else None)
        pairs = {}
        for p, i in own.items():
            for k in range(1, len(p)):
                a, b = symbol(p[:k]), symbol(p[k:])
                if a is not None and b is not None:
                    pairs[a, b] = order[scores[i]], i
        self.pairs = pairs
        self._hash(pairs)
        wide = [p for p in own if len(p) > 1]
        joined = "".join(wide)
        # no piece holds the space mark after another character: parts can be cut before marks
        cuts = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in wide)
        stop = "" if "\n" in joined else "\n"
        gap = f" {SPACE}"
        self.parts = re.compile(f"[{gap}]+[^{gap}{stop}]*|[^{gap}{stop}]+" + ("|\n" if stop else "")) if cuts else re.compile("(?s).+")
        self.known: dict[str, bytes] = {}

    def __reduce__(self):
        return Model, (self.blob,)

    def _hash(self, pairs: dict) -> None:
        """Open-addressing table of the pairs, probed for whole arrays."""
        bits = max(10, (4 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot = np.full(1 << bits, -1, np.int64)
        self.rank, self.made = np.full(1 << bits, NONE, np.int32), np.zeros(1 << bits, np.int32)
        a, b = np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)
        key = a << 32 | b
        for k, h, (r, i) in zip(key.tolist(), self._place(key).tolist(), pairs.values()):
            while self.slot[h] >= 0:
                h = (h + 1) & self.mask
            self.slot[h], self.rank[h], self.made[h] = k, r, i

    def _place(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (NONE: no piece) and the piece."""
        key = a << 32 | b
        at = self._place(key)
        open_ = np.flatnonzero((self.slot[at] != key) & (self.slot[at] >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            s = self.slot[at[open_]]
            open_ = open_[(s != key[open_]) & (s >= 0)]
        hit = self.slot[at] == key
        return np.where(hit, self.rank[at], NONE), self.made[at]

    # encoding

    def merge_equal(self, sym: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Merges rows of symbols, all of one length; yields (row numbers, their symbols)."""
        out, rows = [], np.arange(len(sym))
        if sym.shape[1] < 2:
            return [(rows, sym)]
        rank, made = self.look(sym[:, :-1].ravel(), sym[:, 1:].ravel())
        rank, made = rank.reshape(len(sym), -1), made.reshape(len(sym), -1)
        while len(rows) and sym.shape[1] > 1:
            j = rank.argmin(axis=1)
            r = np.arange(len(rows))
            live = rank[r, j] != NONE
            if not live.all():
                out.append((rows[~live], sym[~live]))
                rows, sym, rank, made, j = rows[live], sym[live], rank[live], made[live], j[live]
                if not len(rows):
                    break
                r = np.arange(len(rows))
            width = sym.shape[1]
            sym[r, j] = made[r, j]
            keep = np.ones(sym.shape, bool)
            keep[r, j + 1] = False
            sym = sym[keep].reshape(len(rows), width - 1)
            keep = np.ones(rank.shape, bool)
            keep[r, j] = False
            rank, made = rank[keep].reshape(len(rows), width - 2), made[keep].reshape(len(rows), width - 2)
            for at in (j - 1, j):  # the pairs of the new symbol
                ok = np.flatnonzero((at >= 0) & (at < width - 2))
                if len(ok):
                    c = at[ok]
                    rank[ok, c], made[ok, c] = self.look(sym[ok, c], sym[ok, c + 1])
        if len(rows):
            out.append((rows, sym))
        return out

    def merge_long(self, sym: list[int]) -> list[int]:
        """Merges one long row with a queue."""
        n, pairs = len(sym), self.pairs
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(*pairs[a, b], i, a, b) for i, (a, b) in enumerate(zip(sym, sym[1:])) if (a, b) in pairs]
        queue = [(r, i, a, b, made) for r, made, i, a, b in queue]
        heapq.heapify(queue)
        while queue:
            _, i, a, b, made = heapq.heappop(queue)
            j = right[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue
            sym[i], sym[j] = made, -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (p := pairs.get((sym[x], sym[y]))):
                    heapq.heappush(queue, (p[0], x, sym[x], sym[y], p[1]))
        return [s for s in sym if s >= 0]

    def spell(self, sym: list[int]) -> bytes:
        """Ids of the symbols; what is no piece becomes its bytes, or unknown."""
        ids = []
        for s in sym:
            if s < self.size:
                ids.append(s)
            else:
                ids += [self.byte_ids[b] for b in chr(s - self.size).encode()] if self.bytes else [self.unknown]
        return np.array(ids, "<u4").tobytes()

    def learn(self, parts: list[str]) -> None:
        """Merges parts that are not known yet."""
        known = self.known
        by_size: dict[int, list[str]] = {}
        for p in parts:
            by_size.setdefault(len(p), []).append(p)
        for n, group in by_size.items():
            if n > LONG:
                for p in group:
                    chars = np.frombuffer(p.replace(" ", SPACE).encode("utf-32-le"), np.uint32)
                    known[p] = self.spell(self.merge_long(self.of_char[chars].tolist()))
                continue
            for lo in range(0, len(group), 65536):
                some = group[lo : lo + 65536]
                chars = np.frombuffer("".join(some).replace(" ", SPACE).encode("utf-32-le"), np.uint32)
                for rows, sym in self.merge_equal(self.of_char[chars].reshape(len(some), n)):
                    plain = (sym < self.size).all(axis=1)
                    w, ids = 4 * sym.shape[1], sym[plain].astype("<u4").tobytes()
                    known.update(zip([some[r] for r in rows[plain].tolist()], [ids[k : k + w] for k in range(0, len(ids), w)]))
                    known.update((some[r], self.spell(x)) for r, x in zip(rows[~plain].tolist(), sym[~plain].tolist()))

    def normalise(self, text: str) -> tuple[str, np.ndarray | None]:
        """The normalised text (spaces as they are) and, where it differs, the source byte of
        each of its bytes and of its end."""
        if not self.map.heads:
            return text, None
        raw = text.encode()
        if not any(b in self.map.heads for b in set(raw)):
            return text, None
        out, source, at = bytearray(), [], 0
        while at < len(raw):
            b = raw[at]
            found = self.map.longest(raw, at) if b in self.map.heads else None
            if found is None:
                n = 1 if b < 128 else 2 if b < 224 else 3 if b < 240 else 4
                new = raw[at : at + n]
            else:
                n, new = found
            out += new
            source += [at] * len(new)
            at += n
        return out.decode(), np.array([*source, len(raw)], np.int64)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids with begin and end id, first byte, past byte) of each text; begin and end id are empty spans."""
        for lo in range(0, len(texts), 4096):
            normal = [self.normalise(t) for t in texts[lo : lo + 4096]]
            cut = [self.parts.findall((" " if self.dummy else "") + t) if t else [] for t, _ in normal]
            every = set().union(*cut)
            if len(self.known) + len(every) > REMEMBER:
                self.known = {}
            self.learn([p for p in every if p not in self.known])
            yield from (self._placed(c, t, s) for c, (t, s) in zip(cut, normal))

    def _placed(self, parts: list[str], text: str, source):
        ids = np.frombuffer(b"".join(map(self.known.__getitem__, parts)), "<u4")
        if SPACE in text or not self.bytes:
            past = self._walked(ids, text)
        else:
            past = np.cumsum(self.n_said[ids])
            if self.dummy:
                past -= 1  # the mark put before the text has no source
        first = np.concatenate([[0], past[:-1]])[: len(past)]
        if source is not None:
            first, past = source[first], source[past]
        n = int(past[-1]) if len(past) else 0
        ids = np.concatenate([np.array([self.begin], "<u4"), ids, np.array([self.end], "<u4")])
        return ids, np.concatenate([[0], first, [n]]).astype(np.int64), np.concatenate([[0], past, [n]]).astype(np.int64)

    def _walked(self, ids: np.ndarray, text: str) -> np.ndarray:
        """Where each piece ends in the text, character by character: for texts that hold the
        mark itself, which says a space, and for unknown characters."""
        size = [len(c.encode()) for c in text]
        at = -1 if self.dummy else 0  # characters read
        byte = done = 0
        past = []
        for i in ids.tolist():
            if self.is_byte[i]:
                byte += 1
                done += 1
                if done == size[at]:
                    at, done = at + 1, 0
            else:
                n = 1 if i == self.unknown else len(self.said[i].decode())
                byte += sum(size[max(at, 0) : at + n])
                at += n
            past.append(byte)
        return np.array(past, np.int64)

    # decoding

    def decode(self, ids: np.ndarray) -> str:
        """The text that ids say: control ids are silent, the mark before the first piece goes,
        bytes that are no UTF-8 become U+FFFD each."""
        ids = ids.tolist()
        said = b"".join(map(self.said.__getitem__, ids))
        first = next((i for i in ids if i != self.begin and i != self.end), None)
        if self.dummy and first is not None and self.leads[first]:
            said = said[1:]
        try:
            return said.decode()
        except UnicodeDecodeError:
            return "".join(self._repair(said))

    @staticmethod
    def _repair(said: bytes):
        at = 0
        while at < len(said):
            for n in (1, 2, 3, 4):
                try:
                    c = said[at : at + n].decode()
                except UnicodeDecodeError:
                    continue
                if len(c) == 1:
                    yield c
                    at += n
                    break
            else:
                yield "�"
                at += 1
