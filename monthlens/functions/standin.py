"""Deterministic stand-in for the external keyword / embedding models.

It lets the inference operators run end to end without a network and gives
outputs that plain SQL can restate:

* keywords of an item = its distinct non-stop tokens ranked by length
  (longest first, ties alphabetical); take three starting at a shift;
* shift: +1 for the ``bear`` variant; +1 when ``run > 0`` and
  ``(number of ranked tokens + 7 * run) mod 10 < round(10 * temperature)``
  (temperature-dependent run-to-run variation); ``constrained`` drops tokens
  containing an ASCII digit; no token left -> ``none``;
* calls for variant ``bull`` whose ``batch_id mod 5 = 4`` fail (no reply);
* the first attempt of a batch with ``batch_id mod 4 = 1`` loses its last line
  (wrong count), the retry is complete.
"""

from __future__ import annotations

import re

import pandas as pd
import regex

from monthlens.functions.text import ENGLISH_STOP_WORDS, TOKEN_PATTERN

_TOKEN = regex.compile(TOKEN_PATTERN)
_ASCII_TOKEN = re.compile(r"\w{2,}", re.ASCII)   # the same in ASCII text
_DIGIT = regex.compile(r"[0-9]")
_STOP = frozenset(ENGLISH_STOP_WORDS)


def distinct_terms(text: str) -> set[str]:
    return set((_ASCII_TOKEN if text.isascii() else _TOKEN).findall(text.lower())) - _STOP


def ranked_terms(text: str) -> list[str]:
    return sorted(distinct_terms(text), key=lambda t: (-len(t), t))


def keywords(text: str, variant: str = "base", temperature: float = 0.0, run: int = 0) -> str:
    toks = ranked_terms(text)
    if variant == "constrained":
        toks = [t for t in toks if not _DIGIT.search(t)]
    shift = 1 if variant == "bear" else 0
    if run > 0 and (len(toks) + 7 * run) % 10 < round(10 * temperature):
        shift += 1
    pick = toks[shift:shift + 3]
    return ", ".join(pick) if pick else "none"


def keyword_model(batch: pd.DataFrame) -> pd.Series:
    out = []
    for r in batch.itertuples(index=False):
        if r.variant == "bull" and r.batch_id % 5 == 4:
            out.append(None)
            continue
        body = r.prompt.split("Headlines:\n", 1)[1].rsplit("\n\nOutput:", 1)[0]
        items = [ln.split(". ", 1)[1] if ". " in ln else "" for ln in body.split("\n")]
        kws = [keywords(h, r.variant, float(r.temperature), int(r.run)) for h in items]
        reply = "\n".join(f"{i}. {k}" for i, k in enumerate(kws, 1))
        if int(r.attempt) == 0 and r.batch_id % 4 == 1 and len(kws) > 1:
            reply = reply.rsplit("\n", 1)[0]
        out.append(reply)
    return pd.Series(out, dtype=object)


def hashed_embedding_model(dims: int = 64):
    """Bag-of-words hashing vector per item (unit L2 norm), deterministic."""
    import hashlib

    import numpy as np

    places: dict[str, int] = {}    # of terms met before: place, or dims + place where the sign is minus

    def place(t: str) -> int:
        h = int.from_bytes(hashlib.md5(t.encode()).digest()[:4], "little")
        if len(places) >= 1 << 18:
            places.clear()
        places[t] = at = h % dims + (0 if (h >> 31) & 1 else dims)
        return at

    def model(batch: pd.DataFrame) -> pd.Series:
        vecs = []
        for item in batch["item"]:
            at = [places[t] if t in places else place(t) for t in distinct_terms(item)]
            n = np.bincount(np.array(at, dtype=int), minlength=2 * dims)
            v = (n[:dims] - n[dims:]).astype(float)
            nrm = np.linalg.norm(v)
            vecs.append((v / nrm).tolist() if nrm > 0 else v.tolist())
        return pd.Series(vecs, dtype=object)
    return model
