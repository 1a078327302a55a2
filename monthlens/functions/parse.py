"""Numbered-reply parsing as column expressions (no Python per row).

A reply is text with one item per line: ``N. keywords`` (also ``N) `` and
``N: ``). Lines are stripped and blank lines dropped; the number prefix is cut
at the first separator found, trying '. ' then ') ' then ': ', and only when
everything before it is digits (after stripping).

strict  -> array of exactly ``n`` items, else NULL
lenient -> array padded with '' or truncated to ``n``
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from monthlens.functions.text import strip_ws

# --- fixed values: item-number separators, tried in this order --------------
SEPARATORS = (". ", ") ", ": ")
# --- end fixed values -------------------------------------------------------


def _cut_number(line: Column) -> Column:
    # nested CASE: the first separator in SEPARATORS order whose prefix is all digits wins
    out = line
    for sep in reversed(SEPARATORS):
        idx = F.instr(line, sep)  # 1-based, 0 when absent
        prefix = strip_ws(F.substring(line, F.lit(1), idx - 1))
        ok = (idx > 0) & prefix.rlike("^[0-9]+$")
        out = F.when(ok, F.substring(line, idx + F.lit(len(sep)), F.lit(1 << 30))).otherwise(out)
    return strip_ws(out)


def reply_lines(text: Column | str) -> Column:
    """Non-blank stripped lines, number prefixes removed."""
    c = F.col(text) if isinstance(text, str) else text
    lines = F.split(strip_ws(F.coalesce(c, F.lit(""))), "\n")
    kept = F.filter(F.transform(lines, strip_ws), lambda l: l != "")
    return F.transform(kept, _cut_number)


def parse_strict(text: Column | str, n: Column | str | int) -> Column:
    nn = F.lit(n) if isinstance(n, int) else (F.col(n) if isinstance(n, str) else n)
    items = reply_lines(text)
    return F.when(F.size(items) == nn, items)


def parse_lenient(text: Column | str, n: Column | str | int) -> Column:
    nn = F.lit(n) if isinstance(n, int) else (F.col(n) if isinstance(n, str) else n)
    items = reply_lines(text)
    padded = F.concat(items, F.array_repeat(F.lit(""), F.greatest(nn - F.size(items), F.lit(0))))
    return F.slice(padded, 1, nn)
