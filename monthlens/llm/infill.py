"""Fill-in-middle: each document is cut at two ranks and its parts are written in a new order.

The ranks count units of the text (code points, or matches of a pattern).  They are found in
an indexable skip list: every link of a lane carries how many units and how many code points
it spans, and a search adds up widths from the fastest lane down.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthlens.llm.common import binary_views, mix, ship, without

#: Units under one link of the ground lane.
RUN = 64
#: One of this many links of a lane also starts a link of the lane above.
FAN = 4
#: Text bytes in memory at a time (or one text).
CHUNK = 4 << 20
#: Markers before prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
COLUMNS = "n long, form string, prefix_chars long, middle_chars long, output string"


class SkipList:
    """Ranks of a text's units to offsets in code points.

    ``unit`` is None for code points, else a compiled pattern: a unit then ends where a match
    ends and starts where the one before it ended; what follows the last match belongs to the
    last unit, and a text without a match is one unit.  ``n`` counts the units.  One link of
    the ground lane stands for RUN units, so the lists need about a sixteenth of the text.
    """

    def __init__(self, text: str, unit=None):
        self.text, self.unit = text, unit
        units, points = self._runs()
        self.n = int(units.sum())
        coins = mix(np.arange(len(units), dtype=np.uint64))
        self.lanes, self.down = [(units, points)], []
        index = np.arange(len(units))
        while len(index) > FAN:
            # a link is promoted by its own coin, whatever the text; the first one always is
            up = np.flatnonzero((coins[index] % np.uint64(FAN) == 0) | (index == 0))
            coins //= np.uint64(FAN)
            if len(up) == len(index):
                continue
            units, points = np.add.reduceat(units, up), np.add.reduceat(points, up)
            self.lanes.append((units, points))
            self.down.append(up)
            index = index[up]

    def _runs(self) -> tuple[np.ndarray, np.ndarray]:
        """Widths in units and in code points of the ground lane's links."""
        size = len(self.text)
        if self.unit is None:
            units = np.full(-(-size // RUN), RUN, np.int64)
            if size % RUN:
                units[-1] = size % RUN
            return units, units
        ends, n = [], 0
        for m in self.unit.finditer(self.text):
            if m.end() > m.start():
                n += 1
                if n % RUN == 0:
                    ends.append(m.end())
        n = max(n, 1) if size else 0
        units = np.full(-(-n // RUN), RUN, np.int64)
        if n % RUN:
            units[-1] = n % RUN
            ends.append(size)
        elif n:
            ends[-1] = size
        return units, np.diff(np.array([0, *ends], np.int64))

    def offset(self, rank: int) -> int:
        """Code points before the unit of that rank (0 to n)."""
        at = units = points = 0
        for lane in range(len(self.lanes) - 1, -1, -1):
            u, p = self.lanes[lane]
            while at < len(u) and units + u[at] <= rank:
                units += int(u[at])
                points += int(p[at])
                at += 1
            if lane:
                at = int(self.down[lane - 1][at]) if at < len(u) else len(self.lanes[lane - 1][0])
        left = rank - units  # within one link of the ground lane
        if self.unit is None:
            return points + left
        if left:
            for m in self.unit.finditer(self.text, points):
                left -= m.end() > m.start()
                if not left:
                    return m.end()
        return points


def draws(seed: int, doc_id) -> list[int]:
    """Four 32-bit integers that depend on seed and id alone (a null id is the empty text)."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k:k + 8], 16) for k in (0, 8, 16, 24)]


def rearranged(text: str, h: list[int], unit, markers: tuple[str, str, str], plain_percent: int, spm_percent: int):
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    units = SkipList(text, unit)
    if not text or any(m in text for m in markers) or h[2] % 100 >= 100 - plain_percent:
        return units.n, "plain", None, None, text
    low, high = sorted((h[0] % (units.n + 1), h[1] % (units.n + 1)))
    a, b = units.offset(low), units.offset(high)
    p, s, m = markers
    if h[3] % 100 < spm_percent:
        return units.n, "spm", a, b - a, f"{s}{text[b:]}{p}{text[:a]}{m}{text[a:b]}"
    return units.n, "psm", a, b - a, f"{p}{text[:a]}{s}{text[b:]}{m}{text[a:b]}"


def _check(markers: tuple[str, str, str]) -> None:
    """No marker may arise where text and marker meet, else outputs could not be read back."""
    for a in markers:
        if not a or any(a != b and a in b for b in markers) or any(a[-k:] == b[:k] for b in markers for k in range(1, min(len(a), len(b)) + (a != b))):
            raise ValueError("markers must not be empty, lie in each other, or end as another begins")
    if len(set(markers)) < 3:
        raise ValueError("three different markers are needed")


def fill_in_middle(docs: DataFrame, *, text: str = "text", key: str = "doc_id", seed: int = 1, unit: str | None = None,
                   markers: tuple[str, str, str] = MARKERS, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """The columns of docs plus n, form, prefix_chars, middle_chars and output.

    Two ranks from 0 to n, drawn from seed and key, part the text into prefix, middle and
    suffix; form ``psm`` writes prefix, suffix, middle, each behind its marker, ``spm`` writes
    suffix, prefix, middle, and ``plain`` leaves the text as it is: where it is empty or null,
    holds a marker, or is drawn for it.  n counts units, the other two code points (null where
    plain).  ``unit`` is a pattern of the units, None for code points.

    A null key draws as the empty text; rows given twice come out twice and alike; whole texts
    of any length are cut (one at a time beyond CHUNK bytes); an empty table gives an empty
    one.  Columns named like the new ones are replaced, others stay.
    """
    _check(markers)
    ship(docs.sparkSession)
    base = without(docs, [c.split()[0] for c in COLUMNS.split(", ")])
    new = docs.sparkSession.createDataFrame([], COLUMNS).schema
    schema = type(new)([*base.schema.fields, *new.fields])
    found = None if unit is None else regex.compile(unit)

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, views, first = batch.column(key), binary_views(batch.column(text)), 0
            while first < len(views):
                past, size = first, 0
                while past < len(views) and (past == first or size + len(views[past]) <= CHUNK):
                    size += len(views[past])
                    past += 1
                # bytes that are no UTF-8 go through unchanged, each as a code point
                made = [rearranged(bytes(views[k]).decode("utf-8", "surrogateescape"), draws(seed, keys[k].as_py()), found, markers, plain_percent, spm_percent)
                        for k in range(first, past)]
                n, form, prefix, middle, out = zip(*made)
                out = pa.array([x.encode("utf-8", "surrogateescape") for x in out], pa.binary()).cast(pa.string(), safe=False)
                kept = batch.slice(first, past - first)
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), out], schema.names)
                first = past

    return base.mapInArrow(body, schema)


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that ``fill_in_middle`` has rearranged, from its output and form alone."""
    p, s, m = markers

    def part(after: str, before: str | None = None) -> Column:
        # by markers, as nothing else in an output that is not plain holds one
        return F.substring_index(output if before is None else F.substring_index(output, before, 1), after, -1)

    return (F.when(form == "psm", F.concat(part(p, s), part(m), part(s, m)))
            .when(form == "spm", F.concat(part(p, m), part(m), part(s, p))).otherwise(output))
