"""Line dedup by a segment-partition edit join, in DataFrame functions alone.

Two lines within ``edits`` edits share, whatever the edits are, one of the edits + 1 segments
of the shorter line unchanged.  So each different line is indexed under its segments (with its
length and the segment's number) and looked up, for each length a partner may have, with the
substrings that could be that segment.  Where a segment is shared by very many lines its lists
are refined: with the segment cut out the rest still lies within the same number of edits, so
the rest is indexed and looked up again.  Lists that stay long are joined to a pivot first, and
only lines that then lie in different classes are compared further, block by block.  Pairs whose
counts of characters rule them out are dropped; the others are verified by banded bit-parallel edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthlens.llm.common import free, stored
from monthlens.llm.components import components, edges_of

EDITS = 2
#: Lines of fewer characters are matched exactly only.
SHORTEST = 40
#: Members up to which a list's pairs are all looked at.
LIST = 8
#: Members up to which a list is not refined; over LIST of them meet a pivot first.
REFINED = 1024
#: Times that long lists are refined by what is left of their lines.
LEVELS = 3
#: Members of a block where lists that stay long are compared block by block.
BLOCK = 256
#: Characters that are counted together to tell lines apart before they are compared; all others are the last count.
COUNTED = ("e", "t", "a", "o", "i", "n", "s", "h", "r", "dl", "ucm", "fgpwyb", "0123", "456789", " ")
#: Rows (of a few longs) up to which a side of a join is broadcast; beyond, Spark joins by shuffle.
SMALL = 1_000_000
OUT = ("n_lines", "n_removed", "n_near", "kept_text")


def small(df: DataFrame) -> DataFrame:
    """Broadcast behind a count of its rows; ``df`` has rows of a few longs."""
    return F.broadcast(df) if df.count() <= SMALL else df


def index_places(edits: int) -> list[tuple[int, int, int]]:
    """(segment, shift, characters that the other line is shorter) under which a line is indexed."""
    return [(i, 0, 0) for i in range(edits + 1)]


def probe_places(edits: int) -> list[tuple[int, int, int]]:
    """Under which it is looked up: segment i of a line that is ``less`` characters shorter has i edits
    before it at most, and edits - i after it. Its own segments are left out."""
    out = [(i, shift, less) for less in range(edits + 1) for i in range(edits + 1)
           for shift in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1)]
    return [x for x in out if x not in index_places(edits)]


def posted(lines: DataFrame, places: list[tuple[int, int, int]], edits: int, *more: str) -> DataFrame:
    """(key, id, index, first, n, more columns) of lines (id, line, salt, more): one row for each
    place; index: is it one of the line's own segments?

    The places are exploded first, so that one short expression is compiled for all of them."""
    spots = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(shift).alias("shift"), F.lit(less).alias("less"), F.lit(less == 0 and shift == 0).alias("index")) for i, shift, less in places])
    rows = lines.select("id", "line", "salt", *more, F.length("line").alias("size"), F.explode(spots).alias("s"))
    rows = rows.select("id", "line", "salt", *more, "size", (F.col("size") - F.col("s.less")).alias("other"), F.col("s.i").alias("i"), F.col("s.shift").alias("shift"), F.col("s.index").alias("index"))
    parts = edits + 1
    base, extra = F.floor(F.col("other") / parts).cast("int"), F.col("other") % parts
    plain = F.lit(parts) - extra  # segments of the base length; the last ones are one longer
    rows = rows.withColumn("n", base + (F.col("i") >= plain).cast("int"))
    rows = rows.withColumn("first", F.col("i") * base + F.greatest(F.lit(0), F.col("i") - plain) + 1 + F.col("shift"))
    rows = rows.where("n > 0 and first >= 1 and first + n - 1 <= size")
    return rows.select(F.xxhash64("salt", "other", "i", F.substr("line", F.col("first"), F.col("n"))).alias("key"), "id", "index", "first", "n", *more)


def counts_of(line: Column) -> tuple[Column, Column]:
    """How often the COUNTED characters and all others occur (255 at most each), a byte each in two longs.

    An edit changes two of the counts by one, or one of them: lines within ``edits`` edits differ by
    2 * edits in sum at most."""
    size = F.length(line)
    each = [size - F.length(F.translate(line, chars, "")) for chars in COUNTED]
    others = size
    for c in each:
        others = others - c
    held = [F.least(c, F.lit(255)).cast("long") for c in [*each, others]]
    pack = lambda xs: sum((F.shiftleft(x, 8 * k) for k, x in enumerate(xs[1:], 1)), xs[0])
    return pack(held[:8]), pack(held[8:])


def alike(edits: int) -> Column:
    """Whether the counts c0, c1 and d0, d1 of two lines leave ``edits`` edits possible."""
    part = lambda c, k: F.shiftrightunsigned(c, 8 * k).bitwiseAND(F.lit(255))
    away = sum((F.abs(part(F.col(a), k) - part(F.col(b), k)) for a, b in (("c0", "d0"), ("c1", "d1")) for k in range(8)), F.lit(0))
    return away <= 2 * edits


def let(value: Column, use) -> Column:
    """``use(x)`` with x evaluated once."""
    return F.transform(F.array(value), use)[0]


def common_prefix(a: Column, b: Column, most: Column) -> Column:
    """Characters that both begin with, by halving steps."""
    steps = F.array(*[F.lit(1 << k) for k in range(24, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda lo, s: F.when((lo + s <= most) & (F.substr(a, lo + 1, s) == F.substr(b, lo + 1, s)), lo + s).otherwise(lo))


def within(a: Column, b: Column, edits: int, first: int = 10) -> Column:
    """Is the edit distance of a and b (a no longer than b) ``edits`` at most?

    What both begin and end with is cut off; the rest goes through a bit-parallel recursion
    on the vertical differences of a band of 2 * edits + 1 rows, a column at a time.  After
    ``first`` columns a pair whose whole band is beyond ``edits`` is given up."""
    width, top, mask = 2 * edits + 1, 1 << (2 * edits), (1 << (2 * edits + 1)) - 1
    chars = lambda x, n: F.split(F.substr(x, F.lit(1), n), "")

    def columns(p: Column, t: Column, m: Column, lo: Column, hi: Column, start: Column) -> Column:
        """The recursion over columns lo..hi of t; dist: the entry of the band's last row or,
        once that is below p, of p's last row."""
        def step(acc: Column, j: Column) -> Column:
            c = F.get(t, j - 1)
            x = sum((F.when(F.get(p, j - edits + k - 1) == c, F.lit(1 << k)).otherwise(F.lit(0)) for k in range(width)), F.lit(0))
            d0 = let(x, lambda v: ((v.bitwiseAND(acc.vp) + acc.vp).bitwiseXOR(acc.vp)).bitwiseOR(v).bitwiseOR(acc.vn).bitwiseAND(F.lit(mask)))
            return let(d0, lambda d: let(
                F.struct(d.alias("d"), acc.vn.bitwiseOR(F.bitwise_not(d.bitwiseOR(acc.vp))).bitwiseAND(F.lit(mask)).alias("hp"), d.bitwiseAND(acc.vp).alias("hn")),
                lambda h: F.struct(
                    h.hn.bitwiseOR(F.bitwise_not(F.shiftright(h.d, 1).bitwiseOR(h.hp))).bitwiseAND(F.lit(mask)).alias("vp"),
                    F.shiftright(h.d, 1).bitwiseAND(h.hp).alias("vn"),
                    F.when(j + edits <= m, acc.dist + F.when(h.d.bitwiseAND(F.lit(top)) == 0, 1).otherwise(0))
                    .otherwise(acc.dist + let(F.pow(F.lit(2), m - j + edits).cast("int"), lambda bit: F.when(h.hp.bitwiseAND(bit) != 0, 1).when(h.hn.bitwiseAND(bit) != 0, -1).otherwise(0))).alias("dist"))))

        return F.aggregate(F.sequence(lo, hi), start, step)

    def decide(x: Column, y: Column) -> Column:
        def sized(z: Column) -> Column:
            m, n = z.m, z.n
            start = F.struct(F.lit(mask & ~((1 << edits) - 1)).alias("vp"), F.lit(0).alias("vn"), F.lit(edits).alias("dist"))
            begun = columns(chars(x, F.lit(first + edits)), chars(y, F.lit(first)), m, F.lit(1), F.least(n, F.lit(first)), start)
            # no entry of the band is below dist less the rises up to it
            rest = lambda acc: F.when(n <= first, acc.dist <= edits).when(acc.dist - F.bit_count(acc.vp) > edits, False).otherwise(
                columns(chars(x, m), chars(y, n), m, F.lit(first + 1), n, acc).dist <= edits)
            # rests of `edits` characters at most need no more edits; a band needs `edits` rows
            return F.when(n <= edits, True).when(n - m > edits, False).when(m < edits, F.levenshtein(x, y) <= edits).otherwise(let(begun, rest))

        return let(F.struct(F.length(x).alias("m"), F.length(y).alias("n")), sized)

    tail = lambda x, h: F.substr(x, h + 1, F.length(x))
    cut = let(common_prefix(a, b, F.length(a)), lambda h: F.struct(F.reverse(tail(a, h)).alias("x"), F.reverse(tail(b, h)).alias("y")))
    # the rests are reversed now, as are both strings that are compared: the distance stays
    return let(cut, lambda z: let(common_prefix(z.x, z.y, F.length(z.x)), lambda h: let(
        F.struct(tail(z.x, h).alias("x"), tail(z.y, h).alias("y")), lambda r: decide(r.x, r.y))))


def pairs_of(index: DataFrame, probe: DataFrame, edits: int) -> DataFrame:
    """Different ids (a, b) that share a key and whose counts leave them possible; a pair may come repeatedly."""
    p = probe.select("key", F.col("id").alias("other"), F.col("c0").alias("d0"), F.col("c1").alias("d1"))
    both = index.select("key", "id", "c0", "c1").join(p, (index["key"] == p["key"]) & (F.col("id") != F.col("other")) & alike(edits))
    return both.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))


def verified(pairs: DataFrame, lines: DataFrame, edits: int) -> DataFrame:
    """The pairs (a, b) of lines (id, line) that lie within ``edits`` edits."""
    pairs = stored(pairs)
    n = pairs.count()
    hint = F.broadcast if n <= SMALL else (lambda x: x)
    left = lines.select(F.col("id").alias("a"), F.col("line").alias("la"))
    right = lines.select(F.col("id").alias("b"), F.col("line").alias("lb"))
    with_left = left.join(hint(pairs), "a")
    texts = right.join(with_left, "b") if n > SMALL else right.join(hint(pairs.select("b").distinct()), "b").join(with_left, "b")
    short = F.length("la") <= F.length("lb")
    texts = texts.select("a", "b", F.when(short, F.col("la")).otherwise(F.col("lb")).alias("s"), F.when(short, F.col("lb")).otherwise(F.col("la")).alias("t"))
    return texts.filter((F.length("t") - F.length("s") <= edits) & within(F.col("s"), F.col("t"), edits)).select("a", "b")


#: In a sum over a key's posts an index counts this much, a look-up one.
INDEXED = 1 << 32


def lists(lines: DataFrame, edits: int) -> DataFrame:
    """(key, id, index, m, c0, c1, rest) of lines (id, line, salt): the posts of the keys that can
    join two lines; m counts a key's posts, rest is the line without the key's segment, where m is over REFINED.

    Keys are counted first and their posts made again for those that are of use, so that
    not every post is written."""
    places = index_places(edits) + probe_places(edits)
    weight = F.when(F.col("index"), F.lit(INDEXED)).otherwise(F.lit(1)).cast("long")
    counted = posted(lines, places, edits).groupBy("key").agg(F.sum(weight).alias("v"))
    n, k = F.shiftright("v", 32), F.col("v").bitwiseAND(F.lit(INDEXED - 1))
    used = small(stored(counted.where((n > 1) | ((n > 0) & (k > 0))).select("key", (n + k).alias("m"))))
    posts = posted(lines, places, edits, "line").join(used, "key")
    rest = F.concat(F.substr("line", F.lit(1), F.col("first") - 1), F.lit("\u0000"), F.substr("line", F.col("first") + F.col("n"), F.length("line")))
    counts = counts_of(F.col("line"))
    return stored(posts.select("key", "id", "index", "m", counts[0].alias("c0"), counts[1].alias("c1"), F.when(F.col("m") > REFINED, rest).alias("rest")))


def links(lines: DataFrame, edits: int) -> DataFrame:
    """(a, b): links that join all lines within ``edits`` edits into the right classes.

    Every list (the lines indexed and looked up under one key) of LIST posts at most gives
    its pairs, as far as the lines' counts of characters leave them possible. Lists of more than REFINED are refined: without
    the segment that is shared the rests of two lines still lie within ``edits`` edits, so they are
    indexed and looked up again, apart from other lists, up to LEVELS times and while
    four characters for each segment are left. All other lists are joined to their smallest member first, and members
    that then lie in different classes are compared, block by block."""
    now = lines.select("id", "line", F.lit(0).cast("long").alias("salt"))
    pairs, stay = None, None
    for level in range(LEVELS + 1):
        posts = lists(now, edits)
        few = posts.where(F.col("m") <= LIST)
        part = pairs_of(few.where("index"), few, edits)
        pairs = part if pairs is None else pairs.unionAll(part)
        end = (F.length("rest") < 4 * (edits + 1)) | F.lit(level == LEVELS)
        over = posts.where((F.col("m") > LIST) & (F.col("rest").isNull() | end)).select("key", "id", "c0", "c1").distinct()
        stay = over if stay is None else stay.unionAll(over)
        now = stored(posts.where(F.col("rest").isNotNull() & ~end).select("id", F.col("rest").alias("line"), F.col("key").alias("salt")).distinct())
        if now.isEmpty():
            break
    stay = stored(stay)
    first = small(stored(stay.groupBy("key").agg(F.min(F.struct("id", "c0", "c1")).alias("p"))))
    pivots = first.select("key", F.col("p.id").alias("pivot"), F.col("p.c0").alias("d0"), F.col("p.c1").alias("d1"))
    star = stay.join(pivots, "key").where((F.col("id") != F.col("pivot")) & alike(edits)).select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b"))
    found = verified(pairs.unionAll(star).distinct(), lines, edits)
    labels = components(found)
    named = stay.join(small(labels).select(F.col("node").alias("id"), "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    apart = named.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("m")).where("least < most")
    apart = stored(apart.select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")))
    if apart.isEmpty():
        return edges_of(labels)
    # a pair is made under the first of the keys that both have
    named = named.join(small(apart), "key").groupBy("id", "label").agg(F.collect_list(F.struct("key", "c0", "c1", "blocks")).alias("at"))
    named = named.select("id", "label", F.col("at.key").alias("keys"), F.inline("at"))
    named = stored(named.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = named.select("key", "id", "label", "keys", "c0", "c1", F.col("block").alias("x"), every.alias("y")).where("x <= y")
    right = named.select(F.col("key").alias("k"), F.col("id").alias("other"), F.col("label").alias("there"), F.col("keys").alias("theirs"), F.col("c0").alias("d0"), F.col("c1").alias("d1"), F.col("block").alias("v"), every.alias("u")).where("u <= v")
    once = (F.col("x") < F.col("y")) | (F.col("id") < F.col("other"))
    rest = left.join(right, (F.col("key") == F.col("k")) & (F.col("x") == F.col("u")) & (F.col("y") == F.col("v")) & (F.col("label") != F.col("there")) & once & alike(edits)
                     & (F.array_min(F.array_intersect("keys", "theirs")) == F.col("key")))
    rest = rest.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    return edges_of(labels).unionAll(verified(rest, lines, edits))


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, thash, pos, id, line) of every line that is not blank."""
    split = docs.select("doc_id", F.xxhash64("text").alias("thash"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return split.filter(F.trim("line") != "").select("doc_id", "thash", "pos", F.xxhash64("line").alias("id"), "line")


def repeated_lines(docs: DataFrame, edits: int = EDITS, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, thash, pos, exact): the lines of rows (doc_id, text) that repeat an earlier one."""
    rows = line_table(docs)
    place = F.struct("doc_id", "thash", "pos")
    kinds = stored(rows.groupBy("id").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.any_value("line").alias("line")))
    near = components(links(kinds.filter(F.length("line") >= shortest).select("id", "line"), edits)).select(F.col("node").alias("id"), "label")
    near = stored(near.join(kinds.select("id", "first"), "id"))
    of_class = near.groupBy("label").agg(F.min("first").alias("top"))
    judged = near.join(of_class, "label").select("id", "first", "top")
    alone = kinds.filter("n > 1").select("id", "first").join(near.select("id"), "id", "left_anti").select("id", "first", F.col("first").alias("top"))
    judged = small(stored(judged.unionAll(alone)))
    rows = rows.select("doc_id", "thash", "pos", "id").join(judged, "id")
    return rows.filter(~place.eqNullSafe(F.col("top"))).select("doc_id", "thash", "pos", (~place.eqNullSafe(F.col("first"))).alias("exact"))


def dedup_lines(docs: DataFrame, edits: int = EDITS, shortest: int = SHORTEST, keep: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_lines, n_removed, n_near, kept_text of each row; with ``keep``, which names
    these columns anew, all columns of docs come first.

    Lines are what stands between line feeds.  Equal lines, and lines of ``shortest``
    characters or more within ``edits`` edits (of characters), form classes, transitively.
    Of each class the earliest line (smallest doc_id, then place) stays, all others are
    removed; n_near counts those whose very text occurs nowhere earlier.  Blank lines stay and
    are in no class; n_lines counts them too.

    A null text has no lines and stays null.  A null doc_id is the smallest.  Rows with equal
    doc_id and text are one document given twice and keep the same lines; rows with equal
    doc_id and different texts are ordered by a hash of the text.  Equal lines are told by a
    64-bit hash.  Other columns are ignored.
    """
    if shortest < 4 * (edits + 1):
        raise ValueError("lines to be matched within edits need four characters for each segment")
    gone = repeated_lines(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), edits, shortest)
    names = {c: c for c in OUT} | (keep or {})
    own = {c: free(docs, c) for c in ("_id", "_hash", "_gone", "_near", "_parts")}
    lists = gone.groupBy("doc_id", "thash").agg(F.sort_array(F.collect_set("pos")).alias("gone"), F.size(F.collect_set(F.when(~F.col("exact"), F.col("pos")))).alias("n_near"))
    lists = lists.select(F.col("doc_id").alias(own["_id"]), F.col("thash").alias(own["_hash"]), F.col("gone").alias(own["_gone"]), F.col("n_near").alias(own["_near"]))
    base = docs if keep else docs.select("doc_id", "text")
    out = base.join(lists, base["doc_id"].cast("long").eqNullSafe(F.col(own["_id"])) & (F.xxhash64(base["text"]) == F.col(own["_hash"])), "left")
    gone, parts = F.col(own["_gone"]), F.col(own["_parts"])
    out = out.withColumn(own["_parts"], F.split("text", "\n", -1))
    # the stretches between removed lines, put together
    start = lambda k: F.when(k == 0, 0).otherwise(F.get(gone, k - 1) + 1)
    past = lambda k: F.when(k == F.size(gone), F.size(parts)).otherwise(F.get(gone, k))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), lambda k: F.slice(parts, start(k) + 1, past(k) - start(k))))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select(
        *([F.col(f"`{c}`") for c in docs.columns] if keep else ["doc_id"]),
        zero(F.size(parts)).alias(names["n_lines"]), zero(F.when(gone.isNull(), 0).otherwise(F.size(gone))).alias(names["n_removed"]),
        zero(F.col(own["_near"])).alias(names["n_near"]), F.when(gone.isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias(names["kept_text"]))
