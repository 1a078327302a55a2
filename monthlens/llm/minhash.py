"""Near-duplicate documents by a signature-coordinate inverted join.

Each document is a set of five-word shingles and has a signature of ``K`` minima.  Documents
with a Jaccard similarity of 0.85 agree in 54 of 64 coordinates on average, and in fewer than
36 with probability under 1e-8; ``matches`` gives that number (31 at 0.8) for each threshold.  So:

1. Documents with equal sets are one *node*.
2. A node is posted under coordinate-value pairs.  Two nodes that agree in m = matches(percent)
   of K coordinates share one of the first K - m + 1 of either, in any common order of the
   pairs; pairs that a sample of the nodes shows to be frequent come last in that order, so
   what many documents share is hardly posted (the prefix).
3. In each posting list the members' collisions with its smallest node are counted.  Lists
   whose members are then connected are done (the skip); in the others the members of
   different parts are compared too.  What is connected by m collisions is a *cluster*;
   every pair with so many lies in one.
4. In a cluster links are confirmed on the full shingle sets: first those of each node with
   the partner it has most collisions with, then, where that leaves several components, of
   all pairs of different components.

Comparisons run in blocks of bounded size, and a block reports the few links that connect its
members, not its pairs.  The largest component of a list or cluster is never compared with
itself.  Nothing is capped or sampled: the sample decides the order of posting alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthlens.llm.common import binary_views, int_column, long_column, mix, ship, signed64, stored
from monthlens.llm.components import components, edges_of
from monthlens.llm.superkmer import gram_hashes, word_hashes

U64 = np.uint64
SHINGLE = 5
PERCENT = 85
#: Coordinates of a signature, and the share of pairs at the threshold that may go unseen.
K, MISSED = 64, 1e-8
SAMPLE, HOT_SHARE = 4000, 0.004
#: Nodes compared with each other in one block.
BLOCK = 1024
#: Most pairs whose ids (16 bytes each) are broadcast to the scan of the sets.
BROADCAST_PAIRS = 200_000
_RNG = np.random.default_rng(20)
_MUL = _RNG.integers(1, 1 << 63, K, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_ADD = _RNG.integers(0, 1 << 63, K, dtype=np.int64).astype(U64)


def matches(percent: int) -> int:
    """The most coordinates in which all but MISSED of the pairs of ``percent`` agree."""
    p, below = percent / 100, 0.0
    for m in range(K + 1):
        below += comb(K, m) * p**m * (1 - p) ** (K - m)  # P(m agree at most)
        if below > MISSED:
            return max(m, 1)
    return K


def shingles(view, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit names of the shingles of the lower-cased words."""
    text = b" ".join(bytes(view).lower().split())
    if not text:
        return np.array([], U64)
    data = np.frombuffer(text, np.uint8)
    gap = np.flatnonzero(data == 32)
    word = word_hashes(data, np.concatenate([[0], gap + 1]), np.append(gap, len(data)))
    if len(word) < size:
        return gram_hashes(word, len(word)) ^ U64(len(word))
    return np.unique(gram_hashes(word, size))


def signature(names: np.ndarray) -> np.ndarray:
    """The smallest name under each of K functions; names in slices, so memory is bounded."""
    low = np.full(K, np.iinfo(U64).max, U64)
    for at in range(0, len(names), 1024):
        y = names[at : at + 1024, None] * _MUL
        y += _ADD
        np.minimum(low, y.min(axis=0), out=low)
    return (low >> U64(32)).astype(np.uint32)


def elements(low: np.ndarray) -> np.ndarray:
    """64-bit names of the coordinate-value pairs of signatures."""
    return mix(low.astype(U64) | np.arange(K, dtype=U64) << U64(32))


def signatures(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint32).reshape(-1, K)


def sets_of(batches: Iterator[pa.RecordBatch], size: int):
    for batch in batches:
        views = binary_views(batch.column("text"))
        yield batch, [shingles(v, size) for v in views]


def node_of(names: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(names.tobytes(), len(names))


def sign(size: int):
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in sets_of(batches, size):
            lows = [signature(s) if len(s) else None for s in sets]
            node = np.array([node_of(s) for s in sets], U64).view(np.int64)
            thash = [signed64(xxhash.xxh3_64_intdigest(v)) for v in binary_views(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(thash, pa.int64()), batch.column("jhash"), pa.array(node), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([None if x is None else x.tobytes() for x in lows], pa.binary())], ["doc_id", "thash", "jhash", "node", "n_shingles", "low"])

    return body


def post(hot: np.ndarray, hot_rank: np.ndarray, prefix: int):
    """(element, node) for the prefix of each node; frequent elements come last."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = elements(signatures(batch.column(1)))
            rank = np.zeros(e.shape, np.int64)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, e), len(hot) - 1)
                rank = np.where(hot[at] == e, hot_rank[at], 0)
            order = np.lexsort((e, rank), axis=1)[:, :prefix]
            chosen = np.take_along_axis(e, order, 1)
            yield pa.RecordBatch.from_arrays([pa.array(chosen.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), prefix))], ["e", "node"])

    return body


def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (e, node) to (e, node, pivot), lists of one node left out."""
    last = None  # (e, node, pivot, told) of the last row
    for batch in batches:
        if not batch.num_rows:
            continue
        e, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        told = True
        pivot0 = None
        if last is not None:
            e, node = np.concatenate([[last[0]], e]), np.concatenate([[last[1]], node])
            pivot0, told = last[2], last[3]
        head = np.ones(len(e), bool)
        head[1:] = e[1:] != e[:-1]
        at = np.maximum.accumulate(np.where(head, np.arange(len(e)), 0))
        pivot = node[at]
        if pivot0 is not None:
            pivot[at == 0] = pivot0
        many = ~head
        many[:-1] |= ~head[1:]
        if last is not None:
            many[0] = many[0] and not told
        told_last = bool(many[-1])
        yield pa.RecordBatch.from_arrays([pa.array(e[many]), pa.array(node[many]), pa.array(pivot[many])], ["e", "node", "pivot"])
        last = (e[-1], node[-1], pivot[-1], told_last)


def count_pairs(least: int):
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n = (signatures(batch.column("ea")) == signatures(batch.column("eb"))).sum(axis=1)
                keep = pa.array(n >= least)
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep), pa.array(n.astype(np.int32)).filter(keep)], ["a", "b", "n"])

    return body


def counted(pairs: DataFrame, nodes: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b) with ``least`` collisions at least, and how many."""
    left = nodes.select(F.col("node").alias("a"), F.col("low").alias("ea"))
    right = nodes.select(F.col("node").alias("b"), F.col("low").alias("eb"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "ea", "eb").mapInArrow(count_pairs(least), "a long, b long, n int")


def full_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, names) of the wanted nodes, from the text of one document of each.  Documents go
    by id and hash of the text, so many null or equal ids are no group."""
    need = wanted.join(nodes.select("node", "doc_id", "jhash"), "node").select(F.col("doc_id").alias("r_id"), F.col("jhash").alias("r_hash"), "node")
    text = need.join(docs, F.col("r_id").eqNullSafe(F.col("doc_id")) & (F.col("r_hash") == F.col("jhash"))).select("node", "text")

    def body(batches):
        for batch, sets in sets_of(batches, size):
            node = batch.column("node").to_pylist()
            own = np.array([node_of(s) for s in sets], U64).view(np.int64).tolist()
            ok = [i for i, (x, y) in enumerate(zip(node, own)) if x == y]
            yield pa.RecordBatch.from_arrays([pa.array([node[i] for i in ok], pa.int64()), pa.array([sets[i].tobytes() for i in ok], pa.binary())], ["node", "names"])

    return text.mapInArrow(body, "node long, names binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full sets."""
    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("node"))
    if pairs.count() <= BROADCAST_PAIRS:
        ends = F.broadcast(ends)
    both = sets.join(ends, "node").select("a", "b", "node", "names").repartition("a", "b").sortWithinPartitions("a", "b", "node")

    def body(batches):
        held = None
        for batch in batches:
            a, b, node = (batch.column(i).to_pylist() for i in range(3))
            out = []
            for i, view in enumerate(binary_views(batch.column(3))):
                key = (a[i], b[i])
                if held is not None and held[0] == key and held[1] != node[i]:
                    x, y = held[2], np.frombuffer(bytes(view), U64)
                    same = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * same >= percent * (len(x) + len(y) - same):
                        out.append(key)
                    held = (None, None, None)
                elif held is None or held[0] != key:
                    held = (key, node[i], np.frombuffer(bytes(view), U64))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.int64()), pa.array([k[1] for k in out], pa.int64())], ["a", "b"])

    return both.mapInArrow(body, "a long, b long")


def blocks(members: DataFrame, labels: DataFrame, block: int) -> DataFrame:
    """(key, i, j, major, node, label) of (key, node): the blocks in which members of one key
    and of different labels meet; keys with one label are left out.

    The members of a key's largest label are major; they meet the others (the minor ones,
    dealt over numbered blocks) in blocks (i, -1), and the minor ones meet in blocks (i, j)."""
    named = members.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    per = named.groupBy("key", "label").agg(F.count("*").alias("n"))
    per = per.groupBy("key").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all"), F.count("*").alias("parts")).filter("parts > 1")
    per = per.select("key", F.col("top.label").alias("main"), F.ceil((F.col("all") - F.col("top.n")) / block).cast("long").alias("blocks"))
    rows = named.join(per, "key").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    place = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    none = F.lit(-1).cast("long")
    major = F.transform(every, lambda j: place(j, none))
    minor = F.concat(F.transform(every, lambda j: place(F.least(j, F.col("mine")), F.greatest(j, F.col("mine")))), F.array(place(F.col("mine"), none)))
    is_major = F.col("label") == F.col("main")
    rows = rows.select("key", "node", "label", is_major.alias("major"), F.explode(F.when(is_major, major).otherwise(minor)).alias("at"))
    return rows.select("key", "at.i", "at.j", "major", "node", "label")


class Forest:
    """Which of a block's members are connected; tells the links that connect more."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        path = []
        while (y := self.up.get(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            self.up[p] = x
        return x

    def joins(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[b] = a
        return a != b


def compared(rows: DataFrame, value: str, near, part: int = 256) -> DataFrame:
    """Links (a, b) that connect what ``near`` finds alike in the blocks of rows (key, i, j,
    major, node, label, value), members of equal labels apart.

    near(values, values) gives a boolean matrix.  A block's minor members are held, two blocks
    of them at most; its major ones stream past in parts."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, minor, forest, held, links = None, [], Forest(), [], []

        def meet(some: list) -> None:
            if not minor or not some:
                return
            alike = near([m[2] for m in minor], [x[2] for x in some])
            alike &= np.array([m[1] for m in minor])[:, None] != np.array([x[1] for x in some])[None, :]
            for a, b in zip(*(x.tolist() for x in np.nonzero(alike))):
                x, y = minor[a][0], some[b][0]
                if forest.joins(x, y):
                    links.append((min(x, y), max(x, y)))

        def close() -> None:
            meet(held)
            held.clear()
            if key is not None and key[2] >= 0:
                for lo in range(0, len(minor), part):
                    meet(minor[lo : lo + part])

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])
            links.clear()
            return out

        for batch in batches:
            names = ("key", "i", "j", "major", "node", "label", value)
            for k, i, j, major, node, label, v in zip(*(batch.column(n).to_pylist() for n in names)):
                if (k, i, j) != key:
                    close()
                    key, minor, forest = (k, i, j), [], Forest()
                if not major:
                    minor.append((node, label, v))
                else:
                    held.append((node, label, v))
                    if len(held) == part:
                        meet(held)
                        held.clear()
            yield told()
        close()
        yield told()

    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "major", "node")
    return rows.mapInArrow(body, "a long, b long").distinct()


def collide(least: int):
    """near() of signatures: ``least`` equal coordinates."""

    def near(a: list[bytes], b: list[bytes]) -> np.ndarray:
        x, y = (np.frombuffer(b"".join(v), np.uint32).reshape(-1, K) for v in (a, b))
        n = np.zeros((len(x), len(y)), np.uint8)
        for k in range(K):
            n += x[:, k, None] == y[None, :, k]
        return n >= least

    return near


def similar(percent: int):
    """near() of full sets: products of membership matrices over the shared shingles."""

    def near(a: list[bytes], b: list[bytes]) -> np.ndarray:
        size = [np.array([len(v) // 8 for v in x]) for x in (a, b)]
        names = [np.frombuffer(b"".join(x), U64) for x in (a, b)]
        shared = np.intersect1d(names[0], names[1])
        both = np.zeros((len(a), len(b)), np.float32)
        cells = []
        for n, s in zip(names, size):
            at = np.searchsorted(shared, n)
            ok = shared[np.minimum(at, len(shared) - 1)] == n if len(shared) else np.zeros(len(n), bool)
            at, r = at[ok], np.repeat(np.arange(len(s)), s)[ok]
            order = np.argsort(at, kind="stable")
            cells.append((at[order], r[order]))
        for lo in range(0, len(shared), 4096):
            m = []
            for (at, r), n in zip(cells, (len(a), len(b))):
                i, j = np.searchsorted(at, [lo, lo + 4096])
                x = np.zeros((n, min(4096, len(shared) - lo)), np.float32)
                x[r[i:j], at[i:j] - lo] = 1
                m.append(x)
            both += m[0] @ m[1].T
        both = both.astype(np.int64)
        return 100 * both >= percent * (size[0][:, None] + size[1][None, :] - both)

    return near


def near_duplicates(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, block: int = BLOCK, hashed: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row; with ``hashed`` also thash, the
    64-bit hash (xxh3) of its text.

    Words are runs without ASCII white space, A-Z lower-cased; a document is the set of its
    five-word shingles (of its whole sequence where it has fewer words).  Documents with
    100 * intersection >= percent * union are linked; component_id is the smallest doc_id
    reachable, kept whether it is the row's own.

    Null, empty and blank texts have n_shingles 0 and are linked with nothing.  Rows of a
    null doc_id link like others but lend no component_id; they are kept where nobody in the
    component has an id.  Rows with an equal doc_id are all kept if one is.  Other columns
    are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    least = matches(percent)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("jhash"))
    signed = stored(docs.mapInArrow(sign(shingle), "doc_id long, thash long, jhash long, node long, n_shingles long, low binary"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "jhash")).alias("first")  # an id before none
    nodes = signed.filter("n_shingles > 0").groupBy("node").agg(first, F.any_value("low").alias("low"))
    nodes = stored(nodes.select("node", "first.doc_id", "first.jhash", "low"))
    n_nodes = nodes.count()
    sample = nodes.sample(min(1.0, SAMPLE / max(n_nodes, 1)), seed=3).select("low").limit(4 * SAMPLE).collect()
    seen, times = np.unique(elements(np.frombuffer(b"".join(r[0] for r in sample), np.uint32).reshape(-1, K)), return_counts=True)
    hot = times >= max(4, int(HOT_SHARE * len(sample)))
    members = stored(nodes.select("node", "low").mapInArrow(post(seen[hot], times[hot], K - least + 1), "e long, node long")
                     .repartition("e").sortWithinPartitions("e", "node").mapInArrow(lists, "e long, node long, pivot long"))
    pairs = members.filter("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    pairs = stored(counted(pairs, nodes, least))
    # clusters: parts connected by as many collisions
    labels = components(pairs)
    apart = blocks(members.select(F.col("e").alias("key"), "node"), labels, block).join(nodes.select("node", "low"), "node")
    more = stored(compared(apart, "low", collide(least)))
    clusters = labels if more.isEmpty() else components(edges_of(labels).unionAll(more))
    sets = stored(full_sets(docs, nodes, clusters.select("node"), shingle))
    # links: of each node with the partner it has most collisions with, then between components
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select("a", "b")
    links = stored(confirmed(best, sets, percent))
    labels = components(links)
    apart = blocks(clusters.select(F.col("label").alias("key"), "node"), labels, block).join(sets, "node")
    more = stored(compared(apart, "names", similar(percent)))
    if not more.isEmpty():
        labels = components(edges_of(labels).unionAll(more))
    group = labels.join(nodes.select("node", "doc_id"), "node").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_node = nodes.join(labels, "node", "left").join(group, "label", "left").select("node", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    out = signed.select("doc_id", "thash", "node", "n_shingles").join(of_node, "node", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", *["thash"] * hashed, "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
