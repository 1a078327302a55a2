"""Sentence pieces of whole documents: encoding with byte spans, and decoding."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthlens.llm.common import binary_views, ship
from monthlens.llm.pieces import Model

#: Text bytes encoded at a time.
CHUNK = 4 << 20
DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string, n_covered long"
_MODELS: dict[str, Model] = {}


def model_of(sent) -> Model:
    """One model for each worker process and broadcast."""
    blob = sent.value
    key = hashlib.sha256(blob).hexdigest()
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(blob)
    return _MODELS[key]


def chunks(views: list[memoryview]):
    """(first row, texts) with CHUNK bytes or one text; bytes that are no UTF-8 read as U+FFFD."""
    held, size, first = [], 0, 0
    for row, v in enumerate(views):
        held.append(bytes(v).decode("utf-8", "replace"))
        size += len(v)
        if size >= CHUNK:
            yield first, held
            held, size, first = [], 0, row + 1
    if held:
        yield first, held


def encode(docs: DataFrame, model_path: str, *, text: str = "text") -> DataFrame:
    """The columns of docs plus ids array<int>, first and past array<int>: the pieces of the
    whole text, begin and end id included, and the byte span that each covers in it.

    Null is the empty text (begin and end id only).  Columns named like the new ones are
    replaced.
    """
    return _mapped(docs, model_path, text, "ids array<int>, first array<int>, past array<int>", _spans)


def _spans(model: Model, texts: list[str]) -> list[pa.Array]:
    got = list(model.encode(texts))
    lists = pa.list_(pa.int32())
    return [pa.array([g[k] for g in got], lists) for k in range(3)]


def summary(docs: DataFrame, model_path: str, *, text: str = "text") -> DataFrame:
    """The columns of docs plus n_tokens, ids_sha256, decoded_sha256, spans_sha256 and n_covered:
    what encoding, and decoding its ids, give for the whole text.

    ids are hashed as little-endian unsigned 32-bit integers, the decoded text as UTF-8, the
    spans as pairs of 64-bit integers; n_covered counts the text's bytes within spans.
    """
    return _mapped(docs, model_path, text, DIGESTS, _digests)


def encoded_with_digests(docs: DataFrame, model_path: str, *, text: str = "text") -> DataFrame:
    """The columns of docs plus ids array<int> and those of ``summary``."""
    def make(model: Model, texts: list[str]) -> list[pa.Array]:
        got = list(model.encode(texts))
        return [pa.array([g[0] for g in got], pa.list_(pa.int32())), *_digests(model, texts, got)]

    return _mapped(docs, model_path, text, f"ids array<int>, {DIGESTS}", make)


def _digests(model: Model, texts: list[str], got=None) -> list[pa.Array]:
    n, ids_sha, text_sha, spans_sha, covered = [], [], [], [], []
    for ids, first, past in got or model.encode(texts):
        n.append(len(ids))
        ids_sha.append(hashlib.sha256(ids).hexdigest())
        text_sha.append(hashlib.sha256(model.decode(ids).encode("utf-8", "replace")).hexdigest())
        h = hashlib.sha256(first)
        h.update(past)
        spans_sha.append(h.hexdigest())
        covered.append(int((past - first).sum()))
    return [pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()), pa.array(spans_sha, pa.string()), pa.array(covered, pa.int64())]


def decoded(docs: DataFrame, model_path: str, *, ids: str = "ids") -> DataFrame:
    """The columns of docs plus decoded string: what the ids say.  Null ids decode to null."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(open(model_path, "rb").read())

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            model = model_of(sent)
            out = [None if x is None else model.decode(np.array(x, np.int64)) for x in batch.column(ids).to_pylist()]
            keep = [k for k, name in enumerate(batch.schema.names) if name != "decoded"]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(out, pa.string())], [*(batch.schema.names[k] for k in keep), "decoded"])

    plain = docs.drop("decoded")
    return plain.mapInArrow(body, plain.select("*", F.lit("").alias("decoded")).schema)


def _mapped(docs: DataFrame, model_path: str, text: str, new: str, make) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    # the model file is as large at any input size; it is read here, once
    sent = spark.sparkContext.broadcast(open(model_path, "rb").read())
    fresh = [c.split()[0] for c in new.split(", ")]
    others = [c for c in docs.columns if c not in fresh]
    base = docs.select(*[F.col(f"`{c}`") for c in others])
    schema = spark.createDataFrame([], new).schema
    out_schema = type(schema)([*base.schema.fields, *schema.fields])

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model = model_of(sent)
            for first, texts in chunks(binary_views(batch.column(text))):
                made = make(model, texts)
                kept = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([*kept.columns, *made], [*others, *fresh])

    return base.mapInArrow(body, out_schema)
