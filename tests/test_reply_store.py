"""Replies are kept by what was asked, committed in parts, and found again later."""

import datetime as dt

import pandas as pd
import pytest

from monthlens.operators import inference as I

CALLS = "calls.txt"


def articles(spark, rows):
    return spark.createDataFrame([(i, dt.datetime(2020, 1, 1), t) for i, t in rows],
                                 "article_id long, display_date timestamp_ntz, headline string")


def echo(folder, fail=()):
    """A model that answers each line with itself and notes every call."""
    def model(batch: pd.DataFrame) -> pd.Series:
        out = []
        for r in batch.itertuples(index=False):
            body = r.prompt.split("Headlines:\n", 1)[1].rsplit("\n\nOutput:", 1)[0]
            with open(f"{folder}/{CALLS}", "a") as f:
                f.write(f"{r.n}\n")
            if any(x in body for x in fail):
                raise ValueError("no")
            out.append(body)
        return pd.Series(out, dtype=object)
    return model


def calls(folder):
    try:
        return len(open(f"{folder}/{CALLS}").read().split())
    except FileNotFoundError:
        return 0


def topics(spark, rows, folder, **kw):
    g = I.generate_topics(articles(spark, rows), echo(folder, kw.pop("fail", ())), batch_size=5,
                          store_path=f"{folder}/store", **kw)
    return {r.article_id: r.generated_topics for r in g.collect()}


ROWS = [(10 * i, f"headline {i}") for i in range(1, 23)]


def test_inserted_and_changed_articles_keep_their_own_replies(spark, tmp_path):
    assert topics(spark, ROWS, tmp_path) == dict(ROWS)
    first = calls(tmp_path)
    assert topics(spark, ROWS, tmp_path) == dict(ROWS) and calls(tmp_path) == first   # a restart asks nothing
    more = [(1, "put before all"), *ROWS]
    assert topics(spark, more, tmp_path) == dict(more)
    before = calls(tmp_path)
    changed = [(i, t + " changed" if i == 220 else t) for i, t in more]
    assert topics(spark, changed, tmp_path) == dict(changed)
    assert calls(tmp_path) == before + 1                                            # one batch is new


def test_a_failing_call_fails_alone(spark, tmp_path):
    got = topics(spark, ROWS, tmp_path, fail=("headline 7",), max_attempts=1)
    assert {i for i, t in got.items() if t == ""} == {60, 70, 80, 90, 100}
    assert topics(spark, ROWS, tmp_path, max_attempts=2) == dict(ROWS)               # goes on with the failed one


def test_commits_inside_a_round(spark, tmp_path, monkeypatch):
    a = articles(spark, ROWS)
    work = I.work_items(I.prompts(I.batches(a, 5)), I.settings(["base"], [0.3], 1))
    store = f"{tmp_path}/store"
    real, done = I.IncrementalTable.append, []

    def append(self, df):
        if len(done) == 2:
            raise RuntimeError("lost")
        done.append(1)
        real(self, df)

    monkeypatch.setattr(I.IncrementalTable, "append", append)
    with pytest.raises(RuntimeError):
        I.generate(work, echo(tmp_path), store_path=store, calls_per_commit=1)
    kept = calls(tmp_path)
    monkeypatch.setattr(I.IncrementalTable, "append", real)
    out = I.generate(work, echo(tmp_path), store_path=store, calls_per_commit=1)
    assert out.count() == 5 and kept >= 1 and calls(tmp_path) == 5                   # nothing is asked twice


def test_stores_lie_below_the_named_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert I.stable_store_path(spark, "m").startswith(f"{root}/incremental/")


def store_of(spark, folder):
    return I.IncrementalTable(spark, f"{folder}/store", I.KEYS, "attempt", partition_by="variant")


def test_one_copy_of_each_prompt_whatever_the_grid(spark, tmp_path, monkeypatch):
    written = []
    real = I.cut_lineage

    def noted(df):
        out = real(df)
        if "prompt" in out.columns:
            written.append(out.count())
        return out

    monkeypatch.setattr(I, "cut_lineage", noted)
    g = I.generate_topics(articles(spark, ROWS), echo(tmp_path), variants=("base", "bull"), temperatures=(0.1, 0.9), runs=3, batch_size=5, store_path=f"{tmp_path}/store")
    assert g.count() == 12 * len(ROWS) and calls(tmp_path) == 60
    assert written == [5]                                       # 5 prompts, 60 calls
    assert {(r.variant, r.temperature, r.run) for r in g.select("variant", "temperature", "run").distinct().collect()} == \
        {(v, t, k) for v in ("base", "bull") for t in (0.1, 0.9) for k in range(3)}


def test_a_torn_commit_is_not_read(spark, tmp_path):
    import glob
    import os

    topics(spark, ROWS, tmp_path)
    store = store_of(spark, tmp_path)
    (whole,) = store.commits()
    torn = f"{tmp_path}/store/commit=99999999999999999999-torn/variant=base"
    os.makedirs(torn)
    part = glob.glob(f"{whole.removeprefix('file:')}/variant=base/*.parquet")[0]
    with open(part, "rb") as f, open(f"{torn}/{os.path.basename(part)}", "wb") as g:
        g.write(f.read()[:100])                                 # half a file, and no mark of success
    assert store.commits() == [whole]
    before = calls(tmp_path)
    assert topics(spark, ROWS, tmp_path) == dict(ROWS) and calls(tmp_path) == before


def test_compaction_keeps_the_latest_row_of_each_key(spark, tmp_path):
    for attempts in range(1, 5):
        topics(spark, ROWS, tmp_path, fail=("headline 7", "headline 19"), max_attempts=attempts)
    store = store_of(spark, tmp_path)
    before = {(r.asked, r.attempt, r.text) for r in store.read(I.REPLY_SCHEMA).collect()}
    rows = spark.read.parquet(f"{tmp_path}/store").count()
    assert len(store.commits()) == 4 and rows > len(before) == 5
    assert store.compact(I.REPLY_SCHEMA) and not store.compact(I.REPLY_SCHEMA)
    assert len(store.commits()) == 1 and spark.read.parquet(f"{tmp_path}/store").count() == 5      # a row for each key
    assert {(r.asked, r.attempt, r.text) for r in store.read(I.REPLY_SCHEMA).collect()} == before


def test_a_variant_is_found_and_read_alone(spark, tmp_path):
    g = I.generate_topics(articles(spark, ROWS), echo(tmp_path), variants=("base", "bear"), batch_size=5, store_path=f"{tmp_path}/store")
    assert g.count() == 44
    store = store_of(spark, tmp_path)
    assert store.values() == ["base", "bear"]
    plan = store.read(I.REPLY_SCHEMA).where("variant = 'bear'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(variant" in plan and "= bear)" in plan


def test_variants_that_are_there(spark, tmp_path):
    from monthlens.plans import analyses as A
    from monthlens.sources import tables as S
    path = f"{tmp_path}/by_variant"
    assert S.partition_values(spark, path, "variant") == []
    rows = spark.createDataFrame([(1, dt.datetime(2020, 1, 1), "a b", "bull"), (2, dt.datetime(2020, 2, 1), "c", "bear")],
                                 "article_id long, display_date timestamp_ntz, generated_topics string, variant string")
    S.write_partitioned(rows, path, ["variant"])
    assert S.partition_values(spark, path, "variant") == ["bear", "bull"]
    one = A.variant_articles(spark, path, "bull")
    assert [r.headline for r in one.collect()] == ["a b"]
    assert "(variant" in one._jdf.queryExecution().executedPlan().toString().split("PartitionFilters:")[1][:60]


def test_a_changed_model_has_other_replies():
    def model(batch):
        return batch

    model.version = "1"
    first = I.model_version(model)
    model.version = "2"
    assert I.model_version(model) != first and I.model_version(echo("x")).count("@") == 1


def test_prompts_lie_in_order_and_a_commit_asks_for_a_stretch(spark, tmp_path, monkeypatch):
    """Each commit's scan of the prompts has a range of places that Parquet can prune by."""
    plans, kept = [], []
    real, cut = I.call_model, I.cut_lineage

    def noted(calls, model):
        plans.append(calls._jdf.queryExecution().executedPlan().toString())
        return real(calls, model)

    def cutting(df):
        out = cut(df)
        if "prompt" in out.columns:
            kept.append(out)
        return out

    monkeypatch.setattr(I, "call_model", noted)
    monkeypatch.setattr(I, "cut_lineage", cutting)
    work = I.work_items(I.prompts(I.batches(articles(spark, ROWS), 2)), I.settings(["base", "bull"], [0.3], 1))
    out = I.generate(work, echo(tmp_path), store_path=f"{tmp_path}/store", calls_per_commit=6)
    assert out.count() == 22 and calls(tmp_path) == 22 and len(plans) == 4
    assert all("GreaterThanOrEqual(place," in p and "LessThan(place," in p for p in plans)
    for part in kept[0].select("place").rdd.glom().collect():
        assert [r.place for r in part] == sorted(r.place for r in part)
