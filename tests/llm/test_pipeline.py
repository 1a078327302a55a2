"""The five stages on a small corpus: what each must drop, and what must stay."""

import random

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as C

WORDS = {"en": "the of and ing tion er th a".split(), "de": "der die und sch ung ein ich ß".split()}
QUESTION = "Thonst ndhat erean sted ontion reth wherea tinnth anore dthing estha onere thble"


def corpus():
    rnd = random.Random(7)
    text = lambda lang, n: " ".join("".join(rnd.choice(WORDS[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(n))
    docs = [(k, "\n".join(text(lang, 12) for _ in range(8)), lang) for k in range(60) for lang in [rnd.choice(["en", "de"])]]
    boiler = text("en", 14)
    docs += [(100 + k, boiler + "\n" + text("en", 40), "en") for k in range(5)]          # a line that repeats
    docs += [(200, docs[3][1], docs[3][2])]                                              # a copy
    words = docs[5][1].replace("\n", " ").split()
    docs += [(201, " ".join(words[:50] + ["changed"] + words[51:]), docs[5][2])]         # a near copy on one line
    docs += [(300, text("en", 30) + " " + QUESTION + " " + text("en", 30), "en")]        # holds a question
    docs += [(400, None, "en"), (401, "12 34 !?", "en"), (402, "", None)]                # no language
    docs += [(None, text("de", 50), None), (500, text("en", 20000), "en"), (501, text("en", 60), "en"), (501, docs[-1][1], "en")]
    docs[-1] = (501, docs[-2][1], "en")                                                  # a row given twice
    return docs, boiler


def test_stages(spark, tmp_path, documents):
    rows, boiler = corpus()
    sf = str(tmp_path)
    documents(rows, extra=("_lang", "kept_text", "node")).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, QUESTION), (2, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs, seen = C.table(spark, sf, "documents"), []
    columns = docs.columns
    for k, (name, stage) in enumerate(C.STAGES):
        docs = C.stored(stage(spark, docs, sf))
        if k < 4:
            assert docs.columns == columns, name
        seen.append(docs.collect())
    ids = [sorted((r.doc_id is not None, r.doc_id or 0) for r in s) for s in seen]
    every = sorted((r[0] is not None, r[0] or 0) for r in rows)
    gone = lambda a, b: sorted(x[1] for x in set(a) - set(b))
    assert gone(every, ids[0]) == [400, 401, 402]
    assert gone(ids[0], ids[1]) == [200]                          # nothing of the copy is left
    with_line = [r.doc_id for r in seen[1] if boiler in r.text]
    assert with_line == [100] or sorted(with_line) == [100]
    assert gone(ids[1], ids[2]) == [201] and ids[2].count((True, 501)) == 1
    assert gone(ids[2], ids[3]) == [300]
    assert all(r.n_chars == len(r.text) for r in seen[1])
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    text = {r.doc_id: r.text for r in seen[3]}
    assert ids[4] == ids[3]
    for r in seen[4]:
        assert r.ids == lib.encode(text[r.doc_id], add_bos=True, add_eos=True) and r.n_tokens == len(r.ids)


def test_nothing(spark, tmp_path, documents):
    sf = str(tmp_path)
    documents([]).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert C.run(spark, sf).collect() == []


def test_entry_points(spark):
    import __spark_entry__ as E
    names = set(E.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(E.oracle_sql()) <= names
