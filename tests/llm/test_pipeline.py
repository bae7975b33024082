import importlib.util
import random

import pytest

from graphspark.llm import decontaminate, near_dedup
from tests.llm.test_near_dedup import corpus
from tests.llm.test_suffix_dedup import brute

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("no pipeline", allow_module_level=True)
import corpus_pipeline


def test_stages_on_a_small_corpus(spark, tmp_path):
    rows = [(d if d is not None else 12_345_678, t, "en", f"s{i % 3}", len(t or "")) for i, (d, t) in enumerate(corpus())]
    item = " ".join(rows[0][1].split()[3:18])
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = columns = None
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.read.parquet(f"{tmp_path}/documents.parquet") if docs is None else docs
        columns = columns or docs.columns
        out = stage(spark, docs, str(tmp_path))
        assert name == "pack" or out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
    assert {r.doc_id for r in seen["quality_rules"]} == {d for d, t, *_ in rows if len((t or "").split()) >= 20 and not t.isupper()}
    by = {r.doc_id: r.class_id for r in near_dedup.classes(spark.read.parquet(f"{tmp_path}/quality_rules")).collect()}
    assert sorted(r.doc_id for r in seen["near_dedup"]) == sorted(d for d, c in by.items() if d == c)
    want = brute([(r.doc_id, r.text) for r in seen["near_dedup"]], 100)
    assert {r.doc_id: len(r.text.encode()) for r in seen["suffix_dedup"]} == {d: n - gone for d, (n, gone, *_) in want.items()}
    auto = decontaminate.Automaton([("1", decontaminate.words(item))], 10)
    assert any(len(auto.hits(decontaminate.words(r.text))[0]) for r in seen["suffix_dedup"])
    assert not any(len(auto.hits(decontaminate.words(r.text))[0]) for r in seen["decontaminate"])
    assert {r.doc_id for r in seen["pack"]} == {r.doc_id for r in seen["decontaminate"]}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["pack"])


def test_null_and_repeated_ids_empty_and_long_texts(spark, tmp_path):
    rnd = random.Random(8)
    prose = lambda n: " ".join("".join(rnd.choice("etaoin") for _ in range(rnd.randrange(2, 7))) for _ in range(n))
    own = [prose(60) for _ in range(6)]
    rows = [(None, own[0]), (None, own[1]), (None, None), (5, own[2]), (5, own[3]), (5, own[3]), (6, ""), (7, own[0]), (8, own[4]), (9, prose(40_000)), (10, own[5])]
    frame = spark.createDataFrame([(d, t, "en", "web", len(t or ""), 1.5, "x") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _first double, part string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(own[5].split()[5:20]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
        assert name == "pack" or docs.columns == frame.columns
    texts = lambda name: sorted(((r.doc_id, r.text) for r in seen[name]), key=repr)
    assert texts("near_dedup") == texts("suffix_dedup") == sorted({(d, t) for d, t in rows if t and d != 7}, key=repr)
    cut = {r.doc_id: r for r in seen["decontaminate"]}
    assert len(cut[10].text) < len(own[5]) and cut[10].n_chars == len(cut[10].text) and cut[9].text == rows[9][1]
    assert sorted({r.doc_id for r in seen["pack"]}, key=repr) == [10, 5, 8, 9, None]
    spark.createDataFrame([], frame.schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
