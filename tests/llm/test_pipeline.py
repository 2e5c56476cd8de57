import pytest

pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, th string, fp long, hits string, copies int, gone_h long, row string, score double, shard int"


def test_stages_follow_one_another(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, counts = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert {r["doc_id"] for r in docs.select("doc_id").collect()} <= before
        counts.append(docs.count())
        if k < len(pipeline.STAGES) - 1:
            assert docs.columns == names, name
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] and counts[4] == counts[5]
    assert {"doc_id", "shard", "slot"} <= set(docs.columns)


def odd_documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, extreme ids and columns with clashing names."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    calm = " ".join(f"calm{i}" for i in range(60))
    texts = [(1, calm), (1, calm), (1, "quite another text of a few words"), (None, None), (None, "one more text that has no number"), (2, ""), (3, None), (4, f"before {item} after"), (None, f"here {item} there"), (-(1 << 63), calm + " more"), ((1 << 63) - 1, "word " * 30_000)]
    rows = [(i, t, None if k % 3 else "en", None if k % 4 == 0 else f"s{k % 2}", None if k % 2 else 5, "x", 7, None, 3, 1, "row", 0.5, 9) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, CLASHING)


@pytest.mark.parametrize("k", range(len(pipeline.STAGES)))
def test_stage_on_odd_documents(spark, k):
    name, stage = pipeline.STAGES[k]
    docs = odd_documents(spark)
    out = stage(spark, docs, SF)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.collect())
    every = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in docs.collect())
    low, high = -(1 << 63), (1 << 63) - 1
    if k < len(pipeline.STAGES) - 1:
        assert out.schema.names == docs.schema.names
    if name == "toxicity":
        assert set(got) <= set(every) and {(False, 2), (False, 3)} <= set(got)
    elif name == "simhash":
        assert got == sorted([(False, low), (False, 1), (True, 0), (False, 2), (False, 4), (False, high)] + ([(True, 0)] if got.count((True, 0)) == 2 else []))
    elif name == "decontamination":
        gone = list(every)
        gone.remove((False, 4))
        gone.remove((True, 0))
        assert got == gone
    elif name == "mixing":
        assert set(got) <= set(every) and max(got.count(x) for x in got) <= 3 * max(every.count(x) for x in every)
    else:
        assert got == every and all(r["law"] == "bytes" and 0 <= r["shard"] < 8 for r in out.collect())
    assert stage(spark, docs.where("false"), SF).count() == 0


def test_run_leaves_only_the_last_stage(spark):
    from sievework.llm.common import shared_folder

    out = pipeline.run(spark, SF)
    assert out.count() > 0 and shared_folder(spark)
    left = {f.split("/pipeline-")[1].split("/")[1] for f in out.inputFiles()}
    assert left == {str(len(pipeline.STAGES) - 1)}
