"""The pipeline stage by stage against what each operator says, and its guards."""

import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as P  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, small, tmp_path_factory):
    docs, out = spark.read.parquet(f"{small}/documents.parquet"), []
    folder = tmp_path_factory.mktemp("pipeline")
    for i, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, small).write.parquet(f"{folder}/{i}")
        out.append((docs, spark.read.parquet(f"{folder}/{i}")))
        docs = out[-1][1]
    return out


def test_stages_return_the_columns_of_documents(steps):
    assert [d.columns for _, d in steps[:-1]] == [COLUMNS] * 4
    for before, after in steps[:-1]:
        assert after.schema == before.schema or [f.dataType for f in after.schema] == [f.dataType for f in before.schema]
        assert all(r["n_chars"] == len(r["text"]) for r in after.collect())


def test_each_stage_does_its_part(spark, steps, small):
    (docs, rated), (_, lines), (_, unique), (_, cut), (_, packed) = steps
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in rated.collect()}
    good = {i for i, r in labels.items() if r["quality"] == 1 and r["toxic"] == 0}
    assert len(good - kept) <= 0.02 * len(good) and len((set(labels) - good) & kept) <= 0.1 * len(set(labels) - good)
    windows = Counter(w for r in lines.collect() for L in [r["text"].split("\n")] for w in {tuple(L[i : i + 3]) for i in range(len(L) - 2)})
    assert lines.count() == rated.count() and max(windows.values(), default=1) == 1
    from prosemill.llm.jaccard import near_duplicates

    assert near_duplicates(unique).where("n_links > 0").count() == 0 and unique.count() < lines.count()
    words = Counter(tuple(w[i : i + 35]) for r in unique.collect() for w in [r["text"].split()] for i in range(len(w) - 34))
    texts = {r["doc_id"]: r["text"].split() for r in unique.collect()}
    for r in cut.collect():
        own, gone = texts[r["doc_id"]], set()
        for i in range(len(own) - 34):
            if words[tuple(own[i : i + 35])] > 1:
                gone |= set(range(i, i + 35))
        assert r["text"].split() == [w for i, w in enumerate(own) if i not in gone]
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in cut.collect()}


def test_extra_columns_and_repeated_rows_go_through(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(20).selectExpr("*", "1 as kept", "2 as text_key", "3 as spans", "4 as _id")
    docs = docs.unionByName(docs.limit(3))
    for _, stage in P.STAGES[1:4]:
        after = stage(spark, docs, small)
        assert after.columns == docs.columns and after.count() > 0
    assert P.STAGES[2][1](spark, docs, small).groupBy("doc_id").count().where("count > 1").count() == 0


def test_run_is_the_last_stage(spark, small, steps):
    assert P.run(spark, small).count() == steps[-1][1].count()
