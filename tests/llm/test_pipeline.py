import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tallygrid.llm import decontaminate, language, minhash, pseudonyms
from tests.llm.test_decontaminate import plain as leaks
from tests.llm.test_minhash import plain as groups

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Documents before and after every stage, written and read again."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    held = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, held[-1], FOLDER).write.parquet(path)
        held.append(spark.read.parquet(path))
    return held


def texts(frame):
    return {r["doc_id"]: r["text"] for r in frame.collect()}


def test_columns_and_order(steps):
    for before, after in zip(steps[:4], steps[1:5]):
        assert after.columns == before.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "MinHash near-dedup", "benchmark decontamination", "PII", "best-fit packing"]


def test_language_keeps_clean_documents(steps):
    before, after = texts(steps[0]), texts(steps[1])
    assert set(before) - set(after) == {d for d, t in before.items() if not any(c.isalpha() for c in t or "")}


def test_near_dedup_agrees_with_brute_force(steps):
    before = list(texts(steps[1]).items())
    assert set(texts(steps[2])) == {d for d, _, _, kept in groups(before, 5) if kept}


def test_decontamination_agrees_with_brute_force(spark, steps):
    before = texts(steps[2])
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    assert set(texts(steps[3])) == set(before) - {d for d, _ in leaks(before.items(), items)}


def test_personal_data_goes(steps):
    before, after = texts(steps[3]), texts(steps[4])
    assert set(before) == set(after)
    found = {r["doc_id"] for r in pseudonyms.pseudonymise(steps[3], key=pseudonyms.SAMPLE_KEY, found="f").where("size(f) > 0").collect()}
    assert {d for d in before if before[d] != after[d]} == found


def test_packing_takes_all(spark, steps):
    assert {r["doc_id"] for r in steps[5].collect()} == set(texts(steps[4]))
    assert corpus_pipeline.run(spark, FOLDER).count() == steps[5].count()


def test_edges(spark, edge_docs):
    docs = edge_docs
    labelled = docs.unionByName(docs.sparkSession.createDataFrame(
        [(100 + i, "the plain words of a text", "en", "s", *["x"] * 16) for i in range(8)], docs.schema))
    for name, stage in corpus_pipeline.STAGES[:4]:
        labelled = stage(spark, labelled, FOLDER)
        assert labelled.columns == docs.columns, name
    rows = labelled.collect()
    assert [r["doc_id"] for r in rows].count(100) == 1 and None in {r["doc_id"] for r in rows}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), FOLDER).count() == 0, name


def test_texts_that_share_an_id_stay(spark):
    """Unlike texts of one id are documents of their own; equal rows are one; a near copy goes, whatever its id."""
    def words(seed, n=60):
        dice = random.Random(seed)
        return [f"w{dice.randrange(10**6)}" for _ in range(n)]
    a, b, c = (" ".join(words(k)) for k in range(3))
    near = " ".join(words(0)[:-1] + ["other"])
    rows = [(1, a), (1, b), (1, b), (2, near), (3, c), (3, c + " more"), (4, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    out = sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.keep_one_of_each_group(spark, docs, FOLDER).collect() if r["text"])
    assert [(i, t) for i, t in out if i != 3] == sorted([(1, a), (1, b)]) and [i for i, _ in out].count(3) == 1


def test_names_of_working_columns_may_be_taken(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60)
    extra = {n: F.lit(i) for i, n in enumerate(("_kept", "_lang_pred", "_lang_score", "_found", "_new", "_node_of_text", "_id", "_key", "_node"))}
    held = docs.withColumns(extra)
    for name, stage in corpus_pipeline.STAGES[:4]:
        held = stage(spark, held, FOLDER)
        assert held.columns == [*docs.columns, *extra], name
    assert {tuple(r) for r in held.select(*extra).collect()} == {tuple(range(len(extra)))}


def test_modules_are_those_of_the_operators():
    assert language and minhash and decontaminate and pseudonyms
