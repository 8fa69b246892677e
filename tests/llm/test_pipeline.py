"""The pipeline's stages against what each must do to its own input."""

import random

import pytest

import __spark_entry__ as entry_module
import corpus_pipeline
from tidebar.llm import QUERIES, jaccard

SF = "/root/testdata/sf0.01"


def test_all_queries_are_registered():
    assert {*QUERIES, "pipeline"} <= entry_module.queries().keys()
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(i))
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages_keep_columns_and_clean_documents(stages):
    docs, ruled, graded, distinct, masked, packed = stages
    for kept in (ruled, graded, distinct, masked):
        assert kept.columns == docs.columns
    labels = docs.sparkSession.read.parquet(f"{SF}/labels.parquet")
    sound = docs.join(labels, "doc_id").filter("quality = 1 AND toxic = 0 AND size(split(text, ' ')) > 20")
    ids = [{r.doc_id for r in x.select("doc_id").collect()} for x in (sound, ruled, graded)]
    assert len(ids[0] & ids[1]) >= 0.97 * len(ids[0])
    assert len(ids[0] & ids[2]) >= 0.95 * len(ids[0] & ids[1])
    classes = {r.doc_id: r.class_id for r in jaccard.join(graded).collect()}
    assert sorted(r.doc_id for r in distinct.collect()) == sorted({*classes.values()})
    assert masked.filter("text rlike '@mail[0-9]'").count() == 0
    assert masked.count() == distinct.count()
    assert packed.groupBy("doc_id").sum("length").count() == masked.count()
    assert packed.groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").count() == 0


def test_odd_rows_pass_through(spark, tmp_path):
    r = random.Random(1)
    texts = [" ".join("".join(r.choices("abcdeimnorst", k=5)) for _ in range(60)) + "." for _ in range(6)]
    rows = [(i, t, None, None, None, 1) for i, t in enumerate(texts)] + [(0, texts[0], None, None, None, 1)]
    rows += [(10, None, "en", "s", 0, 1), (11, "", "en", "s", 0, 1), (None, texts[1], "en", "s", 9, 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, __k int"
    docs = spark.createDataFrame(rows, schema)
    for given, expected in ((docs, 7), (docs.filter("false"), 0)):
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(
            f"{tmp_path}/labels.parquet")
        now = given
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
            path = f"{tmp_path}/{expected}-{i}"
            stage(spark, now, str(tmp_path)).write.parquet(path)
            now = spark.read.parquet(path)
            assert now.columns == docs.columns
        assert now.count() == expected
        pieces = corpus_pipeline.packed(spark, now, str(tmp_path)).collect()
        assert len({r.doc_id for r in pieces}) == len({r.doc_id for r in now.collect()})
