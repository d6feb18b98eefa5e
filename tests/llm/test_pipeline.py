"""The pipeline's stages over the smallest table, over awkward and empty tables, and over clashing names."""

import corpus_pipeline
import pytest
from helpers import awkward, awkward_rows, empty

from tallymark.llm import common

STAGES = corpus_pipeline.STAGES


def test_pipeline(spark, data, tmp_path):
    docs, sizes = spark.read.parquet(f"{data}/documents.parquet"), []
    columns = docs.columns
    for i, (name, stage) in enumerate(STAGES[:-1]):
        out = stage(spark, docs, data)
        assert out.columns == columns, name
        out.write.parquet(str(tmp_path / f"{i}"))
        docs = spark.read.parquet(str(tmp_path / f"{i}"))
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    got = STAGES[-1][1](spark, docs, data)
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in docs.collect()}
    rows = lambda df: sorted(tuple(r) for r in df.select("doc_id", "start", "length", "ids_crc32").collect())
    assert rows(corpus_pipeline.run(spark, data)) == rows(got)


def test_stages_of_awkward_and_empty_tables(spark, data):
    clashing = awkward(spark).toDF("doc_id", "text", "DOC_ID", "TEXT", "_score", "_hits", "_nth")
    for name, stage in STAGES:
        for df in (awkward(spark), clashing):
            out = stage(spark, df, data)
            assert name == "packing" or out.columns == df.columns
            assert 0 < out.count() or name == "quality_classifier", name
        assert stage(spark, empty(spark), data).count() == 0, name
    assert stage(spark, awkward(spark), data).select("doc_id").distinct().count() == len({r[0] for r in awkward_rows()})


def test_the_whole_of_an_empty_table(spark, data):
    before = set(_folders(spark))
    assert corpus_pipeline.chained(spark, empty(spark), data).count() == 0
    assert {x for x in _folders(spark) if "pipeline-" in x or "substring-" in x} <= before


def _folders(spark):
    import os

    return os.listdir(common.shared_folder(spark).removeprefix("file:"))


def test_a_cluster_must_name_its_shared_folder():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)  # noqa: N815
        getConf = staticmethod(lambda: {})  # noqa: N815

    class Session:
        sparkContext = Context  # noqa: N815

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        common.shared_folder(Session)
