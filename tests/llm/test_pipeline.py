"""The pipeline on a small folder: run() against its stages one by one; test_brute.py holds it against loops."""

import os
import tempfile

import pytest

import corpus_pipeline
from tapewright.llm import queries
from test_operators import rows


@pytest.fixture(scope="module")
def folder(spark):
    path = tempfile.mkdtemp(prefix="spark-")
    data = rows(3, 60)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([r[:5] for r in data], schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(r[0], int(i % 7 != 0), 0) for i, r in enumerate(data)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
        out = tempfile.mkdtemp(prefix="spark-") + "/docs"
        docs.write.parquet(out)
        docs = spark.read.parquet(out)
        counts.append(docs.count())
    assert counts[1] < counts[0] and counts[2] == counts[1] and counts[3] <= counts[2]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    whole = corpus_pipeline.run(spark, folder).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, packed)) == sorted(map(key, whole)) and packed


def test_queries_cover_the_thirteen():
    assert [int(n[2:].split("_")[0]) for n in queries.queries()] == list(range(1, 14))
    assert os.path.exists(corpus_pipeline.__file__)
