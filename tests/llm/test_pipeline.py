"""The pipeline's stages against plain versions of each."""

import hashlib
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from seamline.llm import common, decontaminate, quality, queries, tiktoken_codec
from test_near_dedup import kept_by_brute_force


def test_pipeline_equals_plain_versions(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = queries.table(spark, sf, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = quality.fit(docs, queries.table(spark, sf, "labels"))
    good = {r.doc_id for r in quality.score_documents(docs, model).filter("predicted = 1").collect()}
    rows = sorted((i, t) for i, t in rows if i in good)
    first = {}
    for i, t in rows:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), i)
    rows = [(i, t) for i, t in rows if i in set(first.values())]
    rows = kept_by_brute_force(rows)
    items = [decontaminate.shingles(r.text.encode()) for r in queries.table(spark, sf, "benchmark").collect()]
    rows = [(i, t) for i, t in rows if not any(len(s & decontaminate.shingles(t.encode())) >= 0.8 * len(s) - 1e-9 for s in items)]
    enc = tiktoken_codec.encoding(queries.tokenizer_file("byte_bpe_multi_50k.tiktoken"), queries.split_pattern())
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == {i for i, _ in rows} and len(rows) > 50
    for i, t in rows:
        assert list(got[i].ids) == enc.encode_ordinary(t) and got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_stages_keep_the_columns_and_stand_empty_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = queries.table(spark, sf, "documents")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "SimHash near-dedup", "benchmark decontamination", "byte-level BPE"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.filter("false"), sf).columns == docs.columns
        assert stage(spark, docs.filter("false"), sf).count() == 0


@pytest.mark.parametrize("name", ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "byte-level BPE"])
def test_stages_with_python_code_bound_their_batches(spark, name):
    keys = [f"spark.sql.execution.arrow.{x}" for x in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    for key in keys:
        spark.conf.unset(key)
    before = [spark.conf.get(key) for key in keys]
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents")

    def sizes(batches):
        for b in batches:
            yield b.from_pydict({"rows": [b.num_rows], "size": [b.nbytes]})

    def largest(n, chars):
        texts = spark.range(0, n, 1, 1).select(F.repeat(F.lit("x"), chars).alias("text"))
        return texts.mapInArrow(sizes, "rows long, size long").agg(F.max("rows"), F.max("size"), F.sum("rows")).first()

    try:
        dict(corpus_pipeline.STAGES)[name](spark, docs, "/root/testdata/sf0.001")
        assert largest(3000, 10)[0] == common.BATCH_ROWS
        rows, size, total = largest(600, 100_000)
        assert total == 600 and size <= common.BATCH_BYTES + 2 * 100_000
        spark.conf.set(keys[0], "7")
        dict(corpus_pipeline.STAGES)[name](spark, docs, "/root/testdata/sf0.001")
        assert spark.conf.get(keys[0]) == "7"
    finally:
        for key in keys:
            spark.conf.unset(key)
    assert [spark.conf.get(key) for key in keys] == before
