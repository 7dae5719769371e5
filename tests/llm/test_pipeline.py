"""The pipeline's stages on small and odd tables."""

from collections import Counter

import corpus_pipeline
from test_training_operators import ODD, frame  # noqa: F401  (the same odd rows)

SF = "/root/testdata/sf0.001"


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "mixing", "sharding"]


def test_whole(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    kept = [n]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), "test")
        assert docs.columns == columns
        kept.append(docs.count())
    assert kept[0] >= kept[1] >= kept[2] >= kept[3] > 0.8 * n
    bench = [r[0] for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    assert not [t for (t,) in docs.select("text").collect() if any(b in t for b in bench)]
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.count() == kept[-1]
    run = corpus_pipeline.run(spark, SF)
    assert Counter(map(tuple, run.collect())) == Counter(map(tuple, out.collect()))


def test_odd(spark):
    docs = frame(spark, ODD)
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            table = corpus_pipeline.materialize(stage(spark, table, SF), "test")
            assert table.columns == docs.columns
        corpus_pipeline.STAGES[-1][1](spark, table, SF).count()
