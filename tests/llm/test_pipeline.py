"""The pipeline's stages on their own inputs."""

import corpus_pipeline
from linkloom.llm import QUERIES, exact_dedup, simhash


def test_stages_on_the_small_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "simhash", "suffix_dedup", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns
        sizes.append(docs.count())
        if name == "exact_dedup":
            assert exact_dedup.exact_groups(docs).filter("NOT kept").count() == 0
        if name == "simhash":
            assert simhash.near_duplicates(docs).filter("doc_id <> component_id").count() == 0
        if name == "suffix_dedup":
            assert docs.count() == before.count()
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3] == sizes[4] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == sizes[4]
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).drop("sequence_id", "offset", "start", "length", "ids_crc32").distinct().collect())) == sorted(map(tuple, packed.drop("sequence_id", "offset", "start", "length", "ids_crc32").distinct().collect()))


def test_stages_with_nulls_further_columns_and_no_rows(spark, sf):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    odd = docs.limit(3).withColumn("text", F.lit(None).cast("string")).unionByName(docs.limit(4).withColumn("doc_id", F.lit(None).cast("long")))
    wide = docs.unionByName(odd).withColumn("chunk", F.lit(1)).withColumn("row", F.lit("r")).withColumn("__key", F.lit("k")).withColumn("fp", F.lit(2.5))
    for rows in (wide, wide.limit(0)):
        now = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, sf).cache()
            assert now.columns == wide.columns and now.filter("row <> 'r' OR `__key` <> 'k' OR fp <> 2.5 OR chunk <> 1").count() == 0
        assert now.filter("text IS NULL").count() == 0
        packed = corpus_pipeline.STAGES[-1][1](spark, now, sf)
        assert packed.filter("start = 0").count() == now.count()
        assert (now.count() == 0) == (rows.count() == 0)


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
