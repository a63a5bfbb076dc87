"""The pipeline's stages one by one against plain versions, and the whole."""

import pandas as pd
from pyspark.sql import functions as F

import corpus_pipeline
from rooflines.llm import toxicity

from .test_operators import plain_components, plain_dedup, plain_hits


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    cols = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "mixing"]

    one = stages["toxicity"](spark, docs, small).cache()
    scored = toxicity.score_toxicity(docs, spark.read.parquet(f"{small}/labels.parquet"))
    assert {r.doc_id for r in one.collect()} == {r.doc_id for r in scored.where(F.col("score") < toxicity.THRESHOLD).collect()}

    two = stages["line_dedup"](spark, one, small).cache()
    texts = [(r.doc_id, r.text) for r in one.collect()]
    got = two.select("doc_id", F.size(F.split("text", "\n")).alias("n"), F.sha2("text", 256).alias("s")).collect()
    assert {(r.doc_id, r.s) for r in got} == {(i, s) for i, _, _, s in plain_dedup(texts)}

    three = stages["near_duplicates"](spark, two, small).cache()
    texts = [(r.doc_id, r.text) for r in two.collect()]
    assert {r.doc_id for r in three.collect()} == {i for i, (_, c) in plain_components(texts).items() if c == i}

    four = stages["decontamination"](spark, three, small).cache()
    bench = pd.read_parquet(f"{small}/benchmark.parquet")
    hits = plain_hits([(r.doc_id, r.text) for r in three.collect()], list(zip(bench["item_id"], bench["text"], strict=True)))
    assert {r.doc_id for r in four.collect()} == {i for i, w in hits.items() if not w[1]}
    for df in (one, two, three, four):
        assert df.columns == cols
    five = stages["mixing"](spark, four, small).toPandas()
    assert set(five["doc_id"]) <= {r.doc_id for r in four.collect()} and (five.groupby("doc_id").size() == five.groupby("doc_id")["copies"].first()).all()
    whole = corpus_pipeline.run(spark, small).toPandas()
    assert sorted(whole["mix_key"]) == sorted(five["mix_key"])


def test_empty_documents(spark, small, tmp_path):
    spark.read.parquet(f"{small}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{small}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
