"""Pipeline stages act on rows, whatever their ids, against verdicts by text."""

import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import quality, toxicity
from barloom.llm.common import staged

SMALL = "/root/testdata/sf0.001"
BASE = "/root/testdata/sf0.01"


def pairs(df):
    return Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def with_odd_ids(spark, docs, bad, good):
    """Adds a rejected text with null ids, twice with one id, and with the id of a clean text."""
    rows = [(None, bad), (None, bad), (-1, bad), (-1, bad), (-2, bad), (-2, good), (None, good)]
    return staged(docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string")))


def test_quality_and_toxicity_reject_rows(spark):
    docs, labels = spark.read.parquet(f"{BASE}/documents.parquet"), spark.read.parquet(f"{BASE}/labels.parquet")

    def by_quality(d):
        stats = staged(quality.measured(d))
        return quality.scored(stats, quality.learned(stats, labels)), 0

    def by_toxicity(d):
        return toxicity.scored(d, toxicity.learned(d, labels)), 1

    for verdicts, stage in ((by_quality, corpus_pipeline.good_quality), (by_toxicity, corpus_pipeline.not_toxic)):
        out, no = verdicts(docs)
        scores = sorted((r.score, r.doc_id) for r in out.collect())
        bad, good = (scores[0], scores[-1]) if no == 0 else (scores[-1], scores[0])
        texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        odd = with_odd_ids(spark, docs, texts[bad[1]], texts[good[1]])
        out, no = verdicts(odd)
        rejected = {r.doc_id for r in out.where(f"predicted = {no} AND doc_id >= 0").collect()}
        refused = {texts[i] for i in rejected}
        assert texts[bad[1]] in refused and texts[good[1]] not in refused
        want = Counter({k: n for k, n in pairs(odd).items() if k[1] not in refused})
        assert pairs(stage(spark, odd, BASE)) == want


def test_one_row_of_each_group_stays(spark):
    rnd = random.Random(11)
    texts = [" ".join(f"w{rnd.randrange(900)}" for _ in range(40)) for _ in range(6)]
    a, b, c, d, e, f = texts
    rows = [(None, a), (None, a), (None, a), (5, b), (5, b), (5, b), (4, c), (None, c), (3, c + " end"), (6, d), (6, e), (7, e), (8, f), (None, None), (None, None), (9, ""), (9, "")]
    got = pairs(corpus_pipeline.one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string"), ""))
    # texts without words are no duplicates of each other
    assert got == Counter([(None, a), (5, b), (3, c + " end"), (6, d), (6, e), (8, f), (None, None), (None, None), (9, ""), (9, "")])


def test_run_gives_the_same_with_nameless_copies_of_all(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    docs.unionByName(docs.withColumn("doc_id", F.lit(None).cast("long"))).write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter(r.doc_id for r in corpus_pipeline.run(spark, SMALL).collect())
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want
    assert None not in want and len(want) > 0


def test_rows_are_numbered_from_their_files(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("__row", F.lit("own")).withColumn("file_path", F.lit(1))
    rows, name = corpus_pipeline.keyed(staged(docs.repartition(3)))
    assert name == "__row_" and rows.select(name).distinct().count() == rows.count() == docs.count()
    assert sorted(map(str, rows.collect())) == sorted(map(str, rows.collect()))
    kept = corpus_pipeline.one_of_each(spark, staged(docs), SMALL)
    assert kept.columns == docs.columns and kept.where("__row = 'own'").count() == kept.count() > 0
    made, _ = corpus_pipeline.keyed(spark.createDataFrame([(1, "a"), (1, "a")], "doc_id long, text string"))
    assert made.count() == 2
