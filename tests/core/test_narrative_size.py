"""What the queries of narratives keep and who begins one of them."""

from pyspark.sql import functions as F

from murmuration import catalogue_fusion
from murmuration.operators import timing

MINUTE = 60_000_000


def test_documents_are_kept_once_and_not_by_window(spark, tmp_path, monkeypatch):
    texts = [(k, f"wort{k % 7} rede{k % 3} satz{k}" * 2, "de", "s", 10) for k in range(400)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    kept, real = [], catalogue_fusion.stored
    monkeypatch.setattr(catalogue_fusion, "stored", lambda df: kept.append(out := real(df)) or out)
    rows, terms, _ = catalogue_fusion._narrative(spark, str(tmp_path))
    assert kept and all("text" not in df.columns and "window" not in df.columns and df.count() <= 400 for df in kept)
    assert rows.count() > 400 and terms.select("doc").distinct().count() == 400


def test_who_begins_at_one_time_is_least_by_name_and_others_then_do_not_follow(spark):
    said = [(0, "a", 0, "alt"), (1, "c", 20, "neu"), (1, "b", 20, "neu"), (1, "b", 25, "neu"), (1, "c", 40, "neu"), (1, "d", 41, "neu"), (1, "e", 30, "alt")]
    terms = spark.createDataFrame([(w, a, m * MINUTE, t) for w, a, m, t in said], "window long, author string, us long, term string")
    m = spark.createDataFrame([(0, 1, "PIVOT", 0.5)], "window long, next long, mutation string, cosine double")
    (r,) = timing.mutation_spread(m, terms).collect()
    assert (r.introducer, r.adopted, r.points) == ("b", 1, 70 + 10 + 2)  # c says it again in time, d too late, b leads
    (r,) = timing.mutation_spread(m, terms.filter("term = 'alt'").union(terms.limit(0)).withColumn("window", F.lit(0))).collect()
    assert (r.introducer, r.adopted) == (None, 0)
