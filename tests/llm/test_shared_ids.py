"""Fitting when many rows share a doc_id: bounds hold and no language is lost."""

import zlib

from pyspark.sql import functions as F

from slopeline.llm import language, toxicity

FREE = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1]


def test_no_language_is_lost(spark):
    rows = [(FREE[0], f"kala mala {i} talo", "aa") for i in range(1000)] + [(FREE[1], "same words again", "cc")] * 1000
    rows += [(i, f"der hund und {i} das haus", "bb") for i in FREE[2:60]]
    got = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert got.names == ["aa", "bb", "cc"]


def test_bound_on_rows_holds(spark, monkeypatch):
    seen = []
    docs = spark.createDataFrame([(FREE[0], f"bad word {i}") for i in range(3000)] + [(i, "good word") for i in FREE[1:100]], "doc_id long, text string")
    labels = spark.createDataFrame([(FREE[0], 1)] + [(i, 0) for i in FREE[1:100]], "doc_id long, toxic int")
    real = type(docs).mapInArrow

    def spy(self, *args, **kwargs):
        seen.append((self.count(), self.where("toxic IS NOT NULL").count()))
        return real(self, *args, **kwargs)

    monkeypatch.setattr(type(docs), "mapInArrow", spy)
    model = toxicity.fit(docs, labels, max_rows=50)
    assert seen == [(50, 50)] and len(model.slots) == len(model.values)
    seen.clear()
    few = docs.where(F.col("doc_id") != FREE[0])
    toxicity.fit(few, labels, max_rows=5000)
    assert seen == [(99, 99)]
