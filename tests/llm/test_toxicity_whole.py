"""Features, disguises and training rows of op10 are not cut."""

import itertools
import zlib

import numpy as np
from pyspark.sql import functions as F

from heddle.llm import ann, toxicity

TRAINING = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 != 1]


def test_rare_toxic_words_are_learned_beside_many_frequent_clean_ones(spark):
    rng = np.random.default_rng(2)
    common = ["".join(w) for w in itertools.islice(itertools.product("bcdfghklmn", "aeiou", "prstvwxzbc", "aeiou", "dfghk"), 10_300)]
    rows, labels = [], []
    for k, i in enumerate(TRAINING[:60]):
        toxic = int(k < 30)
        words = rng.permutation(common).tolist() + ["zzidiot"] * (toxic and k < 15)
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    weights, _ = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert weights and set(weights) == {"zzidiot ", "zzid", "zzidi", "zzidio"}


def test_long_disguises_are_read_whole():
    texts = ["the idiot and the moron were here with a worthless loser and other clown people"] * 9
    restorer = toxicity.Restorer(toxicity.CharModel(toxicity.trigram_counts(texts, toxicity.code_table())))
    assert restorer.reading("id" + "i" * 70 + "ot") == "idiot"
    sentence = "theidiotandthemoronwereherewithaworthlessloserandotherclownpeople"
    for sep in " .":
        found = restorer.reading(sep.join(sentence * 50))
        assert found.replace(" ", "") == sentence * 50
        assert all(found.count(w) == 50 for w in ("idiot", "moron", "worthless", "loser", "clown", "people"))


def test_training_rows_are_counted_as_they_are_filtered(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_ROWS", 50)
    labels = spark.range(150).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic"))
    labels = labels.union(spark.range(9000).select(F.lit(3).alias("doc_id"), F.lit(1).alias("toxic")))
    assert toxicity.training_rows(labels).count() == 50


def test_sample_of_a_table_of_copies(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE", 50)
    rows = spark.range(9000).select(F.array((F.col("id") % 100).cast("float")).alias("vec"))
    assert ann.sampled(rows).count() == 50
