"""A corpus pipeline: toxicity, near-duplicates, personal data, mixing, packing.

Every stage takes (spark, docs, sf_dir), works on all documents it is given and
returns documents with their columns; the last returns packed pieces.  run() writes each
stage's result as Parquet into the shared folder and reads it again for the next, so
a lost executor costs one stage at most.

Cases: see the operators.  Columns besides those of documents are carried along
unchanged.  A document without doc_id counts as a document of its text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm import mixing, neardup, packing, pii, toxicity
from heddle.session import cut, shared_dir
from heddle.sources.tables import load


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not use."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold; labels train the classifier."""
    weights, counts = toxicity.fit(docs, load(spark, sf_dir, "labels"))
    score = free_name(docs, "toxicity")
    return toxicity.scores(docs, weights, counts, score).filter(F.col(score) < toxicity.THRESHOLD).drop(score)


def drop_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every component of near copies, the one with the least id; see neardup.

    A document is an id and a text: rows with one id and different texts are different documents, and rows
    equal in both are one.
    """
    key = free_name(docs, "dedup_id")
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")))
    text = free_name(keyed, "dedup_text")
    keyed = keyed.withColumn(text, F.xxhash64("text"))
    first = cut(neardup.representatives(keyed.select(F.col(key).alias("d"), "text")).select(F.col("d").alias("kept_id"), F.col("th").alias("kept_text"), F.col("n").alias("kept_n")))
    once, repeated = first.filter("kept_n = 1"), first.filter("kept_n > 1")
    here = lambda ids: keyed.join(ids, (keyed[key] == ids["kept_id"]) & (keyed[text] == ids["kept_text"]), "left_semi")
    if repeated.isEmpty():
        return here(once).drop(key, text)
    return here(once).union(here(repeated).dropDuplicates([key, text])).drop(key, text)


def redact_personal_data(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.redacted(docs)


MIX_SEED = "corpus-mix-1"


def mix_to_weights(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, the last part of a target rounded to whole documents.

    Documents without words stay once.  Rows that are equal in id, source and text are decided alike.
    """
    identity = lambda: (F.col("doc_id").cast("long"), F.col("source"), F.xxhash64("text"))
    sized = docs.select(
        F.struct(*[c.alias(n) for c, n in zip(identity(), "dst")]).alias("id"),
        F.col("source").alias("src"),
        mixing.words(F.col("text")).alias("size"),
        mixing.order_key(MIX_SEED, F.col("doc_id"), F.col("text")).alias("key"),
    )
    part = F.col("taken") - F.col("whole") * F.col("size")
    copies = F.when(F.col("size") == 0, 1).otherwise(F.col("whole") + F.when((part > 0) & (2 * part >= F.col("size")), 1).otherwise(0))
    decided = mixing.mix(sized).select(F.col("id.d").alias("m_d"), F.col("id.s").alias("m_s"), F.col("id.t").alias("m_t"), copies.cast("int").alias("m_copies"))
    decided = decided.groupBy("m_d", "m_s", "m_t").agg(F.max("m_copies").alias("m_copies")).filter("m_copies > 0")
    d, s, t = identity()
    taken = docs.join(decided, d.eqNullSafe(decided["m_d"]) & s.eqNullSafe(decided["m_s"]) & (t == decided["m_t"]))
    return taken.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), decided["m_copies"])).alias(free_name(docs, "copy"))).select(*docs.columns)


def pack_sequences(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_to_weights),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
