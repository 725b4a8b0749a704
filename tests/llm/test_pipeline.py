"""Each stage on its own input against brute force, then all of them."""

from collections import Counter

import corpus_pipeline as pipeline
import pytest
from llm_cases import ODD

from heddle.llm import pii, simhash, toxicity

STAGES = dict(pipeline.STAGES)


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")


def corpus():
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)]
    rows = []
    for i in range(400):
        text = [words[(i * 37 + k * k * (1 + i % 11)) % 300] for k in range(60)]
        if i % 4 == 0:
            text[5] = text[30] = "idiot"
        rows.append((i, " ".join(text), f"s{i % 5}"))
    return rows + [(500, "mail me at x@y.org today " + "filler word " * 20, "s1")]


def test_order_and_count():
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "personal_data", "mixing", "packing"]


@pytest.mark.parametrize("name", ["toxicity", "near_duplicates", "personal_data", "mixing"])
def test_columns_and_odd_rows(spark, save, documents, labels, name):
    docs = documents(ODD)
    folder = save(documents=docs, labels=labels)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = STAGES[name](spark, docs, folder)
    assert got.columns == docs.columns
    rows = got.collect()
    if name == "near_duplicates":
        assert Counter(r["text"] for r in rows) == Counter({t for _, t, _ in ODD if t not in ("", None, "  \t\n ")}) + Counter([None])
    elif name == "mixing":
        assert {r["doc_id"] for r in rows} >= {2, 3, 4}
    else:
        assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((i, t) for i, t, _ in ODD)
    empty = docs.limit(0)
    assert STAGES[name](spark, empty, folder).collect() == []


def test_packing_takes_odd_rows(spark, save, documents):
    folder = save(documents=documents(ODD))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = STAGES["packing"](spark, docs, folder).collect()
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter(i for i, _, _ in ODD)
    assert max(r["offset"] + r["length"] for r in rows) <= 1024
    assert STAGES["packing"](spark, docs.limit(0), folder).collect() == []


def test_toxic_documents_go_and_others_stay(spark, save, documents, labels):
    folder = save(documents=documents(corpus()), labels=labels)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r["doc_id"] for r in STAGES["toxicity"](spark, docs, folder).collect()}
    assert kept == {i for i, _, _ in corpus() if i % 4 or i == 500}


def test_one_document_of_each_component_stays(spark, save, documents, labels):
    rows = corpus() + [(600 + i, corpus()[i][1], "s9") for i in range(10)]
    folder = save(documents=documents(rows), labels=labels)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [r["doc_id"] for r in STAGES["near_duplicates"](spark, docs, folder).collect()]
    found = simhash.representatives(docs.select("doc_id", "text")).collect()
    assert sorted(kept) == sorted(r["doc_id"] for r in found) and not set(kept) & set(range(600, 610))


def test_personal_data_is_covered(spark, save, documents, labels):
    folder = save(documents=documents(corpus()), labels=labels)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = {r["doc_id"]: r for r in STAGES["personal_data"](spark, docs, folder).collect()}
    assert got[500]["text"].startswith("mail me at [EMAIL] today") and got[500]["n_chars"] == len(got[500]["text"])
    assert all(got[i]["text"] == t for i, t, _ in corpus() if i != 500)
    assert pii.redact("ab cd ef", [("ip", 3, 5), ("card", 4, 8)]) == "ab [IP]"


def test_mix_repeats_whole_documents(spark, save, documents, labels):
    folder = save(documents=documents(corpus()), labels=labels)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = STAGES["mixing"](spark, docs, folder).collect()
    texts = {i: t for i, t, _ in corpus()}
    taken = Counter()
    for r in got:
        assert r["text"] == texts[r["doc_id"]]
        taken[r["source"]] += len(r["text"].split())
    total = sum(len(t.split()) for t in texts.values())
    weights = {f"s{k}": 1 + k % 3 for k in range(5)}
    for s, w in weights.items():
        assert abs(taken[s] - total * w / sum(weights.values())) <= 60
    assert max(Counter(r["doc_id"] for r in got).values()) <= 3


def test_whole_run(spark, save, documents, labels):
    folder = save(documents=documents(corpus()), labels=labels)
    rows = pipeline.run(spark, folder).collect()
    assert rows and not {r["doc_id"] for r in rows} & {i for i in range(0, 400, 4)}
    assert max(r["offset"] + r["length"] for r in rows) <= 1024


def test_threshold_is_the_query_s():
    assert toxicity.THRESHOLD == 0.7
