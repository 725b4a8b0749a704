import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, `key` string, kept_id int, toxicity double, m_d int, copy int, fp string"


@pytest.fixture
def save(spark, tmp_path):
    """Writes tables to a folder; returns the folder."""

    def write(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


@pytest.fixture
def documents(spark):
    """(doc_id, text, source) rows with the other columns of documents and columns whose names operators use themselves."""

    def make(rows):
        full = [(i, t, "en", s, None if t is None else len(t), "x", "y", 1, 0.5, 2, 3, "z") for i, t, s in rows]
        return spark.createDataFrame(full, DOCS)

    return make
