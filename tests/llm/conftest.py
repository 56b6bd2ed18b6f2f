import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, row_ string"


@pytest.fixture
def docs(spark):
    """A documents table from texts or (doc_id, text) pairs, with columns whose names clash with the operators' own."""

    def make(rows, langs=None):
        rows = [(i, r) if r is None or isinstance(r, str) else r for i, r in enumerate(rows)]
        langs = langs or ["en"] * len(rows)
        return spark.createDataFrame([(i, t, lang, f"s{(i or 0) % 3}" if i != 3 else None, None if t is None else len(t), "x", "y") for (i, t), lang in zip(rows, langs)], DOCS)

    return make
