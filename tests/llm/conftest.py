from __future__ import annotations

import pytest
from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark: SparkSession):
    """Builds a documents table from texts or (doc_id, text) or (doc_id, text, lang) rows, in three partitions."""

    def build(rows, **more) -> DataFrame:
        full = []
        for i, r in enumerate(rows):
            r = (i, r) if not isinstance(r, tuple) else r
            doc_id, text, lang = r if len(r) == 3 else (*r, "en")
            full.append((doc_id, text, lang, "s", None if text is None else len(text)))
        return spark.createDataFrame(full, DOCS).repartition(3) if full else spark.createDataFrame([], DOCS)

    return build
