import os
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpus_rows import prose  # noqa: E402

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) or (doc_id, text, source) rows."""
    def make(rows, partitions=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "web", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(partitions)

    return make


@pytest.fixture(scope="session")
def odd_docs(docs_of):
    """Nulls, empty, blank and very long texts, repeated rows, and columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    long_text = prose(1, 30_000)
    rows = [(None, None, None), (None, "a b c d e f g"), (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, long_text), (6, long_text),
            (7, prose(2, 50)), (7, prose(2, 50)), (8, prose(2, 50).upper()), (9, "x\ny\nz\nx\ny\nz"), (10, "é ü ok", "b")]
    return docs_of(rows).withColumns({c: F.lit(c) for c in ("size", "key", "digest", "kept", "ids", "n", "shard", "score", "part", "node")})
