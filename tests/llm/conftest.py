"""Small tables for the training-data operators."""

import pytest

# Extra columns bear names that the operators use inside.
EXTRA = ("key", "row", "doc", "sid", "n", "line", "site", "range", "place", "size", "at",
         "shard", "head", "content", "tail", "_doc", "hits", "items")


@pytest.fixture(scope="session")
def documents(spark):
    """Makes ``documents`` of (doc_id, text[, source]) with clashing columns."""
    def make(rows, extra=EXTRA):
        schema = "doc_id bigint, text string, source string" + "".join(f", `{c}` string" for c in extra)
        full = [(*r, "s")[:3] + ("x",) * len(extra) for r in rows]
        return spark.createDataFrame(full, schema)
    return make
