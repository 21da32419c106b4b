"""Tables between stages go when their scope ends."""

from pathlib import Path

import pytest

from lodestone.operators import bm25
from lodestone.sources.scratch import settle, temporary


def test_a_scope_deletes_what_was_written_in_it(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, "two three")], "id long, text string")
    queries = spark.createDataFrame([(1, "two three")], "query_id long, text string")
    with temporary(spark) as folder:
        found = bm25.search(docs, queries).collect()
        own = Path(folder.removeprefix("file://"))
        assert len(found) == 2 and any(own.iterdir())
    assert not own.exists()
    outside = settle(docs, "outside")
    assert outside.count() == 2


def test_a_scope_ends_with_an_error_too(spark):
    with pytest.raises(ZeroDivisionError), temporary(spark) as folder:
        settle(spark.range(3), "x")
        raise ZeroDivisionError
    assert not Path(folder.removeprefix("file://")).exists()
