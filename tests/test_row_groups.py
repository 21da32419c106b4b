"""Tables of blocks are read without holding many of their rows at once."""

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from lodestone.operators import lists


def test_blocks_of_documents_lie_in_small_row_groups(spark):
    n_docs, n_words = 96, 30000

    def draw(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                own = [f"w{(k * 7919 + i * 104729) % n_words:x}x{k * k % 977:x}" for k in range(n_words)]
                yield pa.RecordBatch.from_pydict({"id": pa.array([i]), "tokens": pa.array([own], pa.list_(pa.string()))})

    counts = lists.counted(spark.range(0, n_docs, 1, 1).mapInArrow(draw, "id long, tokens array<string>"))
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in counts.inputFiles()]
    sizes = [m.row_group(i).total_byte_size for m in files for i in range(m.num_row_groups)]
    assert sum(sizes) > 48 << 20 and max(sizes) < 32 << 20
    assert counts.agg(F.sum(F.size("ids"))).first()[0] == n_docs
