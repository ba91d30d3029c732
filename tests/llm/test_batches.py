from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from touchstone.llm.common import small_batches


def test_a_batch_holds_few_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield pd.DataFrame({"rows": [len(batch)], "size": [int(batch["text"].str.len().sum())]})

    small_batches(spark)
    docs = spark.range(0, 24, 1, 1).select(F.repeat(F.lit("x"), 1 << 19).alias("text"))
    found = docs.mapInPandas(sizes, "rows BIGINT, size BIGINT").collect()
    assert sum(r["rows"] for r in found) == 24
    assert max(r["size"] for r in found) <= 5 << 20
