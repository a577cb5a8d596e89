"""The boundary to language models: a client that answers prompts in batches, and what stands in for an answer that fails."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Prompts handed to a client at once.
BATCH = 64


def with_answers(rows: DataFrame, prompt: str, client: Callable[[], Callable[[list[str]], list[str]]] | None, fallback: Column, out: str = "answer") -> DataFrame:
    """rows with a column `out`: the client's answer to each prompt, or `fallback` where there is no client, no answer or an error.

    client() is called once in each task and returns a function from prompts
    to answers; it may raise, which fails only the batch.  The fallback is an
    expression over the columns of rows, so without a client nothing leaves the JVM.
    """
    if client is None:
        return rows.withColumn(out, fallback)
    given = rows.withColumn("_fallback", fallback)
    schema = StructType([*given.schema.fields, StructField("_answer", StringType())])

    def ask(batches):
        import pandas as pd

        answer = client()
        for batch in batches:
            told: list[str | None] = []
            prompts = ["" if p is None or pd.isna(p) else p for p in batch[prompt]]
            for a in range(0, len(prompts), BATCH):
                part = prompts[a : a + BATCH]
                try:
                    got = list(answer(part))
                    told += got if len(got) == len(part) else [None] * len(part)
                except Exception:  # a model host may fail in any way; the rows keep their fallback
                    told += [None] * len(part)
            yield batch.assign(_answer=pd.Series(told, index=batch.index, dtype=object))

    asked = given.mapInPandas(ask, schema)
    return asked.withColumn(out, F.coalesce(F.nullif("_answer", F.lit("")), "_fallback")).drop("_answer", "_fallback")
