"""A stream of questions against a static index: one search for each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import Index
from ..operators.search import DEFAULTS, SearchConfig, search


def answer(questions: DataFrame, index: Index, out: str, checkpoint: str, config: SearchConfig = DEFAULTS, **trigger) -> StreamingQuery:
    """Results of each micro-batch of the stream questions(qid, d), as Parquet under out/batch=n: a repeated batch overwrites itself."""

    def batch(df: DataFrame, n: int) -> None:
        search(df, index, config).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return questions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
