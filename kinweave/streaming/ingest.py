"""Articles as a stream: each micro-batch is one commit of the store, at most once by its id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from kinweave.plans.engine import Engine


def ingest(articles: DataFrame, engine: Engine, *, name: str, checkpoint: str, sentences_per_chunk: int | None = None, max_parallel: int | None = None) -> StreamingQuery:
    """Starts a query over a stream of articles that takes what is there and ends.

    ``max_parallel`` bounds the tasks that ask the client, as in Engine.process. foreachBatch may run a batch again after a failure; the store's log knows the last batch of each name.
    """

    def run(batch: DataFrame, number: int) -> None:
        if not engine.store.has_batch(name, number):
            engine.process(batch, sentences_per_chunk=sentences_per_chunk, max_parallel=max_parallel, batch=(name, number))

    return articles.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
