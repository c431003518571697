"""Extension: a stream of files into the store, each micro-batch one upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.functions.embed import EmbeddingProvider, embedded
from quarry.operators import manifest as m
from quarry.operators.chunks import Registry, valid
from quarry.operators.store import Store, replace_by_file


def ingest(files: DataFrame, store: Store, registry: Registry, provider: EmbeddingProvider, checkpoint: str) -> StreamingQuery:
    """Upsert a streaming (file_path, mtime, content): the newest version of a path in a batch replaces its chunks.

    A batch that is retried after a failure replaces the same files again, so the store ends the same.
    """

    def upsert(batch: DataFrame, _: int) -> None:
        latest = batch.groupBy("file_path").agg(F.max_by(F.struct("mtime", "content"), F.col("mtime")).alias("f")).select("file_path", "f.*").persist()
        if not latest.isEmpty():
            chunks = valid(registry.chunk(latest.where("content IS NOT NULL").select("file_path", "content")))
            identity = F.substring(F.sha2(F.concat_ws(":", "file_path", "line_start", "line_end", "chunk_type", "name"), 256), 1, 32)
            new = chunks.select(identity.alias("chunk_id"), *chunks.columns, embedded(F.col("content"), provider).alias("vector"))
            store.commit(replace_by_file(store.chunks, new, latest), m.upsert(store.manifest, latest.select("file_path", "mtime")), provider.dimension)
        latest.unpersist()

    return files.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
