"""Incremental indexing of a stream of documents."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lodespark.config import EngineConfig
from lodespark.functions import models
from lodespark.sources.workspace import Workspace


def index_stream(docs: DataFrame, workspace: Workspace, config: EngineConfig, checkpoint: str, embedder: models.Embedder | None = None) -> StreamingQuery:
    """Indexes every micro-batch of new documents into the workspace until the source is drained.

    A batch that is delivered again adds nothing: it is committed under the name of its stream and number, and the
    manifest holds its documents already.
    """
    stream = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def add(batch: DataFrame, number: int) -> None:
        workspace.index(batch, config, embedder=embedder, batch=f"stream-{stream}-{number}")

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
