"""Spark-native engine for entity-centric retrieval, QA analytics and corpus preparation."""

from lodespark.config import EngineConfig

__all__ = ["EngineConfig"]
