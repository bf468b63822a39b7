"""Streaming: every column-lane transform is an ordinary DataFrame plan, so a
Dataset over ``spark.readStream`` runs as Structured Streaming unchanged. No
engine operator needs state of its own; see ``stream`` for the entry point."""

from weftline.streaming.stream import stream_parquet

__all__ = ["stream_parquet"]
