"""Structured Streaming jobs: the two-table pipeline and the periodic document ingest."""

from tickloom.streaming.ingest import ingest_documents
from tickloom.streaming.pipeline import (
    PipelineConfig,
    run_available,
    run_caught_up,
    start_aggregates,
    start_pipeline,
    start_raw,
    supervise,
)
from tickloom.streaming.progress import BatchLog, totals
from tickloom.streaming.replay import late_rows, lost_files, open_windows, with_batches

__all__ = [
    "BatchLog",
    "PipelineConfig",
    "ingest_documents",
    "late_rows",
    "lost_files",
    "open_windows",
    "run_available",
    "run_caught_up",
    "start_aggregates",
    "start_pipeline",
    "start_raw",
    "supervise",
    "totals",
    "with_batches",
]
