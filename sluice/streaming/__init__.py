from .dedupe import dedupe_messages, dedupe_stream
from .flows import micro_batch, rate_limit, run_changes
from .metrics import ProgressLog, append_progress, component_metrics, observe_rows
from .savepoints import clean_save_points, resolve_start, save_point

__all__ = [
    "ProgressLog", "clean_save_points", "component_metrics", "dedupe_messages", "dedupe_stream", "micro_batch",
    "observe_rows", "rate_limit", "resolve_start", "run_changes", "save_point",
]
