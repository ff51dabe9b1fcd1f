"""Event-time windows and sources, alike for batch and streams."""

from .windows import fixed_windows, session_windows, sliding_windows, timed
from .sources import run_available, stream_parquet, stream_text

__all__ = [
    "fixed_windows", "run_available", "session_windows", "sliding_windows", "stream_parquet", "stream_text", "timed",
]
