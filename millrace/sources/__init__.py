"""File listings, text, blobs and synthetic load."""

from .files import EmptyMatch, match_all, match_files, matches, read_matches
from .synthetic import synthetic_ranges, synthetic_source, synthetic_step
from .text import immediate, read_all, read_text, read_with_filename, write_single

__all__ = [
    "EmptyMatch", "immediate", "match_all", "match_files", "matches", "read_all", "read_matches", "read_text",
    "read_with_filename", "synthetic_ranges", "synthetic_source", "synthetic_step", "write_single",
]
