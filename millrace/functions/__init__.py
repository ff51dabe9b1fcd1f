"""Column functions, element types and metrics."""

from .metrics import Counter, Distribution, Metrics, measure
from .text import byte_length, extract_words, is_blank, split_lines
from .types import spark_type

__all__ = [
    "Counter", "Distribution", "Metrics", "byte_length", "extract_words", "is_blank", "measure", "spark_type",
    "split_lines",
]
