"""Sources: JSON lines, and made-up rows."""

from .generated import distinct_integers, random_documents
from .json_lines import count_lines, read_documents, read_lines

__all__ = ["count_lines", "distinct_integers", "random_documents", "read_documents", "read_lines"]
