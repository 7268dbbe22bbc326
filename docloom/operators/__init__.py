"""The store and its tables."""

from .store import DocStore, IndexExists, IndexNotFound, LoadResult, TableNotFound
from .table import DocTable, TypedTable

__all__ = ["DocStore", "DocTable", "IndexExists", "IndexNotFound", "LoadResult", "TableNotFound", "TypedTable"]
