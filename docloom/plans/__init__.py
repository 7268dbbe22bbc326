"""Plan-time compilation: field paths, predicates, and what fields resolve to."""

from .paths import Path, filter_path, index_path
from .predicates import And, Cond, Not, Or, compile_pair, compile_predicate
from .resolve import TypedResolver, VariantResolver

__all__ = ["And", "Cond", "Not", "Or", "Path", "TypedResolver", "VariantResolver", "compile_pair", "compile_predicate", "filter_path", "index_path"]
