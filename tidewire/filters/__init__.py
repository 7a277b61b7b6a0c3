"""The display filter language: text to a checked expression to a Column."""

from tidewire.filters.compiler import compile_filter, flat_filter  # noqa: F401
from tidewire.filters.language import FilterError, parse  # noqa: F401
