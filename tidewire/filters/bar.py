"""The filter in force while its text is being edited."""

from __future__ import annotations

from pyspark.sql import Column

from tidewire.filters.compiler import compile_filter
from tidewire.filters.language import FilterError


class FilterBar:
    """state: empty (nothing typed), ready (the text compiles), applied (it is in force) or invalid; error says why. An
    invalid text leaves the filter in force as it was; a blank one clears it."""

    def __init__(self) -> None:
        self.text, self.state, self.applied = "", "empty", ""
        self.error: FilterError | None = None

    def edit(self, text: str) -> str:
        self.text, self.error = text, None
        try:
            compile_filter(text)
            self.state = "empty" if not text.strip() else "applied" if text == self.applied else "ready"
        except FilterError as e:
            self.state, self.error = "invalid", e
        return self.state

    def apply(self) -> bool:
        """Whether the filter in force is now that of the text."""
        if self.state == "invalid":
            return False
        self.applied = self.text if self.text.strip() else ""
        self.state = "applied" if self.applied else "empty"
        return True

    @property
    def column(self) -> Column:
        return compile_filter(self.applied)
