"""The logical query: what to find, where, and how much of it."""

from __future__ import annotations

from dataclasses import dataclass, field


class InvalidPattern(ValueError):
    """The pattern is not a regular expression of the supported dialect."""


class UnsupportedRegex(InvalidPattern):
    """Valid elsewhere, but not in this dialect: look-around, back-references and the like."""


@dataclass(frozen=True)
class SearchOptions:
    """max_matches 0 means all. file_pattern is a glob over paths; * and ? cross /."""

    case_sensitive: bool = True
    max_matches: int = 0
    context_lines: int = 0
    file_pattern: str | None = None

    def __post_init__(self):
        if self.max_matches < 0 or self.context_lines < 0:
            raise ValueError("max_matches and context_lines are 0 or more")


@dataclass(frozen=True)
class Query:
    pattern: str
    is_regex: bool = False
    options: SearchOptions = field(default_factory=SearchOptions)

    def __post_init__(self):
        if not self.pattern:
            raise ValueError("the pattern is empty")
