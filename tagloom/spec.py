"""What to ask the model for, and which answers are expected."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

# Markers that appear in coded cells.
NOT_APPLICABLE = "NOT_APPLICABLE"
MISSING_KEY = "ERROR_MISSING_KEY"
BATCH_MISMATCH = "ERROR_BATCH_MISMATCH"
RETRIES_FAILED = "ERROR_ALL_RETRIES_FAILED"

# Names under which the allowed labels of a column x are looked up, best first.
RULE_NAMES = ("valid_{}", "valid_{}s", "{}_valid", "{}_options")


@dataclass(frozen=True)
class PromptSpec:
    """System prompt, coded columns, allowed labels and the defaults of rows that do not apply."""

    columns: tuple[str, ...]
    system_prompt: str = ""
    rules: Mapping[str, Sequence[str]] = field(default_factory=dict)
    defaults: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if not self.columns:
            raise ValueError("a prompt spec needs at least one coded column")
        object.__setattr__(self, "columns", tuple(self.columns))

    @classmethod
    def from_json(cls, text: str) -> PromptSpec:
        raw = json.loads(text)
        return cls(
            columns=tuple(raw.get("columns_to_code", ())),
            system_prompt=raw.get("system_prompt", ""),
            rules=raw.get("validation_rules", {}),
            defaults=raw.get("not_applicable_defaults", {}),
        )

    @property
    def first(self) -> str:
        return self.columns[0]

    @property
    def output_columns(self) -> tuple[str, ...]:
        """Coded columns, then columns that only the defaults fill."""
        return self.columns + tuple(c for c in self.defaults if c not in self.columns)

    def allowed(self, column: str) -> tuple[str, ...]:
        """Allowed labels of a column: the first rule name that exists decides, even when its list is empty."""
        for pattern in RULE_NAMES:
            found = self.rules.get(pattern.format(column.lower()))
            if found is not None:
                return tuple(found)
        return ()
