"""The rules that parameterise every operator (they become literals in the plan)."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace
from pathlib import Path

# Layer names in the order in which a query meets them. ``system`` comes last so
# that a query which breaks another rule keeps that rule's code.
LAYERS = ("ascii_input", "schema", "phi", "aggregation", "enforcement", "system")
DEFAULT_LAYERS = LAYERS

# The smallest publishable cell, and the name of the mandatory count.
MIN_PATIENT_COUNT = 20000
COUNT_ALIAS = "Count_Patients"
PERSON_COLUMN = "person_id"


class ConfigError(ValueError):
    """A policy or vocabulary file that cannot be used (code E801)."""

    code = "E801"

    def __init__(self, path, reason):
        super().__init__(f"E801 configuration {path}: {reason}")
        self.path, self.reason = str(path), reason


class GuardError(ValueError):
    """A query or a call that the guard refuses; carries the verdict's code."""

    def __init__(self, code, message, details=None):
        super().__init__(f"{code} {message}")
        self.code, self.message, self.details = code, message, details or {}


@dataclass(frozen=True)
class Policy:
    min_cell: int = MIN_PATIENT_COUNT
    layers: tuple[str, ...] = DEFAULT_LAYERS
    strict: bool = True  # also prohibit the columns which only the clinical catalog marks
    plain_group_by: bool = False  # also refuse expressions and ordinals as group items
    strict_mode: bool = False  # refuse what is otherwise only marked: texts of over max_query_length
    max_query_length: int = 10000
    max_errors: int | None = 1  # violations reported per query; None = all
    verbosity: int = 3  # 1 message, 2 + guidance, 3 + pattern and link
    retention_days: int = 2190
    alert_threshold: int = 10
    max_rows: int | None = None  # size limit of a guarded result
    scan_output: bool = True  # a guarded result with a cell that is not printable ASCII is withheld
    # what answers and audit records show
    include_examples: bool = True
    include_links: bool = True
    include_query_hash: bool = True
    include_user: bool = True

    def __post_init__(self):
        unknown = [name for name in self.layers if name not in LAYERS]
        if unknown:
            raise ConfigError("policy", f"unknown layers {unknown}")
        # layers always run in the fixed order, however they were listed
        object.__setattr__(self, "layers", tuple(n for n in LAYERS if n in self.layers))

    def only(self, *layers):
        return replace(self, layers=tuple(layers))


def read_config(path):
    """A YAML or JSON file as a dict; anything else is E801."""
    path = Path(path)
    try:
        text = path.read_text(encoding="utf-8")
    except OSError as error:
        raise ConfigError(path, error.strerror or "cannot be read") from error
    try:
        if path.suffix == ".json":
            loaded = json.loads(text)
        else:
            try:
                import yaml
            except ImportError as error:
                raise ConfigError(path, "YAML support is not installed; use JSON") from error
            loaded = yaml.safe_load(text)
    except ConfigError:
        raise
    except Exception as error:  # the parsers raise many types
        raise ConfigError(path, str(error)) from error
    if not isinstance(loaded, dict):
        raise ConfigError(path, "expected a mapping at the top level")
    return loaded


# Where a deployment file keeps each policy field.
_FILE_KEYS = {
    "min_cell": ("security", "min_patient_count"),
    "layers": ("security", "enabled_layers"),
    "strict_mode": ("security", "strict_mode"),
    "max_query_length": ("performance", "max_query_length"),
    "max_errors": ("error_handling", "max_errors_returned"),
    "verbosity": ("educational", "verbosity"),
    "retention_days": ("audit", "retention_days"),
    "alert_threshold": ("monitoring", "failure_alert_threshold"),
    "include_examples": ("educational", "include_examples"),
    "include_links": ("educational", "include_documentation_links"),
    "include_query_hash": ("audit", "include_query_hash"),
    "include_user": ("audit", "include_user_info"),
}


def load_policy(path, **overrides):
    """Policy from a deployment file; fields it leaves out keep their defaults."""
    config = read_config(path)
    values = {}
    for name, (section, key) in _FILE_KEYS.items():
        found = (config.get(section) or {}).get(key)
        if found is None:
            continue
        if name == "layers":
            # the output check runs on results (scan_output_ascii), not on query text
            values[name] = tuple(n for n in found if n != "ascii_output") + ("system",)
        elif isinstance(getattr(Policy, name), bool):
            if not isinstance(found, bool):
                raise ConfigError(path, f"{section}.{key} must be true or false")
            values[name] = found
        elif isinstance(found, bool) or not isinstance(found, int) or found < 0:
            raise ConfigError(path, f"{section}.{key} must be a non-negative integer")
        else:
            values[name] = found
    values.update(overrides)
    extra = set(values) - {f.name for f in fields(Policy)}
    if extra:
        raise ConfigError(path, f"unknown policy fields {sorted(extra)}")
    return Policy(**values)
