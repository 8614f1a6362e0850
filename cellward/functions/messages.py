"""Details and message of a rule hit, from its struct column (own wording)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellward.policy import COUNT_ALIAS, PERSON_COLUMN
from cellward.sources.catalog import SCHEMA_NAME
from cellward.sources.vocabulary import identifier_type_sql

_EXACT = f"COUNT(DISTINCT {PERSON_COLUMN}) AS {COUNT_ALIAS}"
_TYPE, _SCHEMA = "identifier type", "schema"

# code -> (template, fields of the hit that fill it)
_TEMPLATES = {
    "E001": (
        'Non-ASCII character "%s" (U+%04X) at position %d',
        ("token", "code_point", "position"),
    ),
    "E002": (
        "Control character U+%04X at position %d; only tab, newline and carriage return are "
        "allowed",
        ("code_point", "position"),
    ),
    "E003": ("The query is empty or only whitespace", ()),
    "E101": (f'Table "%s" is not in {SCHEMA_NAME}', ("token",)),
    "E102": (f'Column "%s" is in none of the {SCHEMA_NAME} tables of the query', ("token",)),
    "E201": ('Direct identifier "%s" (%s) in the %s clause', ("token", _TYPE, "clause")),
    "E202": ('Geography below state level: "%s" in the %s clause', ("token", "clause")),
    "E203": ('Date finer than the year: "%s" in the %s clause', ("token", "clause")),
    "E204": ("SELECT * is prohibited; list the columns", ()),
    "E301": ("GROUP BY is missing and the query is no global aggregate", ()),
    "E302": (f"The person count is missing: {_EXACT}", ()),
    "E303": (f'Person count written as "%s"; the exact form is {_EXACT}', ("token",)),
    "E304": ("Aggregate %s in the %s clause; only SELECT may aggregate", ("token", "clause")),
    "E305": ('Cannot group by "%s": %s', ("token", "reason")),
    "E401": ("Subqueries and set operations are not allowed", ()),
    "E402": ("WITH clauses are not allowed", ()),
    "E802": ("Cannot read the statement: %s", ("reason",)),
}

# Keys of the details, the field behind each, and the codes that report it.
_DETAILS = {
    "position": ("position", ("E001", "E002")),
    "character": ("token", ("E001",)),
    "code_point": ("code_point", ("E001", "E002")),
    "table_name": ("token", ("E101",)),
    "schema": (_SCHEMA, ("E101", "E102")),
    "column_name": ("token", ("E102", "E201", "E202", "E203", "E305")),
    "identifier_type": (_TYPE, ("E201",)),
    "found_syntax": ("token", ("E303",)),
    "function": ("token", ("E304",)),
    "reason": ("reason", ("E305", "E802")),
    "clause": ("clause", ("E201", "E202", "E203", "E304")),
}


def _field(hit: str, name: str) -> str:
    if name == _TYPE:
        return identifier_type_sql(f"lower({hit}.token)")
    if name == _SCHEMA:
        return f"'{SCHEMA_NAME}'"
    return f"{hit}.{name}"


def message(hit: str) -> Column:
    """One sentence for the hit in the struct column ``hit``, null if there is none."""
    cases = " ".join(
        f"WHEN '{code}' THEN "
        + f"format_string({', '.join([repr(text), *(_field(hit, f) for f in used)])})"
        for code, (text, used) in _TEMPLATES.items()
    )
    return F.expr(f"CASE {hit}.code {cases} END")


def details(hit: str) -> Column:
    """Facts of a hit as map<string,string>; keys differ by code, empty when there are none."""
    entries = ", ".join(
        f"'{key}', CASE WHEN {hit}.code IN ({', '.join(map(repr, codes))}) "
        f"THEN string({_field(hit, name)}) END"
        for key, (name, codes) in _DETAILS.items()
    )
    return F.expr(
        f"CASE WHEN {hit}.code IS NOT NULL "
        f"THEN map_filter(map({entries}), (k, v) -> v IS NOT NULL) END"
    )
