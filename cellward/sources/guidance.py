"""What a rejected query's author is told: one row per code.

Every pattern is itself a query that passes all layers (tested).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellward.session import literal_table

_BY_GENDER = (
    "SELECT gender_concept_id, COUNT(DISTINCT person_id) AS Count_Patients\n"
    "FROM person\nGROUP BY gender_concept_id"
)
_BY_STATE = (
    "SELECT l.state, COUNT(DISTINCT p.person_id) AS Count_Patients\n"
    "FROM person p JOIN location l ON p.location_id = l.location_id\nGROUP BY l.state"
)
_BY_YEAR = (
    "SELECT year_of_birth, COUNT(DISTINCT person_id) AS Count_Patients\n"
    "FROM person\nGROUP BY year_of_birth"
)
_GLOBAL = "SELECT COUNT(DISTINCT person_id) AS Count_Patients\nFROM condition_occurrence"

# Codes and the layer that raises each; documentation addresses per code range.
CODE_LAYERS = {
    "E001": "ascii_input", "E002": "ascii_input", "E003": "ascii_input",
    "E101": "schema", "E102": "schema",
    "E201": "phi", "E202": "phi", "E203": "phi", "E204": "phi",
    "E301": "aggregation", "E302": "aggregation", "E303": "aggregation",
    "E304": "aggregation", "E305": "aggregation",
    "E401": "enforcement", "E402": "enforcement",
    "E801": "system", "E802": "system",
}
DOCUMENTATION = {
    "E0": "https://docs.example.com/validation/ascii-input",
    "E1": "https://docs.example.com/validation/schema",
    "E2": "https://www.hhs.gov/hipaa/for-professionals/privacy/special-topics/"
    "de-identification/index.html",
    "E3": "https://docs.example.com/validation/aggregation",
    "E4": "https://docs.example.com/validation/enforcement",
    "E8": "https://docs.example.com/troubleshooting/system-errors",
}
DOCUMENTATION_OTHER = "https://docs.example.com/validation/overview"
UNKNOWN_GUIDANCE = "Unknown error code"

# Own wording: code -> (guidance, a pattern that works)
TEXTS = {
    "E001": (
        "The text holds non-ASCII characters. Look-alike and invisible characters are a known "
        "road to SQL injection, so only plain ASCII is read. Retype the marked character.",
        _BY_GENDER,
    ),
    "E002": (
        "The text holds a control character. Tab, newline and carriage return are fine for "
        "layout; delete every other one.",
        _BY_GENDER,
    ),
    "E003": ("There is nothing to run. Send the text of one SELECT statement.", _GLOBAL),
    "E101": (
        "A table in FROM or JOIN is not part of the approved clinical model. Check its "
        "spelling against the model's table list.",
        _GLOBAL,
    ),
    "E102": (
        "A column does not exist in any table the query reads. Check its spelling against "
        "the model's column list.",
        _BY_GENDER,
    ),
    "E201": (
        "The query touches a direct identifier. None of the 18 HIPAA identifiers - names, "
        "contact data, record, account and device numbers, biometrics and the like - may be "
        "read, filtered on or grouped by. Describe the cohort by coded attributes instead.",
        _BY_GENDER,
    ),
    "E202": (
        "The query uses geography below state level. Group by state, region or country; ZIP "
        "codes are usable only as three digits, and only for areas with more than 20,000 "
        "people.",
        _BY_STATE,
    ),
    "E203": (
        "The query uses a date part finer than the year. Years are fine; months, days and "
        "full dates are not, and ages above 89 count as one group.",
        _BY_YEAR,
    ),
    "E204": (
        "A star pulls in every column, identifiers included. Make the list explicit: name "
        "each column you need.",
        _BY_GENDER,
    ),
    "E301": (
        "Rows about single persons never leave the system. Add a GROUP BY over the selected "
        "columns, or select aggregates only.",
        _BY_GENDER,
    ),
    "E302": (
        "Each result cell needs its number of distinct persons, because cells below the "
        "minimum are withheld. Add COUNT(DISTINCT person_id) AS Count_Patients.",
        _BY_GENDER,
    ),
    "E303": (
        "The person count is there but not in its exact form. It needs DISTINCT, the column "
        "person_id and the alias Count_Patients, upper and lower case included: "
        "COUNT(DISTINCT person_id) AS Count_Patients.",
        _BY_GENDER,
    ),
    "E304": (
        "Aggregates belong in the select list. In WHERE, GROUP BY, HAVING or ORDER BY they "
        "could be used to probe the withheld cells.",
        _BY_GENDER,
    ),
    "E305": (
        "A grouping column is not acceptable. Group by plain, existing columns that identify "
        "nobody - never by the person key or an expression.",
        _BY_GENDER,
    ),
    "E401": (
        "A second SELECT could circumvent the minimum cell size, so subqueries and set "
        "operations are refused. Write one flat statement; joins are fine.",
        _BY_GENDER,
    ),
    "E402": (
        "A WITH clause could circumvent the minimum cell size. Write one flat statement; "
        "joins are fine.",
        _BY_GENDER,
    ),
    "E801": ("A rule file is broken. This is for the administrator, not for you.", None),
    "E802": (
        "The text cannot be read safely as one SELECT statement. Look for a second statement, "
        "an open quote or comment, and unbalanced parentheses.",
        _BY_GENDER,
    ),
}

GUIDANCE_DDL = (
    "code string, guidance string, correct_pattern string, documentation string"
)


def documentation_link(code: Column) -> Column:
    """Address for a code range, an overview page for everything else."""
    link = None
    for prefix, address in DOCUMENTATION.items():
        hit = code.startswith(prefix)
        link = F.when(hit, address) if link is None else link.when(hit, address)
    return link.otherwise(DOCUMENTATION_OTHER)


def guidance_table(spark: SparkSession) -> DataFrame:
    rows = [
        (code, text, pattern, DOCUMENTATION.get(code[:2], DOCUMENTATION_OTHER))
        for code, (text, pattern) in TEXTS.items()
    ]
    return literal_table(spark, rows, GUIDANCE_DDL)


def with_guidance(verdicts: DataFrame, code: str = "code") -> DataFrame:
    """Left join of the guidance; unknown codes get a default, passed rows (null) stay null.

    The table has one row per code of this module, so it is always broadcast.
    """
    table = guidance_table(verdicts.sparkSession).withColumnRenamed("code", "_code")
    joined = verdicts.join(table, F.col(code) == F.col("_code"), "left").drop("_code")
    failed = F.col(code).isNotNull()
    return joined.withColumns(
        {
            "guidance": F.when(failed, F.coalesce("guidance", F.lit(UNKNOWN_GUIDANCE))),
            "documentation": F.when(
                failed, F.coalesce("documentation", documentation_link(F.col(code)))
            ),
        }
    )
