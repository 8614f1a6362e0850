"""Privacy-guarded analytics on Spark.

Two families of DataFrame operators:

* *guarded data work*: de-identified views of person-level tables and grouped queries whose
  cells survive only when they cover enough distinct persons;
* *query-log audit*: verdicts, violations, audit records and alerts for tables or streams of
  submitted SQL text.

Everything is built from DataFrame, SQL and Structured Streaming operators.
"""

from cellward.policy import ConfigError, GuardError, Policy, load_policy

__all__ = ["ConfigError", "GuardError", "Policy", "load_policy"]
