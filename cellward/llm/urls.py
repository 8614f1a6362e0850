"""URL filters: rules of (host, path, verdict) judged by joins on short hash prefixes.

Each URL is expanded into its host suffixes (whole labels) times the prefixes of its path, each
expression is hashed, and the first 32 bits of the digest, a whole number, meet the rules' in an equi-join.
What meets is confirmed by the full digest, after the join, so that the number is the only key. Of the rules that fit, the longest wins (host and path
together, then the longer host, then the verdict by name).

Only shapes that a rule can have are expanded: suffixes of at most as many labels as a rule's host
and path prefixes of the lengths which rules' paths have, so a hostile URL cannot blow up. Of the rules only
those distinct lengths come to the driver; everything else stays a distributed table, and
Spark broadcasts it only while it is small. A URL also has a row of its own, which keeps URLs
that meet nothing; its key is a negative number from the URL's hash, so these rows spread evenly.

Defined results: a null url, or one without ``://``, has an empty host and path and fits no rule;
repeated rows stay repeated; a null ``page_id`` is kept; rules with a null host or path are left
out, repeated rules count once; without rules every URL gets the default; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellward.llm.common import table

PREFIX = 8
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def ascii_lower(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def short(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, PREFIX), 16, 10).cast("long")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``(page_id, url, host, path, rule, verdict)``; ``rules``: host, path, verdict."""
    whole = F.concat("host", F.lit(" "), "path")
    known = rules.where("host IS NOT NULL AND path IS NOT NULL").select(
        F.length(F.concat("host", "path")).alias("chars"),
        F.length("host").alias("host_chars"),
        "verdict",
        F.concat("host", "path").alias("rule"),
        F.sha2(whole, 256).alias("rule_digest"),
        short(F.sha2(whole, 256)).alias("short"),
        F.size(F.split("host", r"\.")).alias("labels"),
        F.length("path").alias("path_chars"),
    )
    shape = known.agg(F.max("labels"), F.sort_array(F.collect_set("path_chars"))).first()
    most_labels, lengths = shape[0] or 0, [int(n) for n in shape[1]]

    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(most_labels, 1)))),
        lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n),
    )
    prefixes = F.transform(
        F.filter(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>"), lambda n: n <= F.length("path")),
        lambda n: F.substring(F.col("path"), F.lit(1), n),
    )
    digests = F.flatten(
        F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.sha2(F.concat(s, F.lit(" "), p), 256)))
    )
    expanded = split.select("*", F.explode(F.concat(F.array(F.lit("")), digests)).alias("digest"))
    itself = -1 - F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 31))
    expanded = expanded.withColumn("key", F.when(F.col("digest") == "", itself).otherwise(short(F.col("digest"))))
    met = expanded.join(known.drop("labels", "path_chars").distinct(), F.col("key") == F.col("short"), "left")
    # the confirmation stands behind the join, where it cannot become a second key
    fits = F.when(F.col("digest") == F.col("rule_digest"), F.struct("chars", "host_chars", "verdict", "rule"))
    judged = met.groupBy("page_id", "url", "host", "path").agg(
        F.max(fits).alias("best"), F.count_if(F.col("digest") == "").alias("copies")
    )
    rows = judged.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return rows.select(
        "page_id", "url", "host", "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM VALUES {', '.join(map(repr, RULES))} AS r(host, path, verdict)")
    judged = judge_urls(table(spark, sf_dir, "pages"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = r"""
WITH r(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), p AS (
  SELECT page_id, row_number() OVER () AS n,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), f AS (
  SELECT n, max(struct_pack(a := length(r.host || r.path), b := length(r.host), v := verdict, rule := r.host || r.path)) AS best
  FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY n
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.v, 'allow') AS verdict
FROM p LEFT JOIN f USING (n)
"""
