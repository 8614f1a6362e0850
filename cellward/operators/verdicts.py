"""Query-log audit: every layer's outcome, the verdict, all violations.

All of it is one narrow stage per query text (no shuffle, no Python): the masked text, its
segments and its names are computed once in their own projections, then read by all rules.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellward.functions import characters as chars
from cellward.functions import messages
from cellward.functions import statements as st
from cellward.policy import Policy
from cellward.sources.catalog import catalog_columns
from cellward.sources.guidance import with_guidance
from cellward.sources.vocabulary import CODES, DEFAULT, Vocabulary, normal_name

HIT_DDL = (
    "struct<code:string,ordinal:int,clause:string,token:string,position:int,"
    "code_point:int,reason:string>"
)


def read_statements(
    log: DataFrame, vocab: Vocabulary = DEFAULT, query: str = "query", *, policy: Policy | None = None
) -> DataFrame:
    """Add the derived columns (``_text`` ... ``_ids``) that the rules read.

    With a policy, ``_ids`` and ``_lists`` only hold what that policy's rules can object to: names that surely pass
    are left out, and lists are null where the outcome of all rules about them is known without (``_sure``).
    """
    text = log.withColumn("_text", F.coalesce(F.col(query), F.lit("")))
    code = text.withColumns(
        {"_flat": st.flat(F.col("_text")), "_blank": chars.is_blank(F.col("_text"))}
    )
    parts = code.withColumns(
        {"_balanced": st.is_balanced(F.col("_flat")), "_parts": st.segments(F.col("_flat"))}
    )
    found = parts.withColumns(
        {
            "_bound": st.bound_tables(F.col("_parts")),
            "_own": st.common_tables(F.col("_flat")),
            "_by": st.has_group_by(F.col("_flat")),
            "_sure": F.lit(False) if policy is None else st.plain_patient_count(F.col("_parts")),
        }
    )
    lists = st.lists(F.col("_parts"))
    if policy is not None:
        needed = ~F.col("_sure") | ~F.col("_by") | st.groups_person(F.col("_flat"))
        lists = F.when(needed | F.lit(policy.plain_group_by), lists)
    bound = found.withColumns(
        {
            # what the statement's own WITH clause declares is no table
            "_bound": F.when(F.size("_own") == 0, F.col("_bound")).otherwise(
                F.filter("_bound", lambda t: ~F.array_contains("_own", t["name"]))
            ),
            "_own": F.array_union(
                F.array_union(st.aliases(F.col("_flat")), F.col("_own")),
                F.transform("_bound", lambda t: t["name"]),
            ),
            "_lists": lists,
        }
    )
    listed = vocab.prohibited(True)
    keep = None if policy is None else _doubtful(listed)
    return bound.withColumns(
        {
            "_ids": st.identifiers(F.col("_parts"), listed, keep),
            "_counts": st.person_counts(F.col("_lists")),
        }
    )


def _doubtful(listed):
    """Filter of ``identifiers``: names that no rule passes at sight.

    Passed at sight are a column of a table of the statement, written in lower case and alone or with that
    table's name or alias, unless the vocabulary lists it, and a table or a call that it does not list.
    """
    allowed = [f"{t}.{c}" for t, names in catalog_columns().items() for c in names if c not in listed]

    def fits(found):
        last = F.substring_index(found, ".", -1)
        qualified = lambda t: st.among(
            found, F.concat(t["alias"], F.lit("."), last), F.concat(t["name"], F.lit("."), last)
        ) & F.concat(t["name"], F.lit("."), last).isin(*allowed)
        bare = lambda t: F.concat(t["name"], F.lit("."), found).isin(*allowed)
        return F.when(found.contains("."), F.exists("_bound", qualified)).otherwise(F.exists("_bound", bare))

    def doubtful(segment, found):
        name = F.lower(F.substring_index(F.rtrim(found, F.lit("( ")), ".", -1))
        quoted = found.contains('"') | found.contains("`")
        return F.when(
            found.endswith("(") | st.among(segment["clause"], "FROM", "JOIN", "LIMIT"),
            quoted | name.isin(*sorted(listed)),
        ).otherwise(~fits(found))

    return doubtful


_DERIVED = (
    "_text", "_flat", "_blank", "_balanced", "_parts", "_ids", "_lists", "_bound", "_own", "_counts", "_sure", "_by",
)


def drop_derived(df: DataFrame) -> DataFrame:
    return df.drop(*_DERIVED)


def table_names() -> Column:
    """Distinct tables of a statement."""
    return F.array_distinct(F.transform("_bound", lambda t: t["name"]))


def column_uses() -> Column:
    """Distinct names a statement uses as columns (no tables, functions or own aliases), each with the
    tables that could have it: ``(name, homes)``.

    A qualified name belongs to the table that goes by its qualifier. A bare name can belong to
    any table of the statement, and so can one whose qualifier names a nested query; any
    other qualifier names nothing, and its column has no home.
    """
    used = F.filter(
        F.col("_ids"), lambda i: ~i["is_function"] & ~st.among(i["clause"], "FROM", "JOIN", "LIMIT")
    )
    qualifier = lambda token: F.when(
        token.contains("."), normal_name(F.substring_index(F.substring_index(token, ".", -2), ".", 1))
    ).otherwise("")
    named = F.array_distinct(
        F.transform(used, lambda i: F.struct(i["name"].alias("name"), qualifier(i["token"]).alias("of")))
    )
    named = F.filter(named, lambda n: (n["of"] != "") | ~F.array_contains("_own", n["name"]))
    # without a dot no name has a qualifier
    bare = F.array_distinct(F.transform(used, lambda i: i["name"]))
    bare = F.filter(bare, lambda n: ~F.array_contains("_own", n))

    def homes(of):
        # a bare name, nearly every one, can belong to each of them without a look at their names
        own = F.filter("_bound", lambda t: (t["alias"] == of) | (t["name"] == of))
        fit = F.when((F.size(own) == 0) & st.has_subquery(F.col("_flat")), F.col("_bound")).otherwise(own)
        return F.transform(F.when(of == "", F.col("_bound")).otherwise(fit), lambda t: t["name"])

    everywhere = F.transform("_bound", lambda t: t["name"])
    return F.when(
        F.col("_flat").contains("."),
        F.transform(named, lambda n: F.struct(n["name"].alias("name"), homes(n["of"]).alias("homes"))),
    ).otherwise(F.transform(bare, lambda n: F.struct(n.alias("name"), everywhere.alias("homes"))))


# ------------------------------------------------------------------ rules
#
# A rule is a fact column plus SQL text which turns the facts into hits. The facts are a
# projection of their own, so each is computed once however many conditions read it.


def _facts(policy: Policy) -> dict[str, Column]:
    text, code, parts = F.col("_text"), F.col("_flat"), F.col("_parts")

    def unfit(item):
        person = st.names_person(item)
        return person | ~st.is_plain_column(item) if policy.plain_group_by else person

    why = st.unreadable(text, code, F.col("_balanced"))
    if policy.strict_mode:
        longer = F.length(text) > policy.max_query_length
        why = F.coalesce(why, F.when(longer, f"longer than {policy.max_query_length} characters"))
    facts = {
        "ascii_input": {"_position": chars.first_forbidden(text)},
        "schema": {"_tables": table_names(), "_uses": column_uses()},
        "phi": {"_star": st.has_select_star(code)},
        "aggregation": {
            "_count_ok": F.col("_sure") | st.has_patient_count(F.col("_counts")),
            "_wrong": F.when(~F.col("_sure"), st.wrong_patient_count(F.col("_counts"))),
            "_grouped": F.col("_by"),
            "_global": st.is_global_aggregate(code, F.col("_lists"), F.col("_by")),
            "_misplaced": st.misplaced_aggregate(parts),
            "_unfit": F.try_element_at(F.filter(st.group_by_columns(F.col("_lists")), unfit), F.lit(1)),
        },
        "enforcement": {"_cte": st.has_cte(code), "_nested": st.has_subquery(code)},
        "system": {"_why": why},
    }
    return {name: column for layer in policy.layers for name, column in facts[layer].items()}


def _hit(code, *, ordinal="0", clause="null", token="null", position="null", code_point="null",
         reason="null"):
    """SQL text of one hit; the arguments are SQL texts too."""
    return (
        f"named_struct('code', {code}, 'ordinal', int({ordinal}), 'clause', string({clause}), "
        f"'token', string({token}), 'position', int({position}), "
        f"'code_point', int({code_point}), 'reason', string({reason}))"
    )


_NONE = f"cast(array() as array<{HIT_DDL}>)"


def _hits(*options):
    """Array of the hits whose condition holds, in the given (fixed) order."""
    cases = ", ".join(f"CASE WHEN {condition} THEN {hit} END" for condition, hit in options)
    some = " OR ".join(f"({condition})" for condition, _ in options)
    return f"CASE WHEN {some} THEN array_compact(array({cases})) ELSE {_NONE} END"


def _names(names):
    return ", ".join(f"'{n}'" for n in sorted(names)) or "''"


def _prohibited(vocab: Vocabulary, policy: Policy) -> str:
    """The names of a statement that the vocabulary prohibits, in order, with their code.

    ``IN`` over literals is a hash-set lookup. A function's name can only collide with a date
    part (``MONTH(x)``). The reported token is the name as written, without table prefix.
    """
    direct, geographic, dates = (
        _names(vocab.names(c, policy.strict)) for c in ("direct", "geographic", "date")
    )
    everything = _names(vocab.prohibited(policy.strict))
    code = (
        f"CASE WHEN i.name IN ({direct}) THEN '{CODES['direct']}' "
        f"WHEN i.name IN ({geographic}) THEN '{CODES['geographic']}' ELSE '{CODES['date']}' END"
    )
    hit = _hit(code, ordinal="n + 1", clause="i.clause", token="substring_index(i.token, '.', -1)")
    return (
        "transform(filter(_ids, i -> CASE WHEN i.is_function "
        f"THEN i.name IN ({dates}) ELSE i.name IN ({everything}) END), (i, n) -> {hit})"
    )


def prohibited_uses(log: DataFrame, dictionary: DataFrame) -> DataFrame:
    """What a dictionary table prohibits in each distinct text: ``_text`` and its hits, in order.

    ``dictionary`` has ``name`` (normal form), ``category`` and ``allowed``, and may have any number of rows: names of
    texts are rows that join with it, without a hint, so that Catalyst broadcasts it below its
    threshold and shuffles both sides beyond. Only texts with a hit have a row, and only its hits meet in one group.
    """
    date, rank = F.col("category") == "date", F.array_position(F.array(*map(F.lit, CODES)), F.col("category"))
    names = dictionary.where("NOT allowed").groupBy(F.col("name").alias("_listed")).agg(
        F.min_by(F.element_at(F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv]), F.col("category")), rank).alias("code"),
        F.bool_or(date).alias("_date"),
    )
    texts = log.select(F.coalesce("query", F.lit("")).alias("_text")).distinct()
    # also keywords are names, if the dictionary lists them
    parts = texts.withColumn("_flat", st.flat(F.col("_text"))).withColumn("_parts", st.segments(F.col("_flat")))
    ids = F.posexplode_outer(st.identifiers(F.col("_parts"), st.KEYWORDS)).alias("_at", "_id")
    used = parts.select("_text", ids).where("_id IS NOT NULL").select("_text", "_at", "_id.*")
    found = used.join(names, F.col("name") == F.col("_listed")).where("NOT is_function OR _date")
    token = F.substring_index("token", ".", -1).alias("token")
    hits = F.sort_array(F.collect_list(F.struct("_at", "code", "clause", token)))
    return found.groupBy("_text").agg(
        F.collect_set("name").alias("_listed_names"),
        F.transform(
            hits,
            lambda h, n: F.struct(
                h["code"].alias("code"), (n + 1).cast("int").alias("ordinal"), h["clause"].alias("clause"),
                h["token"].alias("token"), F.lit(None).cast("int").alias("position"),
                F.lit(None).cast("int").alias("code_point"), F.lit(None).cast("string").alias("reason"),
            ),
        ).alias("_listed_hits")
    )


def _rules(vocab: Vocabulary | None, policy: Policy) -> dict[str, str]:
    """Without a vocabulary, ``_listed_hits`` and ``_listed_names`` have what a dictionary found."""
    char = "substring(_text, _position + 1, 1)"
    columns = catalog_columns()
    pairs = _names(f"{t}.{c}" for t, names in columns.items() for c in names)
    unknown_tables = (
        f"transform(filter(_tables, t -> t NOT IN ({_names(columns)})), "
        f"(t, n) -> {_hit(repr('E101'), ordinal='n', token='t')})"
    )
    if vocab is None:
        listed = "coalesce(array_contains(_listed_names, u.name), false)"
        prohibited = f"coalesce(_listed_hits, {_NONE})"
    else:
        listed = f"u.name IN ({_names(vocab.prohibited(policy.strict))})"
        prohibited = _prohibited(vocab, policy)
    # columns of unknown tables are not judged, and prohibited names get the more telling code
    unknown_columns = (
        "transform(array_distinct(transform(filter(_uses, u -> "
        f"NOT exists(u.homes, t -> t NOT IN ({_names(columns)}) OR concat(t, '.', u.name) IN ({pairs})) "
        f"AND NOT {listed}), u -> u.name)), "
        f"(c, n) -> {_hit(repr('E102'), ordinal='n + size(_tables)', token='c')})"
    )
    star = _hits(("_star", _hit("'E204'", clause="'SELECT'", token="'*'")))
    return {
        "ascii_input": _hits(
            ("_blank", _hit("'E003'")),
            (
                "NOT _blank AND _position >= 0",
                _hit(
                    f"CASE WHEN ascii({char}) > {chars.LAST_PRINTABLE} THEN 'E001' ELSE 'E002' END",
                    token=char, position="_position", code_point=f"ascii({char})",
                ),
            ),
        ),
        # arrays are joined only where there is something to join
        "schema": f"CASE WHEN exists(_tables, t -> t NOT IN ({_names(columns)})) "
        f"THEN concat({unknown_tables}, {unknown_columns}) ELSE {unknown_columns} END",
        "phi": f"CASE WHEN _star THEN concat({star}, {prohibited}) ELSE {prohibited} END",
        # fixed order: the person count, then the grouping, then the place of aggregates
        "aggregation": _hits(
            ("_wrong IS NOT NULL", _hit("'E303'", token="_wrong")),
            ("_wrong IS NULL AND NOT _count_ok", _hit("'E302'")),
            ("NOT _grouped AND NOT _global", _hit("'E301'", ordinal="1")),
            (
                "_misplaced IS NOT NULL",
                _hit("'E304'", ordinal="2", clause="_misplaced.clause",
                     token="_misplaced.function"),
            ),
            (
                "_unfit IS NOT NULL",
                _hit("'E305'", ordinal="3", clause="'GROUP BY'", token="_unfit",
                     reason="'only columns other than the person key can be group items'"),
            ),
        ),
        "enforcement": _hits(
            ("_cte", _hit("'E402'", clause="'WITH'")), ("_nested", _hit("'E401'", ordinal="1"))
        ),
        "system": _hits(("_why IS NOT NULL", _hit("'E802'", reason="_why"))),
    }


def layer_hits(log: DataFrame, vocab: Vocabulary | DataFrame = DEFAULT, *, policy: Policy = Policy()):
    """Add one array of hits per enabled layer (``_hits_<layer>``), empty when it passes.

    Only the character layer rejects a blank text; the others let it pass. A ``Vocabulary`` becomes part of
    the plan. A dictionary table (``phi_dictionary``, ``merge_dictionaries``) of any size is joined instead, for
    which the log must be a batch.
    """
    if isinstance(vocab, DataFrame):
        listed = prohibited_uses(log, vocab).withColumnRenamed("_text", "_same")
        read = read_statements(log, policy=policy).join(listed, F.col("_text") == F.col("_same"), "left")
        facts, rules = read.withColumns(_facts(policy)), _rules(None, policy)
    else:
        facts = read_statements(log, vocab, policy=policy).withColumns(_facts(policy))
        rules = _rules(vocab, policy)
    made = {}
    for name in policy.layers:
        rule = rules[name]
        if name != "ascii_input":
            rule = f"CASE WHEN _blank THEN {_NONE} ELSE {rule} END"
        made[f"_made_{name}"] = F.expr(rule)
    # A one-element generator: a filter on the outcome (say, only failures) then reads the hits instead of being
    # pushed below them with a second copy of all rules. The hits are a projection of their own, because
    # what stands in a generator is interpreted.
    fields = ", ".join(f"'_hits_{name}', _made_{name}" for name in policy.layers)
    hits = f"inline(array(named_struct({fields})))"
    return facts.withColumns(made).select(*log.columns, F.expr(hits))


# ------------------------------------------------------------------ outcomes


def layer_results(log: DataFrame, vocab: Vocabulary | DataFrame = DEFAULT, *, policy: Policy = Policy()):
    """First code of every layer on its own (null = passed): columns ``<layer>_code``."""
    hits = layer_hits(log, vocab, policy=policy)
    first = {
        f"{n}_code": F.try_element_at(F.col(f"_hits_{n}"), F.lit(1))["code"]
        for n in policy.layers
    }
    return hits.withColumns(first).drop(*[f"_hits_{n}" for n in policy.layers])


def _first_hit(policy: Policy) -> Column:
    """The first hit of the first failing layer, as ``(layer, hit)``; null if all pass."""
    options = [
        F.when(
            F.size(F.col(f"_hits_{n}")) > 0,
            F.struct(
                F.lit(n).alias("layer"),
                F.try_element_at(F.col(f"_hits_{n}"), F.lit(1)).alias("hit"),
            ),
        )
        for n in policy.layers
    ]
    return F.coalesce(*options)


def _passed_layers(policy: Policy) -> Column:
    """Layers in front of the failing one."""

    def step(done, name):
        clear, names = done
        clear = clear & (F.size(F.col(f"_hits_{name}")) == 0)
        return clear, [*names, F.when(clear, F.lit(name))]

    _, names = reduce(step, policy.layers, (F.lit(True), []))
    return F.array_compact(F.array(*names))


def verdicts(log: DataFrame, vocab: Vocabulary | DataFrame = DEFAULT, *, policy: Policy = Policy()):
    """One verdict per query: the first failing layer decides. Batch or streaming input.

    Keeps the log's columns and adds ``success, layer, code, message, details, layers_passed,
    total_layers, query_hash`` and the warning ``over_length`` (no code of its own).
    """
    hits = layer_hits(log, vocab, policy=policy)
    decided = hits.withColumns(
        {"_first": _first_hit(policy), "layers_passed": _passed_layers(policy)}
    ).drop(*[f"_hits_{n}" for n in policy.layers])
    return decided.withColumns(
        {
            "success": F.col("_first").isNull(),
            "layer": F.col("_first.layer"),
            "code": F.col("_first.hit.code"),
            "message": F.coalesce(messages.message("_first.hit"), F.lit("All layers passed")),
            "details": messages.details("_first.hit"),
            "total_layers": F.lit(len(policy.layers)),
            "query_hash": st.query_hash(F.coalesce(F.col("query"), F.lit(""))),
            "over_length": F.coalesce(F.length("query"), F.lit(0)) > policy.max_query_length,
        }
    ).drop("_first")


def audit_log(log: DataFrame, vocab: Vocabulary | DataFrame = DEFAULT, *, policy: Policy = Policy()):
    """Verdicts with guidance, as far as the policy's verbosity allows."""
    result = with_guidance(verdicts(log, vocab, policy=policy))
    if policy.verbosity < 3 or not policy.include_examples:
        result = result.drop("correct_pattern")
    if policy.verbosity < 3 or not policy.include_links:
        result = result.drop("documentation")
    if policy.verbosity < 2:
        result = result.drop("guidance")
    return result


def violations(log: DataFrame, vocab: Vocabulary | DataFrame = DEFAULT, *, policy: Policy = Policy()):
    """One row per violated rule: all of a query's hits, or its first ``max_errors``."""
    hits = layer_hits(log, vocab, policy=policy)
    every = F.concat(*[_labelled(name) for name in policy.layers])
    if policy.max_errors is not None:
        every = F.slice(every, 1, policy.max_errors)
    rows = hits.select("request_id", F.posexplode_outer(every).alias("ordinal", "_v"))
    rows = rows.where(F.col("_v").isNotNull())
    return rows.select(
        "request_id",
        F.col("_v.layer").alias("layer"),
        F.col("_v.hit.code").alias("code"),
        "ordinal",
        F.col("_v.hit.clause").alias("clause"),
        F.col("_v.hit.token").alias("token"),
        F.col("_v.hit.position").alias("position"),
        messages.details("_v.hit").alias("details"),
    )


def _labelled(layer: str) -> Column:
    return F.transform(
        F.col(f"_hits_{layer}"), lambda h: F.struct(F.lit(layer).alias("layer"), h.alias("hit"))
    )


def first_violation(violations: DataFrame) -> DataFrame:
    """Back from the exploded form to each request's deciding violation."""
    rest = [c for c in violations.columns if c not in ("request_id", "ordinal")]
    return violations.groupBy("request_id").agg(
        *[F.min_by(c, "ordinal").alias(c) for c in rest]
    )
