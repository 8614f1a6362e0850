"""Structure of submitted SQL text as Column expressions over a masked copy of it.

There is no parser here: the rules only need to know which names occur, under which clause
keyword, and what the select and group lists look like. ``flat`` removes everything that is
not code, and the other functions take its result.

The patterns use possessive quantifiers and single-level alternations: Java's matcher then
iterates instead of recursing, so a hostile or huge text cannot overflow a task's stack.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellward.functions.characters import collapse, strip, strip_right
from cellward.policy import COUNT_ALIAS, MIN_PATIENT_COUNT, PERSON_COLUMN
from cellward.sources.vocabulary import normal_name

# The aggregate functions the rules know.
AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX", "STDDEV", "VARIANCE")

CLAUSES = (
    "SELECT", "FROM", "JOIN", "ON", "USING", "WHERE", "GROUP BY", "HAVING", "ORDER BY",
    "LIMIT", "UNION", "INTERSECT", "EXCEPT",
)

# Words of SQL that are never column names (the rest of a text's words are identifiers).
KEYWORDS = tuple(
    """select from where group by having order limit offset join inner left right full outer
    cross natural semi anti on using as distinct all and or not in is null like between exists
    case when then else end asc desc nulls true false union intersect except minus with
    cast interval int integer bigint float double string date recursive over partition rows
    range filter any some insert into values update delete set create drop alter table""".split()
)

_QUOTED = r"\"[^\"]*+\"|`[^`]*+`"
# A look at one character in front of the alternatives spares nearly all places the attempt at each of them.
_MASK = rf"(?=['\"`/-])(?:'[^']*+'|({_QUOTED})|--[^\r\n]*+|(?s:/\*.*?\*/))"
# FROM inside a function call - EXTRACT(YEAR FROM d), TRIM(BOTH x FROM y) - starts no clause
_INNER_FROM = r"(?i)(\((?!\s*SELECT\b)\s*[\w.]+(?:\s+[\w.]+)?)\s+FROM\b"
# Two characters tell nearly all places apart before word boundaries and words are looked at.
_CLAUSE_CHARS = "".join(f"[{''.join(sorted({c[i] for c in CLAUSES}))}]" for i in (0, 1))
_CLAUSE_START = rf"(?i)(?={_CLAUSE_CHARS})(?!\A)\b(?=(?:" + "|".join(CLAUSES) + r")\b)"
_ALIAS = rf"(?=AS\s)\bAS\s+(?:\w++|{_QUOTED})"
_IDENTIFIER = rf"(?i)(?=[a-z_.\"`])(?:{_ALIAS}|((?:[A-Za-z_.][\w.$]*+|{_QUOTED})++(?:\s*\()?))"
# Parentheses with the text up to the next one.
_PIECES = r"[()][^()]*+|[^()]++"
# Parentheses only with their partner, none of them inside others, and no comma in any.
_SHALLOW = r"^[^()]*+(?:\([^(),]*+\)[^()]*+)*+\z"
_CALL = r"(?i)(?=[ACMSV])\b(?:" + "|".join(AGGREGATES) + r")\s*\("
# An aggregate's call without parentheses inside.
_PLAIN_CALL = _CALL + r"[^()]*+\)"
# Calls of aggregates, parentheses, words, and what stands between them.
_TOKENS = r"(?i)(?:" + "|".join(AGGREGATES) + r")\s*\(|[()]|[\w$]++|[^\w$()]++"
_CHUNK = 256
_CUT = "\x01"


def mask(text: Column) -> Column:
    """Literals and comments become a blank; quoted names stay, because they are names.

    A text without a character that could begin one is not searched.
    """
    begins = reduce(lambda seen, mark: seen | text.contains(mark), ("'", '"', "`", "--", "/*"), F.lit(False))
    return F.when(begins, F.regexp_replace(text, _MASK, "$1 ")).otherwise(text)


def flat(text: Column) -> Column:
    """Masked text on one line: single blanks, none around the dots of qualified names."""
    line = collapse(mask(text))
    loose = line.contains(" .") | line.contains(". ")
    dotted = F.when(loose, F.regexp_replace(line, r"(?=[ .])(?: \. ?|\. )", ".")).otherwise(line)
    return F.regexp_replace(dotted, _INNER_FROM, "$1 ,")


def among(value: Column, *options) -> Column:
    """``isin`` for a few options inside a lambda, where a hit in a short list costs more than all comparisons:
    Spark leaves the interpreted list by an exception."""
    return reduce(lambda seen, option: seen | option, [value == option for option in options])


def _quoted(name: Column) -> Column:
    return name.contains('"') | name.contains("`")


def _name(name: Column) -> Column:
    """``normal_name`` of a name as the patterns here find it: without quotes, as nearly all are, its case is all
    that can differ."""
    return F.when(_quoted(name), normal_name(name)).otherwise(F.lower(name))


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, also where it stands inside a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _fold(parts: Column, begin: Column, step, emit) -> Column:
    """``parts`` rewritten and joined again, with a state that runs along them.

    ``step(state, part)`` is the state after a part, ``emit(state, part)`` its new text, given the state
    in front of it. Parts are taken in chunks, so that a huge text is not copied once for each part.
    """

    def rewrite(chunk, state):
        return F.aggregate(
            chunk,
            F.struct(state.alias("state"), F.lit("").alias("text")),
            lambda done, part: F.struct(
                step(done["state"], part).alias("state"),
                F.concat(done["text"], emit(done["state"], part)).alias("text"),
            ),
            lambda done: done["text"],
        )

    def chunked(parts):
        return F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(parts) - 1, F.lit(0)), F.lit(_CHUNK)),
            lambda at: F.slice(parts, at + 1, _CHUNK),
        )

    def joined(chunks):
        states = F.aggregate(
            F.slice(chunks, 1, F.size(chunks) - 1),
            F.array(begin),
            lambda done, chunk: F.concat(
                done, F.array(F.aggregate(chunk, F.element_at(done, -1), step))
            ),
        )
        return F.array_join(F.zip_with(chunks, states, rewrite), "")

    return _once(parts, lambda p: _once(chunked(p), joined))


def _turn(part: Column) -> Column:
    """What a part does to the depth of parentheses."""
    return F.when(part.startswith("("), 1).when(part.startswith(")"), -1).otherwise(0)


def is_balanced(code: Column) -> Column:
    """Whether every parenthesis has its partner.

    Pairs that stand directly in one another are taken out; only what a text of unusual depth leaves
    over is folded to its depth and lowest depth. The code itself is never rebuilt.
    """
    rest = F.regexp_replace(code, r"[^()]++", "")
    for _ in range(4):
        rest = F.replace(rest, F.lit("()"), F.lit(""))

    def deep(rest):
        return F.aggregate(
            F.regexp_extract_all(rest, F.lit(r"[()]"), F.lit(0)),
            F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low")),
            lambda done, paren: F.struct(
                (done["depth"] + _turn(paren)).alias("depth"),
                F.least(done["low"], done["depth"] + _turn(paren)).alias("low"),
            ),
            lambda done: (done["depth"] == 0) & (done["low"] == 0),
        )

    return _once(rest, lambda r: F.when(r == "", True).otherwise(deep(r)))


def top_level_items(code: Column) -> Column:
    """The text cut at the commas outside of all parentheses."""

    def marked(code):
        return _fold(
            F.regexp_extract_all(F.translate(code, _CUT, " "), F.lit(_PIECES), F.lit(0)),
            F.lit(0),
            lambda depth, part: depth + _turn(part),
            lambda depth, part: F.when(depth + _turn(part) == 0, F.translate(part, ",", _CUT)).otherwise(part),
        )

    def cut(code):
        plain = ~code.contains("(") & ~code.contains(")")
        # no parentheses in one another and no comma in them: every comma is one to cut at
        shallow = ~code.contains(_CUT) & code.rlike(_SHALLOW)
        return F.when(plain | shallow, F.split(code, ",")).otherwise(F.split(marked(code), _CUT))

    return F.transform(_once(code, cut), lambda item: F.trim(item))


def without_aggregates(code: Column) -> Column:
    """Aggregate calls with all their arguments replaced by ``{}``.

    A call whose arguments hold no parentheses is replaced as text; where another one is left, the
    tokens are folded to their depth and that of the outermost open call (0 for none).
    """

    def step(state, token):
        opens, closes = token.endswith("("), token == ")"
        depth = state["depth"] + opens.cast("int") - closes.cast("int")
        inside = (
            F.when((state["inside"] == 0) & opens & (token != "("), depth)
            .when(closes & (depth < state["inside"]), 0)
            .otherwise(state["inside"])
        )
        return F.struct(depth.alias("depth"), inside.alias("inside"))

    def emit(state, token):
        call = token.endswith("(") & (token != "(")
        return F.when(state["inside"] > 0, "").when(call, "{}").otherwise(token)

    def folded(code):
        tokens = F.regexp_extract_all(code, F.lit(_TOKENS), F.lit(0))
        return _fold(tokens, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("inside")), step, emit)

    def plain(code):
        return _once(
            F.regexp_replace(code, _PLAIN_CALL, "{}"),
            lambda text: F.when(~text.rlike(_CALL), text).otherwise(folded(code)),
        )

    return _once(code, lambda c: F.when(~c.contains("("), c).otherwise(plain(c)))


def statements(code: Column) -> Column:
    """The non-blank ``;``-separated statements."""
    return F.filter(F.transform(F.split(code, ";"), lambda s: F.trim(s)), lambda s: s != "")


def segments(code: Column) -> Column:
    """The text cut in front of every clause keyword: ordered ``(clause, text)`` elements.

    A leading part without a clause keyword counts as SELECT.
    """

    def label(segment):
        word = F.upper(F.regexp_extract(segment, r"^([A-Za-z]+(?: [Bb][Yy])?)", 1))
        read = _once(word, lambda w: F.when(w.isin(*CLAUSES), w).otherwise("SELECT"))
        # as clauses are mostly written, their first characters tell
        seen = F.when(segment.startswith("SELECT "), "SELECT").when(segment.startswith("GROUP BY "), "GROUP BY")
        for clause in ("FROM", "WHERE", "JOIN", "ON"):
            other = among(F.substring(segment, len(clause) + 2, 1), "B", "b")
            seen = seen.when(segment.startswith(f"{clause} ") & ~other, clause)
        return F.struct(seen.otherwise(read).alias("clause"), segment.alias("text"))

    # a pattern to split at would be compiled for every text, a single character needs none
    marked = F.split(F.regexp_replace(code, _CLAUSE_START, _CUT), _CUT)
    return F.transform(F.when(code.contains(_CUT), F.split(code, _CLAUSE_START)).otherwise(marked), label)


def _body(segment: Column) -> Column:
    return F.regexp_replace(segment["text"], r"^(?i)(?:GROUP BY|ORDER BY|[A-Za-z]+)\b", "")


def _of(parts: Column, *clauses: str) -> Column:
    return F.filter(parts, lambda s: among(s["clause"], *clauses))


def lists(parts: Column) -> Column:
    """The select and group lists of a statement, from its ``segments``: ``(clause, items)``, items as
    written. All rules about lists read these, so that each list is cut once."""
    return F.transform(
        _of(parts, "SELECT", "GROUP BY"),
        lambda s: F.struct(
            s["clause"].alias("clause"),
            top_level_items(F.substring_index(_body(s), ";", 1)).alias("items"),
        ),
    )


def identifiers(parts: Column, listed=(), keep=None) -> Column:
    """Ordered names of a statement with their clause, from its ``segments``.

    Element: ``(clause, token, name, is_function)``. ``token`` is the text as written,
    ``name`` its last part in normal form. An alias after AS, a cast's target type and SQL
    keywords are left out; an alias without AS is kept (it is checked like a column). A quoted
    name is never a keyword, nor is one in ``listed`` (normal forms which a vocabulary knows). ``keep(segment,
    found)`` may leave out what is found, a name as written with the parenthesis of a call, before it is read.
    """

    def of_token(segment, token, is_function):
        last = F.substring_index(token, ".", -1)
        return F.struct(
            segment["clause"].alias("clause"),
            token.alias("token"),
            F.when(_quoted(token), normal_name(last)).otherwise(F.lower(last)).alias("name"),
            is_function.alias("is_function"),
        )

    def of_found(segment, found):
        function = lambda token: of_token(segment, token, F.lit(True))
        calls = _once(F.rtrim(found, F.lit("( ")), function)
        return F.when(found.endswith("("), calls).otherwise(of_token(segment, found, F.lit(False)))

    words = [k for k in KEYWORDS if k not in listed]
    written = [c for k in words for c in (k, k.upper())]

    def of_segment(s):
        # what the alias alternative matched has no name; a keyword as it is mostly written goes before it is read
        def wanted(t):
            return ~t.isin("", *written) & keep(s, t) if keep else ~t.isin("", *written)

        found = F.filter(F.regexp_extract_all(s["text"], F.lit(_IDENTIFIER), F.lit(1)), wanted)
        return F.transform(found, lambda t: of_found(s, t))

    return F.filter(
        F.flatten(F.transform(parts, of_segment)),
        lambda i: (i["name"] != "") & (~i["name"].isin(words) | _quoted(i["token"])),
    )


def aliases(code: Column) -> Column:
    """Names declared with AS, in normal form."""
    found = F.regexp_extract_all(code, F.lit(rf"(?i)(?=AS\s)\bAS\s+(\w++|{_QUOTED})"), F.lit(1))
    return F.transform(found, _name)


def bound_tables(parts: Column) -> Column:
    """Tables named after FROM (also in a comma list) and JOIN, in order: ``(name, alias)`` in normal
    form. A table without an alias goes by its own name."""

    def one(item):
        bare = F.struct(F.lower(item).alias("name"), F.lower(item).alias("alias"))
        return F.when(item.rlike(r"^[\w$]++\z"), bare).otherwise(named_and_aliased(item))

    def named_and_aliased(item):
        term = rf"^((?:[\w.$]|{_QUOTED})++)(?: (?:(?i)AS )?([\w$]++|{_QUOTED}))?"
        term_of = lambda group: F.regexp_extract(item, term, group)
        both = F.struct(F.substring_index(term_of(1), ".", -1).alias("name"), term_of(2).alias("alias"))
        return _once(_once(both, lambda t: F.struct(_name(t["name"]).alias("name"), _name(t["alias"]).alias("alias"))), goes_by)

    def goes_by(t):
        joins = among(t["alias"], "left", "right", "inner", "full", "outer", "cross", "natural", "semi", "anti", "")
        return F.struct(t["name"].alias("name"), F.when(joins, t["name"]).otherwise(t["alias"]).alias("alias"))

    named = F.transform(
        _of(parts, "FROM", "JOIN"),
        lambda s: F.transform(F.split(_body(s), ","), lambda item: one(F.trim(item))),
    )
    return F.filter(F.flatten(named), lambda t: t["name"] != "")


def common_tables(code: Column) -> Column:
    """Names that a WITH clause declares, in normal form."""
    found = F.regexp_extract_all(code, F.lit(rf"(?i)(?:\bWITH |\bRECURSIVE |, ?)([\w$]++|{_QUOTED}) AS ?\("), F.lit(1))
    return F.when(has_cte(code), F.transform(found, _name)).otherwise(F.array().cast("array<string>"))


def tables(parts: Column) -> Column:
    """The distinct tables named after FROM and JOIN, in normal form."""
    return F.array_distinct(F.transform(bound_tables(parts), lambda t: t["name"]))


def table_terms(parts: Column) -> Column:
    """What stands after FROM and JOIN, unshortened (for allow-listing)."""
    return F.transform(_of(parts, "FROM", "JOIN"), lambda s: F.trim(_body(s)))


# ---------------------------------------------------------------- single rules


def has_select_star(code: Column) -> Column:
    """``*``, ``t.*`` or ``DISTINCT *`` in a list or a call; ``COUNT(*)`` stays legal."""
    rest = F.regexp_replace(code, r"(?i)\bCOUNT\s*\(\s*\*\s*\)", "COUNT{}")
    star = r"(?i)(?:\bSELECT\b|[(,])\s*(?:(?:DISTINCT|ALL)\s+)?(?:[\w\"`]++\.)*+\*"
    return code.contains("*") & rest.rlike(star)


def has_group_by(code: Column) -> Column:
    return code.rlike(r"(?i)(?=GR)\bGROUP\s+BY\b")


def group_by_columns(found: Column) -> Column:
    """Items of the GROUP BY list as written (empty array without one), from the ``lists``."""
    groups = F.transform(_of(found, "GROUP BY"), lambda s: s["items"])
    return F.filter(F.flatten(groups), lambda item: item != "")


def is_plain_column(item: Column) -> Column:
    """A bare or qualified name, as opposed to an expression or an ordinal."""
    return item.rlike(rf"^(?:[\w$]|\.|{_QUOTED})++$") & ~item.rlike(r"^\d+$")


def item_name(item: Column) -> Column:
    return normal_name(F.substring_index(item, ".", -1))


def select_items(code: Column, found: Column) -> Column:
    """Items of the outer select list as written: the first one, after a WITH clause the last."""
    outer = F.when(has_cte(code), F.lit(-1)).otherwise(F.lit(1))
    return F.try_element_at(_of(found, "SELECT"), outer)["items"]


def is_global_aggregate(code: Column, found: Column, grouped: Column | None = None) -> Column:
    """No GROUP BY (``grouped`` has that, where it is known), and in every item of the select list an aggregate call and no column outside
    of one: ``AVG(x) + 1`` and ``ROUND(AVG(x), 1)`` are, ``AVG(x) + x`` is not."""
    words = r"(?i)\b(?:" + "|".join(k for k in KEYWORDS if k != "as") + r")\b"

    def only_aggregates(item):
        return _once(without_aggregates(item), only_those)

    def only_those(rest):
        unnamed = F.regexp_replace(rest, r"(?i)(?<=[})\d])\s+(?:AS\s+)?(?:\w+|\"[^\"]*+\"|`[^`]*+`)\s*$", "")
        plain = F.regexp_replace(F.regexp_replace(unnamed, r"(?i)\bAS\s+\w+", ""), words, " ")
        return rest.contains("{}") & ~plain.rlike(r"[A-Za-z_\"`][\w.$\"`]*+(?!\s*[(\w.$\"`])")

    return ~(has_group_by(code) if grouped is None else grouped) & F.forall(select_items(code, found), only_aggregates)


def misplaced_aggregate(parts: Column) -> Column:
    """First aggregate call outside SELECT as ``(clause, function)``; null if there is none."""
    call = r"(?i)\b(" + "|".join(AGGREGATES) + r")\s*\("
    bad = F.filter(parts, lambda s: (s["clause"] != "SELECT") & s["text"].contains("(") & s["text"].rlike(call))
    first = F.try_element_at(bad, F.lit(1))
    return F.when(
        first.isNotNull(),
        F.struct(
            first["clause"].alias("clause"),
            F.upper(F.regexp_extract(first["text"], call, 1)).alias("function"),
        ),
    )


def person_counts(found: Column) -> Column:
    """Counts of the person key that start an item of the select list, in order.

    Element: ``(written, distinct, name)``; ``name`` is the declared alias, '' without one.
    """
    # without DISTINCT only the bare key counts as a faulty person count
    call = rf"(?i)^COUNT ?\( ?(?:(DISTINCT )(?:[\w$]++\.)*+)?{PERSON_COLUMN} ?\)"
    items = F.flatten(F.transform(_of(found, "SELECT"), lambda s: s["items"]))

    def one(item):
        distinct = F.regexp_extract(item, call, 1) != ""
        named = call + r" AS (\w+)"
        name = F.when(distinct, F.regexp_extract(item, named, 2)).otherwise("")
        written = F.when(name != "", F.regexp_extract(item, named, 0)).otherwise(
            F.regexp_extract(item, call, 0)
        )
        return F.struct(written.alias("written"), distinct.alias("distinct"), name.alias("name"))

    return F.transform(F.filter(items, lambda i: i.rlike(call)), one)


# A first select list in which the right person count stands behind items without parentheses.
_PLAIN_COUNT = (
    r"^(?i:SELECT) (?:[^();\x01]*,)? ?(?i:COUNT) ?\( ?(?i:DISTINCT) (?:[\w$]++\.)*+"
    rf"(?i:{PERSON_COLUMN}) ?\) (?i:AS) {COUNT_ALIAS}(?!\w)"
)


def plain_patient_count(parts: Column) -> Column:
    """Whether ``has_patient_count`` is sure from the first of the ``segments``, without cutting a list.
    False where it takes the lists to know."""
    return F.coalesce(F.try_element_at(parts, F.lit(1))["text"].rlike(_PLAIN_COUNT), F.lit(False))


def groups_person(code: Column) -> Column:
    """Whether the person key stands anywhere behind a GROUP BY; without, no group item can name it."""
    return code.rlike(rf"(?is)(?=GR)\bGROUP\s+BY\b.*?{PERSON_COLUMN}")


def has_patient_count(counts: Column) -> Column:
    """A distinct person count under its mandatory name, among ``person_counts``."""
    return F.exists(counts, lambda c: c["distinct"] & (c["name"] == COUNT_ALIAS))


def wrong_patient_count(counts: Column) -> Column:
    """The faulty person count as written (E303), null when there is a right one or none."""
    first = F.try_element_at(counts, F.lit(1))
    return F.when(~has_patient_count(counts), first["written"])


def has_cte(code: Column) -> Column:
    return code.rlike(r"(?i)^\s*WITH\b")


def has_subquery(code: Column) -> Column:
    """More than one SELECT (set operations included). The pattern looks at boundaries of words, and only where the
    letters come twice."""
    letters = F.upper(code)
    return (F.substring_index(letters, "SELECT", 2) != letters) & code.rlike(r"(?is)(?=SE)\bSELECT\b.*?(?=SE)\bSELECT\b")


def unreadable(text: Column, code: Column, balanced: Column) -> Column:
    """Why a text cannot be judged (E802), null when it can. Every doubt fails closed.

    Each pattern is tried only on texts that hold the character it is about.
    """

    def odd(quote):
        return code.contains(quote) & (F.regexp_count(code, F.lit(quote)) % 2 != 0)

    return (
        # an escape or a nested comment which engines read differently could hide code
        F.when(
            text.contains("\\") & text.rlike(r"\\['\"`\r\n]"),
            "backslash before a quote or a line end",
        )
        .when(
            text.contains("/*") & text.rlike(r"(?s)/\*(?:(?!\*/).)*?/\*"), "nested comment"
        )
        .when(
            code.contains("'") | code.contains("/*") | code.contains("*/"),
            "unterminated literal or comment",
        )
        .when(odd('"') | odd("`"), "unterminated quoted name")
        .when(~balanced, "unbalanced parentheses")
        .when(
            code.contains(";") & (F.size(statements(code)) > 1), "more than one statement"
        )
        .when(~code.rlike(r"(?i)^(?:SELECT|WITH)\b"), "statement does not start with SELECT")
    )


# ---------------------------------------------------------------- the wrapper as text

# The wrapper around an accepted query.
_WRAP_HEAD = "SELECT * FROM (\n    "
_WRAP_TAIL = "\n) AS validated_query\nWHERE Count_Patients >= "


def wrap(text: Column, min_patient_count: int = MIN_PATIENT_COUNT) -> Column:
    inner = F.rtrim(strip_right(text), F.lit(";"))
    return F.concat(F.lit(_WRAP_HEAD), inner, F.lit(f"{_WRAP_TAIL}{int(min_patient_count)}"))


def unwrap(text: Column) -> Column:
    """Inverse of ``wrap``, by its fixed head and tail in any spacing and case; text which is not
    wrapped comes back as it is."""
    one_line = F.upper(collapse(text))
    head, tail = _WRAP_HEAD.strip().upper(), " ".join(_WRAP_TAIL.split()).upper()
    number = F.substring_index(one_line, tail, -1)
    wrapped = one_line.startswith(head) & (one_line.contains(tail)) & F.trim(number).rlike(r"^\d+$")
    after = F.substring(text, F.instr(text, "(") + 1, F.length(text))
    inner = F.left(after, F.length(after) - F.length(F.substring_index(after, ")", -1)) - 1)
    return F.when(wrapped, strip(inner)).otherwise(text)


def query_hash(text: Column) -> Column:
    """SHA-256 of the text with its whitespace collapsed."""
    return F.sha2(collapse(text), 256)


def names_person(item: Column) -> Column:
    """The person key anywhere in an expression, qualified or quoted."""
    return item.rlike(rf"(?i)(?<![\w$]){PERSON_COLUMN}(?![\w$])")
