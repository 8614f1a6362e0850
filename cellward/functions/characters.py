"""Character rules: which characters a query (or a result cell) may hold.

Positions are 0-based and count code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# U+0020-U+007E plus tab, newline and carriage return are allowed.
LAST_PRINTABLE = 0x7E
FORBIDDEN = r"[^\x20-\x7E\t\n\r]"
NOT_PRINTABLE = r"[^\x20-\x7E]"

# What str.strip() removes (Spark's trim knows only U+0020).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The part of it below U+0100: such a class is one bitmap test per character.
LATIN_WHITESPACE = "".join(c for c in WHITESPACE if c < "\u0100")


def _runs(whitespace: str) -> str:
    """Pattern of the runs of such characters that are not just one blank."""
    return f"[{whitespace.replace(' ', '')}][{whitespace}]*+| [{whitespace}]++"


def is_blank(text: Column) -> Column:
    """Null, empty, or nothing but Unicode whitespace. Stops at the first other character."""
    return ~F.coalesce(text, F.lit("")).rlike(f"[^{WHITESPACE}]")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def strip_right(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITESPACE))


def is_ascii_printable(char: Column) -> Column:
    """For one-character strings; null for any other length."""
    return F.when(F.length(char) == 1, F.ascii(char).between(0x20, LAST_PRINTABLE))


def is_allowed_control_char(char: Column) -> Column:
    """For one-character strings; null for any other length."""
    return F.when(F.length(char) == 1, F.ascii(char).isin(0x09, 0x0A, 0x0D))


def collapse(text: Column) -> Column:
    """Every run of Unicode whitespace becomes one blank, none at the ends.

    The full class is only used on texts that hold a character it needs.
    """
    return F.trim(
        F.when(
            text.rlike(r"[^\x00-\xFF]"), F.regexp_replace(text, _runs(WHITESPACE), " ")
        ).otherwise(F.regexp_replace(text, _runs(LATIN_WHITESPACE), " "))
    )


def first_forbidden(text: Column) -> Column:
    """0-based position of the first forbidden character, -1 if there is none.

    Everything before that character is ASCII, so UTF-16 and code-point offsets agree.
    """
    return F.regexp_instr(text, F.lit(FORBIDDEN)) - 1


def char_code(code_point: Column) -> Column:
    """Above U+007E (DEL included) is non-ASCII, the rest are control characters."""
    return F.when(code_point > LAST_PRINTABLE, "E001").otherwise("E002")


def u_notation(code_point: Column) -> Column:
    return F.format_string("U+%04X", code_point)


def class_counts(text: Column) -> Column:
    """How many characters of each class a text holds, without exploding it into characters."""
    rest = F.regexp_replace(text, r"[\x20-\x7E]+", "")
    hard = F.regexp_replace(rest, r"[\t\n\r]+", "")
    non_ascii = F.regexp_replace(hard, r"[\x00-\x1F]+", "")
    return F.struct(
        (F.length(text) - F.length(rest)).cast("long").alias("printable"),
        (F.length(rest) - F.length(hard)).cast("long").alias("control_allowed"),
        (F.length(hard) - F.length(non_ascii)).cast("long").alias("control_forbidden"),
        F.length(non_ascii).cast("long").alias("non_ascii"),
    )


def sanitize(text: Column, max_length: int = 200) -> Column:
    """A log-safe rendering: visible escapes instead of everything unprintable.

    Texts which are already clean skip the per-character work.
    """

    def show(char):
        point = F.ascii(char)
        return (
            F.when(point.between(0x20, LAST_PRINTABLE), char)
            .when(char == "\t", r"\t")
            .when(char == "\n", r"\n")
            .when(char == "\r", r"\r")
            .otherwise(F.concat(F.lit("["), u_notation(point), F.lit("]")))
        )

    shown = F.when(
        text.rlike(NOT_PRINTABLE),
        F.array_join(F.transform(F.split(text, ""), show), ""),
    ).otherwise(text)
    return F.when(
        F.length(shown) > max_length,
        F.concat(F.substring(shown, 1, max_length - 3), F.lit("...")),
    ).otherwise(shown)
