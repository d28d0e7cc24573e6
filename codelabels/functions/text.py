"""Source-text clean-up and normalisation as JVM-side Column expressions.

Java's regex dialect differs from the one the results were defined in, so flags
matter: ``d`` makes only ``\n`` end a line, ``s`` lets a dot cross lines, and
character classes are spelled out where the two dialects' shorthands differ.
Patterns open with a look-ahead for their first character: it rejects most
positions at once and roughly halves the time.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and placeholders.
IMPORTS = r"(?d)import .*?;"
PACKAGES = r"(?d)package .*?;"
COMMENTS = r"""(?smd)(?=["'/])(?:("[^"]*+"|'[^']*+')|(/\*.*?\*/|//[^\r\n]*$))"""
STRINGS = r"""(?d)(?=["'])(?:(["']){3}.*?\1{3}|(["']).*?\2)"""
NUMBERS = (
    r"(?=[+\-\p{Nd}])(?<![\p{L}\p{N}_])[+-]?\p{Nd}+(?:\.\p{Nd}+)?(?:[eE][+-]?\p{Nd}+)?(?![\p{L}\p{N}_])"
)
BOOLEANS = r"(?=[tTfF])(?iU)\b(true|false)\b"
TOKENS = r"[A-Za-z0-9_$]+"
# The same in Java's words, where \w is ASCII: a class of its own is tested five times as fast as three ranges.
JAVA_TOKENS = r"[\w$]+"
NO_TOKENS = r"[^\w$]++"
STRING_MARK = "<$STRING>"
NUMBER_MARK = "<$NUMBER>"
BOOLEAN_MARK = "<$BOOLEAN>"

# What ends a line, and what counts as blank.
BREAK_CHARS = r"\v\x1C-\x1E"  # \v: \n \x0B \x0C \r \x85 \u2028 \u2029
LINE_BREAK = rf"\r\n|[{BREAK_CHARS}]"
# Single characters below 256 are looked up in a table; ranges and others are compared one by one.
OTHER_BREAKS = r"[\x0B\x0C\r\x1C\x1D\x1E\x85]"
BLANK_POINTS = [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]
BLANKS = "".join(map(chr, BLANK_POINTS))


def _mark(text: str) -> str:
    return text.replace("$", r"\$")


def strip(c: Column) -> Column:
    """Trim every Unicode blank at both ends, not only spaces."""
    return F.trim(c, F.lit(BLANKS))


def strip_right(c: Column) -> Column:
    return F.rtrim(c, F.lit(BLANKS))


def other_breaks(c: Column) -> Column:
    """Does a text hold line separators besides line feeds?"""
    return c.rlike(OTHER_BREAKS) | c.contains("\u2028") | c.contains("\u2029")


def unified_breaks(c: Column) -> Column:
    """Every line separator as one line feed; most texts hold no other, which one look tells."""
    return F.when(other_breaks(c), F.regexp_replace(c, LINE_BREAK, "\n")).otherwise(c)


def split_lines(c: Column) -> Column:
    """Split at every line separator; a trailing separator leaves one empty item."""
    return F.split(unified_breaks(c), "\n")


def line_count(c: Column) -> Column:
    """Number of lines; a final separator does not start another line."""
    body = F.regexp_replace(c, rf"(?:{LINE_BREAK})\z", "")
    return F.when(c == "", F.lit(0)).otherwise(F.size(split_lines(body)))


def all_line_numbers(c: Column) -> Column:
    """1..n for a file that is new as a whole."""
    n = line_count(c)
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def remove_imports(c: Column) -> Column:
    return F.regexp_replace(c, IMPORTS, "")


def remove_packages(c: Column) -> Column:
    return F.regexp_replace(c, PACKAGES, "")


def remove_comments(c: Column) -> Column:
    """Drop block and line comments; quoted text is kept and hides markers in it."""
    return F.regexp_replace(c, COMMENTS, "$1")


def clean(c: Column, packages_first: bool = False) -> Column:
    """Comments, imports, packages removed.

    The order of the last two only matters for text such as
    ``import package x;``: scoring removes imports first, line acceptance
    packages first.
    """
    bare = remove_comments(c)
    if packages_first:
        return remove_imports(remove_packages(bare))
    return remove_packages(remove_imports(bare))


def remove_blank_lines(c: Column) -> Column:
    # Splitting CR LF twice only adds a blank line, and the plain class is faster.
    lines = F.transform(F.split(c, f"[{BREAK_CHARS}]"), strip_right)
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def replace_strings(c: Column) -> Column:
    return F.regexp_replace(c, STRINGS, _mark(STRING_MARK))


def replace_numbers(c: Column) -> Column:
    return F.regexp_replace(c, NUMBERS, _mark(NUMBER_MARK))


def replace_booleans(c: Column) -> Column:
    return F.regexp_replace(c, BOOLEANS, _mark(BOOLEAN_MARK))


def tokenize(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(JAVA_TOKENS), F.lit(0))


def token_words(c: Column) -> Column:
    """The tokens joined by blanks, as ``join_words(tokenize(c))``: one match for what lies between two of them."""
    return F.trim(F.regexp_replace(c, NO_TOKENS, " "))


def join_words(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: w.cast("string")), " ")


def replace_literals(c: Column) -> Column:
    return replace_booleans(replace_numbers(replace_strings(c)))


def normalise(c: Column) -> Column:
    """Blank lines out, then literals replaced by their placeholders."""
    return replace_literals(remove_blank_lines(c))


def token_text(c: Column) -> Column:
    """Normalised text reduced to blank-separated tokens (per-label classifiers)."""
    return token_words(normalise(c))


def significant_lines(c: Column) -> Column:
    """Lines that hold more than blanks or a single brace, left unstripped."""
    # A word character, which most lines show early, settles it without a look for blanks.
    return F.filter(F.split(c, "\n"), lambda line: line.rlike(r"\w") | ~strip(line).isin("", "{", "}"))


def normalise_lines(lines: Column) -> Column:
    """Normalise each line on its own.

    No placeholder pattern crosses a line end and no significant line is blank,
    so joining these equals normalising the joined window. Doing it once per
    file spares the repeated work of overlapping windows. The lines go through
    the patterns as one text, which holds no other break than theirs once their
    ends are trimmed; only a file with a break inside a line takes them singly.
    """

    def trimmed(line: Column) -> Column:
        return F.when(F.lit(BLANKS).contains(F.right(line, F.lit(1))), strip_right(line)).otherwise(line)

    def normalised(own: Column) -> Column:
        whole = F.transform(
            F.array(F.array_join(F.transform(own, trimmed), "\n")),
            lambda c: F.when(other_breaks(c), F.transform(own, normalise)).otherwise(F.split(replace_literals(c), "\n")),
        )
        return F.when(F.size(own) > 0, F.get(whole, 0)).otherwise(own)

    # Arrays of one element bind the lines and their text, so both are made once.
    return F.get(F.transform(F.array(lines), normalised), 0)
