"""Text normalisation for names, cities and addresses."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower-case Latin letters and signs without a decomposition, in their usual ASCII spelling.
SPELLINGS = {
    "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ħ": "h",
    "ŧ": "t", "ŋ": "ng", "ı": "i", "ĸ": "k", "°": "deg", "€": "eur", "§": "ss", "×": "x", "¶": "p",
}
# Blocks of Latin letters (Latin-1, Extended-A/B, Extended Additional, ligatures),
# and of combining marks.
LATIN_BLOCKS = ((0x00A1, 0x0250), (0x1E00, 0x1F00), (0xFB00, 0xFB07))
COMBINING_BLOCK = (0x0300, 0x0370)

_ASCII_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def _spelled_in_ascii() -> dict[str, str]:
    """ASCII letters and digits of every lower-case Latin character that Unicode decomposes so."""
    table = dict(SPELLINGS)
    for start, stop in LATIN_BLOCKS:
        for char in map(chr, range(start, stop)):
            base = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
            if char == char.lower() and char not in table and base and set(base) <= _ASCII_ALNUM:
                table[char] = base
    return table


_TABLE = _spelled_in_ascii()
_SINGLE = {c: base for c, base in _TABLE.items() if len(base) == 1}
_LONGER = {c: base for c, base in _TABLE.items() if len(base) > 1}
_COMBINING = "".join(map(chr, range(*COMBINING_BLOCK)))  # translate drops what has no target


def _folded(column: str) -> str:
    """SQL text: lower case, Latin characters spelled in ASCII, combining marks removed.

    As text, because a chain of calls per column would cost more than running it on small inputs.
    """
    low = spelled = f"lower({column})"
    for char, base in _LONGER.items():
        spelled = f"replace({spelled}, '{char}', '{base}')"
    single = f"CASE WHEN {low} RLIKE '[{''.join(_LONGER)}]' THEN {spelled} ELSE {low} END"
    folded = f"translate({single}, '{''.join(_SINGLE)}{_COMBINING}', '{''.join(_SINGLE.values())}')"
    # Pure ASCII text (as many bytes as characters) needs none of this.
    return f"CASE WHEN octet_length({column}) = length({column}) THEN {low} ELSE {folded} END"


def strip_spaces(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def norm_text(column: str) -> Column:
    """Lower-case ASCII words of letters and digits with single blanks; NULL when none is left."""
    return F.expr(f"nullif(trim(regexp_replace({_folded(column)}, '[^a-z0-9]+', ' ')), '')")


def display_name(text: Column) -> Column:
    """Title case after any character that is not a letter: ``o'neill-díaz`` → ``O'Neill-Díaz``."""
    tidy = blank_to_null(collapse_spaces(text))
    # initcap starts a word only after a blank, so put a marked blank before the other starts.
    marked = F.regexp_replace(tidy, r"(?<=[^\p{L} ])(?=\p{L})", "\u0001 ")
    return F.replace(F.initcap(marked), F.lit("\u0001 "), F.lit(""))


def given_of(full_name: Column) -> Column:
    """Given name out of ``Family, Given`` or ``Given Family…``."""
    tidy = strip_spaces(full_name)
    after_comma = strip_spaces(F.split(tidy, ",", 2)[1])
    return F.when(F.contains(tidy, F.lit(",")), after_comma).otherwise(F.regexp_extract(tidy, r"(?U)^\S+", 0))


def family_of(full_name: Column) -> Column:
    tidy = strip_spaces(full_name)
    before_comma = strip_spaces(F.substring_index(tidy, ",", 1))
    rest = collapse_spaces(F.regexp_replace(tidy, r"(?U)^\S+", ""))
    return F.when(F.contains(tidy, F.lit(",")), before_comma).otherwise(rest)
