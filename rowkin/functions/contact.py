"""Normalisation of e-mail addresses, phone numbers, dates and postal addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowkin.functions.text import blank_to_null, strip_spaces

# Argentine numbering. Country code, mobile prefix, and the areas of two and three
# digits; every other area has four digits and starts with 2 or 3. Area + subscriber = 10 digits.
COUNTRY = "54"
SHORT_AREAS = (
    "11",
    "220", "221", "223", "230", "236", "237", "249", "260", "261", "263", "264", "266", "280",
    "291", "294", "297", "298", "299", "336", "341", "342", "343", "345", "348", "351", "353",
    "358", "362", "364", "370", "376", "379", "380", "381", "383", "385", "387", "388",
)
# Date layouts, in the order they are tried.
DATE_LAYOUTS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
)
DOTLESS_DOMAIN = "gmail.com"


def norm_email(text: Column) -> Column:
    """Lower case, sub-address after ``+`` cut, dots dropped where the provider ignores them."""
    address = F.lower(strip_spaces(text))
    mailbox = F.substring_index(address, "@", 1)
    domain = F.substr(address, F.length(mailbox) + 2)
    local = F.substring_index(mailbox, "+", 1)
    local = F.when(domain == DOTLESS_DOMAIN, F.replace(local, F.lit("."), F.lit(""))).otherwise(local)
    usable = F.contains(text, F.lit("@")) & (local != "")
    return F.when(usable, F.concat(local, F.lit("@"), domain))


def norm_phone(text: Column) -> Column:
    """E.164 form of a number dialled from Argentina; NULL when its structure is not valid.

    Mobile numbers are written with ``15`` after the area at home and with ``9`` before it from
    abroad; both give the same result. Numbers of other countries keep their 8 to 15 digits.
    """
    written = F.regexp_replace(strip_spaces(text), r"(?i)\s*(?:ext\.?|int\.?|x)\s*\d+$", "")
    digits = F.regexp_replace(written, r"\D", "")
    plus = F.startswith(written, F.lit("+"))
    idd = ~plus & F.startswith(digits, F.lit("00"))
    abroad = F.when(idd, F.substr(digits, F.lit(3))).otherwise(digits)

    is_home = F.startswith(abroad, F.lit(COUNTRY)) & (plus | idd | (F.length(abroad) >= 12))
    national = F.regexp_replace(F.when(is_home, F.substr(abroad, F.lit(3))).otherwise(digits), "^0", "")
    areas = "|".join(SHORT_AREAS)
    home_mobile = rf"^(?=\d{{12}}$)({areas}|[23]\d{{3}})15(?=\d{{6,8}}$)"
    national = F.regexp_replace(national, home_mobile, "9$1")
    valid = national.rlike(r"^9?(?:11|[23]\d)\d{8}$")

    home = F.when(valid, F.concat(F.lit("+" + COUNTRY), national))
    foreign = F.when(F.length(abroad).between(8, 15), F.concat(F.lit("+"), abroad))
    return F.when((plus | idd) & ~is_home, foreign).otherwise(home)


def norm_date(text: Column) -> Column:
    tidy = strip_spaces(text)
    return F.coalesce(*[F.when(tidy.rlike(shape), F.try_to_date(tidy, layout)) for shape, layout in DATE_LAYOUTS])


def norm_address(address_norm: Column) -> Column:
    """Normalised text without the floor, and with the usual street words in one spelling."""
    padded = F.concat(F.lit(" "), address_norm, F.lit(" "))
    no_floor = F.regexp_replace(padded, r"\bpiso \d+\b", "")
    long_form = F.replace(no_floor, F.lit(" av "), F.lit(" avenida "))
    bare = F.replace(long_form, F.lit(" calle "), F.lit(" "))
    return blank_to_null(F.trim(F.regexp_replace(bare, " {2,}", " ")))


def to_instant(text: Column) -> Column:
    return text.try_cast("timestamp")
