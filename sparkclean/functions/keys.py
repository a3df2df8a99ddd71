"""Normal forms, blocking keys and scores of names, phone numbers and emails, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def phone_digits(phone: Column) -> Column:
    return F.regexp_replace(phone, r"[^\p{N}]", "")


def normalize_phone(phone: Column) -> Column:
    """Digits with a leading plus if there was one; null for a blank value or one without digits."""
    trimmed = F.trim(phone)
    digits = _blank_to_null(phone_digits(trimmed))
    return F.when(trimmed.startswith("+"), F.concat(F.lit("+"), digits)).otherwise(digits)


def phone_last10(normal: Column) -> Column:
    """The last ten digits of a normalised number; null if it has fewer."""
    digits = phone_digits(normal)
    return F.when(F.length(digits) >= 10, F.right(digits, F.lit(10)))


def has_country_code(normal: Column) -> Column:
    return normal.startswith("+")


def phones_match(a: Column, b: Column) -> Column:
    """Equal normalised numbers, or equal last ten digits where a side has no country code; false for null."""
    suffix = (phone_last10(a) == phone_last10(b)) & ~(has_country_code(a) & has_country_code(b))
    return F.coalesce((a == b) | suffix, F.lit(False))


def normalize_email(email: Column, strip_tag: bool = False) -> Column:
    """Trimmed and lower-cased, on request without ``+tag``; null if blank."""
    normal = F.lower(F.trim(email))
    if strip_tag:
        normal = F.regexp_replace(normal, r"^([^+@]*)\+[^@]*@", "$1@")
    return _blank_to_null(normal)


def emails_match(a: Column, b: Column) -> Column:
    return F.coalesce(normalize_email(a) == normalize_email(b), F.lit(False))


def email_local_part(normal: Column) -> Column:
    """The first non-empty part of an address between at-signs; null if there is none."""
    return F.try_element_at(F.filter(F.split(normal, "@"), lambda x: x != ""), F.lit(1))


def field_count(given: Column, family: Column, phones: Column, emails: Column, has_image: Column) -> Column:
    """How many fields a contact fills; raw phones and emails count one each."""
    filled = lambda c: F.when(F.coalesce(c, F.lit("")) != "", 1).otherwise(0)
    return filled(given) + filled(family) + F.coalesce(F.size(phones), F.lit(0)) + F.coalesce(F.size(emails), F.lit(0)) + F.when(has_image, 1).otherwise(0)


def display_name(given: Column, family: Column) -> Column:
    name = F.concat_ws(" ", _blank_to_null(given), _blank_to_null(family))
    return F.when(name == "", F.lit("(No Name)")).otherwise(name)


def name_normal_form(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.replace(name, F.lit(","), F.lit(" "))), r"\s+", " "))


def token_sorted(normal: Column) -> Column:
    return F.array_join(F.array_sort(F.split(normal, " ")), " ")


def _edit_score(a: Column, b: Column) -> Column:
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def name_score(a: Column, b: Column) -> Column:
    """The larger edit similarity of two names as they stand and with sorted words; two empty names score 1, one 0."""
    a, b = name_normal_form(a), name_normal_form(b)
    scored = F.greatest(_edit_score(a, b), _edit_score(token_sorted(a), token_sorted(b)))
    return F.when((a == "") & (b == ""), 1.0).when((a == "") | (b == ""), 0.0).otherwise(scored)


def block_letter(given: Column, family: Column) -> Column:
    """First lower-cased letter of the family name, else of the given name, else ``#``."""
    name = F.coalesce(_blank_to_null(family), _blank_to_null(given))
    return F.coalesce(_blank_to_null(F.substring(F.lower(name), 1, 1)), F.lit("#"))
