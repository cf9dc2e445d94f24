"""Numbers that prove themselves: cards, bank accounts, phones, social security numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushframe.functions.spans import find_spans, no_spans

# Candidate patterns. (?U) gives \d, \w and \b their Unicode meaning;
# the leading look-ahead changes no match, it lets the scan skip quickly.
CARD = r"(?=\p{Nd})(?U)(?<![\d.])(?:\d[ \-]?){12,18}\d(?![\d.])"
IBAN = r"(?=[A-Z]{2})(?U)\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{2,4}){3,8}\b"
PHONE = r"(?=\+)(?U)(?<![\w+])\+[1-9]\d{0,2}(?:[ \-]?\(?\d{1,4}\)?){2,6}(?!\d)"
SSN = r"(?=\p{Nd})(?U)\b(?!000|666|9\d{2})\d{3}-(?!00)\d{2}-(?!0000)\d{4}\b"

_BASE36 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def luhn_ok(digits: Column) -> Column:
    """Luhn test of a digits-only text; anything else fails."""
    return F.coalesce(F.when(digits.rlike("^[0-9]+$"), F.call_function("luhn_check", digits)), F.lit(False))


def iban_ok(compact: Column) -> Column:
    """ISO 13616: first four characters to the back, letters as 10..35, remainder 1 by 97."""
    rearranged = F.concat(F.substring(compact, F.lit(5), F.length(compact)), F.left(compact, F.lit(4)))

    def step(acc: Column, ch: Column) -> Column:
        digit = F.instr(F.lit(_BASE36), ch) - 1
        return ((acc * F.when(digit >= 10, 100).otherwise(10) + digit) % 97).cast("int")

    remainder = F.aggregate(F.split(rearranged, ""), F.lit(0), step)
    return F.length(compact).between(15, 34) & compact.rlike("^[0-9A-Z]+$") & (remainder == 1)


def card_spans(text: Column) -> Column:
    return find_spans(text, CARD, "PAYMENT_CARD", lambda v: luhn_ok(F.translate(v, " -", "")))


def iban_spans(text: Column) -> Column:
    return find_spans(
        text, IBAN, "BANK_ACCOUNT_IDENTIFIER", lambda v: iban_ok(F.translate(v, " ", ""))
    )


def phone_spans(text: Column) -> Column:
    def plausible(v: Column) -> Column:
        return F.length(F.regexp_replace(v, r"(?U)\D", "")).between(8, 15)

    return find_spans(text, PHONE, "PHONE_NUMBER", plausible, gate=text.contains("+"))


def ssn_spans(text: Column) -> Column:
    return find_spans(text, SSN, "PERSON_IDENTIFIER", gate=text.contains("-"))


def checksum_spans(text: Column) -> Column:
    """All four rules, ordered by start and then widest first; overlaps stay."""

    def rank(s: Column, i: Column) -> Column:
        return F.struct(s["start"], (s["start"] - s["end"]).alias("w"), i.alias("i"), s.alias("s"))

    found = F.concat(card_spans(text), iban_spans(text), phone_spans(text), ssn_spans(text))
    ordered = F.transform(F.array_sort(F.transform(found, rank)), lambda r: r["s"])
    return F.coalesce(ordered, no_spans())
