"""Named text patterns and checks built on them, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of whole strings.
PATTERNS: dict[str, str] = {
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "phone_e164": r"^\+[1-9][0-9]{1,14}$",
    "phone_us": r"^(\+?1[-. ]?)?(\([0-9]{3}\)|[0-9]{3})[-. ]?[0-9]{3}[-. ]?[0-9]{4}$",
    "phone_intl": r"^\+?[0-9()\-.\ ]{7,20}$",
    "ssn": r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$",
    "ssn_flex": r"^[0-9]{3}[- ]?[0-9]{2}[- ]?[0-9]{4}$",
    "cc_visa": r"^4[0-9]{12}([0-9]{3})?$",
    "cc_mastercard": r"^(5[1-5][0-9]{2}|222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720)[0-9]{12}$",
    "cc_amex": r"^3[47][0-9]{13}$",
    "cc_discover": r"^6(011|5[0-9]{2}|4[4-9][0-9]|22[0-9]{2})[0-9]{12}$",
    "cc_generic": r"^[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{1,7}$",
    "ipv4": r"^((25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])$",
    "ipv4_cidr": r"^((25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\/([0-9]|[12][0-9]|3[0-2])$",
    "mac": r"^(([0-9A-Fa-f]{2}[:-]){5}([0-9A-Fa-f]{2})|([0-9A-Fa-f]{4}\.[0-9A-Fa-f]{4}\.[0-9A-Fa-f]{4}))$",
    "int": r"^[+-]?[0-9]+$",
    "uint": r"^[0-9]+$",
    "decimal": r"^[+-]?[0-9]+\.[0-9]+$",
    "real": r"^[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$",
    "hex": r"^(0[xX])?[0-9a-fA-F]+$",
    "binary": r"^(0[bB])?[01]+$",
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}$",
    "md5": r"^[0-9a-fA-F]{32}$",
    "sha1": r"^[0-9a-fA-F]{40}$",
    "sha256": r"^[0-9a-fA-F]{64}$",
    "base64": r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$",
    "jwt": r"^[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+$",
    "alpha": r"^[a-zA-Z]+$",
    "alphanumeric": r"^[a-zA-Z0-9]+$",
    "slug": r"^[a-z0-9]+(-[a-z0-9]+)*$",
    "snake": r"^[a-z][a-z0-9]*(_[a-z0-9]+)*$",
    "identifier": r"^[a-zA-Z_][a-zA-Z0-9_]*$",
    "safe_filename": r"^[a-zA-Z0-9_.-]+$",
    "semver": r"^(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)(-[0-9A-Za-z.-]+)?(\+[0-9A-Za-z.-]+)?$",
    "url": r"^https?://[-a-zA-Z0-9@:%._+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}\b([-a-zA-Z0-9()@:%_+.~#?&/=]*)$",
    "domain": r"^([a-zA-Z0-9-_]+\.)*[a-zA-Z0-9][a-zA-Z0-9-_]+\.[a-zA-Z]{2,11}$",
    "date_iso": r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])$",
    "iso8601": r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]+)?(Z|[+-](0[0-9]|1[0-4]):[0-5][0-9])$",
}


def matches(text: Column, name: str) -> Column:
    """Whether a whole string has the named form."""
    return text.rlike(PATTERNS[name])


def luhn_valid(text: Column) -> Column:
    """Check of the digits in a string (two at least): every second one from the right counts double."""
    digits = F.reverse(F.regexp_replace(text, "[^0-9]", ""))
    value = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    weigh = lambda i: F.when(i % 2 == 1, value(i)).otherwise(value(i) * 2 - F.when(value(i) > 4, 9).otherwise(0))
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + weigh(i))
    return F.when(text.isNull(), None).when(F.length(digits) < 2, False).otherwise(total % 10 == 0)


def is_email(text: Column) -> Column:
    return matches(text, "email")


def is_ipv4(text: Column) -> Column:
    return matches(text, "ipv4")


def is_mac(text: Column) -> Column:
    return matches(text, "mac")


def is_uuid(text: Column) -> Column:
    return matches(text, "uuid")


def is_sha256(text: Column) -> Column:
    return matches(text, "sha256")


def is_real(text: Column) -> Column:
    return matches(text, "real")


def is_int(text: Column) -> Column:
    return matches(text, "int")


def is_semver(text: Column) -> Column:
    return matches(text, "semver")
