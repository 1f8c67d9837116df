"""What a cell means: value classes, header hints, check digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import count_of, indicators, is_email, rlike

# Header hints, and the entity kind of each value class.
LOCATION_HINTS = ("city", "cidade", "country", "pais", "país", "state", "estado", "location", "local", "address", "endereço", "endereco", "region", "geo", "origin", "destination", "origem", "destino")
ORGANIZATION_HINTS = ("company", "empresa", "organization", "organização", "organizacao", "org", "carrier", "vendor", "merchant", "supplier", "employer", "institution")
NAME_HINT = "name|nome|^title$|^label$|^subject$"
CLASS_KIND = {"email": "account", "phone": "account", "ip": "ip", "url": "url", "domain": "domain", "hash": "media", "wallet": "wallet", "person_name": "person", "location": "location", "organization": "organization", "national_id": "selector"}
CLASSES = ("url", "email", "ip", "hash", "wallet", "domain", "national_id", "phone", "money", "date", "boolean", "id", "number", "person_name", "free_text", "categorical", "location", "organization", "empty")


def is_phone(c: Column) -> Column:
    return rlike(c, r"^[0-9 +().-]*$") & count_of(c, "0-9").between(8, 15)


def is_national_id_like(c: Column) -> Column:
    return rlike(c, r"^[0-9./-]*$") & count_of(c, "0-9").isin(11, 14) & rlike(c, "[.-]")


def is_money(c: Column) -> Column:
    return (rlike(c, r"^\s*[$€£]") | rlike(c, r"(?s)^\s*R.*\$")) & rlike(c, "[0-9]")


def is_date(c: Column) -> Column:
    size = F.octet_length(c)
    return (count_of(c, "0-9") >= 4) & rlike(c, "[-/:T]") & (count_of(c, "A-Za-z") <= 3) & size.between(6, 40)


def is_bool(c: Column) -> Column:
    return F.lower(c).isin("true", "false", "yes", "no", "y", "n", "sim", "não", "nao", "0", "1")


def is_uuid_or_id(c: Column) -> Column:
    uuid = rlike(c, "^[0-9a-fA-F-]{36}$") & (count_of(c, "-") == 4)
    return uuid | (rlike(c, "^[A-Za-z0-9_-]{8,}$") & rlike(c, "[0-9]") & rlike(c, "[A-Za-z]"))


def is_number(c: Column) -> Column:
    return rlike(F.regexp_replace(c, ",", ""), r"^(?i)[+-]?([0-9]+\.?[0-9]*([e][+-]?[0-9]+)?|\.[0-9]+([e][+-]?[0-9]+)?|inf|infinity|nan)$")


def is_person_name(c: Column) -> Column:
    word = r"(?:\p{Lu}[\p{L}.'-]*|[\p{L}.'-]{1,3})"
    return rlike(c, rf"^\s*{word}(?:\s+{word}){{0,3}}\s*$") & (F.octet_length(c) <= 48) & (F.length(F.regexp_replace(c, r"[^\p{L}]", "")) >= 2)


def classify_value(c: Column) -> Column:
    t = F.trim(c)
    found = indicators(t)
    one = F.when(F.size(found) == 1, F.get(found, 0)["kind"])
    return (
        F.when(t == "", "empty")
        .when(one == "account", "email").when(one == "media", "hash").when(one.isNotNull(), one)
        .when(is_email(t), "email").when(is_national_id_like(t), "national_id").when(is_phone(t), "phone").when(is_money(t), "money")
        .when(is_date(t), "date").when(is_bool(t), "boolean").when(is_uuid_or_id(t), "id").when(is_number(t), "number").when(is_person_name(t), "person_name")
        .otherwise("free_text")
    )


def header_semantic(header: Column) -> Column:
    h = F.lower(header)
    return F.when(rlike(h, "|".join(LOCATION_HINTS)), "location").when(rlike(h, "|".join(ORGANIZATION_HINTS)), "organization")


def class_kind(c: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in CLASS_KIND.items() for x in kv)), c)


def valid_cpf(c: Column) -> Column:
    """Both check digits of an 11-digit number whose digits aren't all the same."""
    d = F.regexp_replace(c, "[^0-9]", "")
    at = lambda i: F.substr(d, i, F.lit(1)).cast("int")

    def check(n: int) -> Column:
        total = F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.lit(0), lambda s, i: s + at(i) * (n + 2 - i))
        return total * 10 % 11 % 10

    good = (check(9) == at(F.lit(10))) & (check(10) == at(F.lit(11)))
    return (F.length(d) == 11) & ~rlike(d, r"^([0-9])\1*$") & F.when(F.length(d) == 11, good).otherwise(False)


def valid_ssn(c: Column) -> Column:
    """Nine digits with an area that is issued and no group or serial of zeros."""
    return rlike(F.regexp_replace(c, "[^0-9]", ""), "^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$")
