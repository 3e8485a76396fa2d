"""Decoders of coded values: trimmed, in any case, against a fixed domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import ENUMS
from .text import lookup

# Spellings beside the domain's own.
ALIASES: dict[str, dict[str, str]] = {
    "NameType": {"aka": "Also Known As"},
    "UrlType": {"web_home": "Web Home", "web_search": "Web Search"},
    "RepositoryType": {"court_house": "Court House", "historical_society": "Historical Society"},
}
DEFAULTS = {"AttributeType": "Custom", "LdsOrdType": "Other"}
#: Event types that only the wider decoder knows, by spelling.
MORE_EVENTS = {
    "adopt": "ADOPT", "adult_christen": "ADULTCHRISTEN", "adultchristen": "ADULTCHRISTEN", "annulment": "ANNULMENT", "bas_mitzvah": "Bat Mitzvah",
    "bless": "BLESS", "cause_death": "CAUSEDEATH", "cause_of_death": "CAUSEDEATH", "christen": "CHRISTEN", "christening": "CHRISTEN", "cremation": "CREMATION",
    "degree": "DEGREE", "div_filing": "DIVFILING", "divfiling": "DIVFILING", "elected": "ELECTED", "engagement": "ENGAGEMENT", "first_commun": "FIRSTCOMMUN",
    "firstcommun": "FIRSTCOMMUN", "marriage_alt": "MARRALT", "marr_alt": "MARRALT", "marriage_alternate": "MARRALT", "marriage_banns": "MARRBANNS",
    "marr_banns": "MARRBANNS", "marriage_contract": "MARRCONTR", "marr_contr": "MARRCONTR", "marriage_license": "MARRLIC", "marr_lic": "MARRLIC",
    "marriage_settlement": "MARRSETTL", "marr_settl": "MARRSETTL", "medical_info": "MEDINFO", "med_info": "MEDINFO", "medinfo": "MEDINFO",
    "military_serv": "Military Service", "nobility_title": "NOBTITLE", "nob_title": "NOBTITLE", "nobtitle": "NOBTITLE", "nobility": "NOBTITLE",
    "number_of_marriages": "NUMMARRIAGES", "num_marriages": "NUMMARRIAGES", "nummarriages": "NUMMARRIAGES", "ordination": "ORDINATION", "property": "PROPERTY", "unknown": "UNKNOWN",
}
GENDER = {"m": 0, "f": 1, "u": 2, "male": 0, "female": 1, "unknown": 2, "0": 0, "1": 1, "2": 2, "3": 3}


def decode(c: Column, domain: str) -> Column:
    """The domain's value, its default, or null."""
    table = {v.lower(): v for v in ENUMS[domain]} | ALIASES.get(domain, {})
    found = lookup(F.lower(F.trim(c)), table)
    return F.coalesce(found, F.lit(DEFAULTS[domain])) if domain in DEFAULTS else found


def event_type(c: Column) -> Column:
    """Any of the wider spellings, with blanks, hyphens and underscores alike."""
    table = {v.lower().replace(" ", "_"): v for v in ENUMS["EventType"]} | MORE_EVENTS
    return lookup(F.regexp_replace(F.lower(c), "[ _-]", "_"), table)


def gender(c: Column) -> Column:
    """0 male, 1 female, 2 unknown, 3 other, from letters, words or numbers; 2 if unreadable."""
    table = F.create_map(*(F.lit(x) for kv in GENDER.items() for x in kv))
    return F.coalesce(table[F.lower(F.trim(c.cast("string")))], F.lit(2))
