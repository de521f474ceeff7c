"""Text forms as Column expressions: everything stays in generated code, no Python workers."""

from __future__ import annotations

from functools import reduce
from string import punctuation

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Legal forms (fixed values).
LEGAL_FORMS = (
    "private limited", "pvt limited", "pvt ltd",
    "limited liability company", "limited liability partnership",
    "societe anonyme", "societe a responsabilite limitee", "societe par actions simplifiee", "societe civile immobiliere",
    "gesellschaft mit beschrankter haftung",
    "incorporated", "inc", "corporation", "corp", "company", "co", "limited", "ltd", "llc", "llp", "lp", "plc", "holdings", "holding",
    "sa", "sas", "sarl", "sasu", "eurl", "sci", "snc", "sem",
    "gmbh", "ag", "kg", "ohg", "ug", "ev",
    "pvt", "private", "nidhi", "opc",
    "pty", "bv", "nv", "ab", "as", "oy", "srl", "spa", "pte",
)
#: Abbreviations and what they stand for (fixed values).
ABBREVIATIONS = {
    "pvt": "private", "ltd": "limited", "corp": "corporation", "inc": "incorporated",
    "rd": "road", "st": "street", "ave": "avenue", "llc": "limited liability company", "co": "company",
}
#: Found wherever one of them stands as a word, and at times elsewhere.
ANY_ABBREVIATION = r"(?U)(?<![a-z0-9_])(?:" + "|".join(ABBREVIATIONS) + r")\b"
#: Words that say little about a business or its address (fixed values).
STOP_WORDS = (
    "inc", "llc", "ltd", "corp", "company", "corporation", "limited", "pvt", "private", "the", "and",
    "street", "road", "avenue", "drive", "lane", "dr", "st", "rd", "ave", "blvd", "suite", "floor", "unit", "center",
    "services", "service", "enterprise", "enterprises", "solutions", "group", "holdings", "international", "industries",
    "store", "shop", "market", "restaurant", "cafe", "hotel",
)

#: White space as the record format knows it: Unicode's, and the four separators from U+001C on.
SPACE = r"(?U)[\s\x1c-\x1f]+"
#: A legal form as a whole word anywhere, with the space around it, longer forms first.
LEGAL_PATTERN = r"(?U)(?:^|\s)(?:" + "|".join(sorted(LEGAL_FORMS, key=len, reverse=True)) + r")(?:\s*\.?\s*,?\s*$|\s)"
STRIP_PASSES = 3


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def clean_text(c: Column | str) -> Column:
    """Lower case, each ASCII punctuation mark a space, runs of white space one space, none at the ends."""
    spaced = F.translate(F.lower(_text(c)), punctuation, " " * len(punctuation))
    return F.trim(F.regexp_replace(spaced, SPACE, " "))


def normalize_abbreviations(clean: Column | str) -> Column:
    """Whole-word abbreviations written out. No expansion holds another abbreviation, so their order is free.

    Letters are sought first, and borders of words looked at only around them; a text without any is left alone.
    """
    written = reduce(lambda c, kv: F.regexp_replace(c, rf"(?U){kv[0]}\b(?<=\b{kv[0]})", kv[1]), ABBREVIATIONS.items(), _text(clean))
    return F.when(F.rlike(_text(clean), F.lit(ANY_ABBREVIATION)), written).otherwise(_text(clean))


def strip_legal_suffixes(clean: Column | str) -> Column:
    """Without legal forms. A hit takes the space behind it along, so that of adjacent forms every other one waits for the next of three passes."""
    passed = reduce(lambda c, _: F.trim(F.regexp_replace(c, LEGAL_PATTERN, " ")), range(STRIP_PASSES), _text(clean))
    return F.trim(F.regexp_replace(passed, SPACE, " "))


def normalize_ampersand(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_text(c), r"(?U)\s*&\s*", " and "))


def extract_numerical_tokens(clean: Column | str) -> Column:
    """All runs of digits, joined by spaces."""
    return F.array_join(F.regexp_extract_all(_text(clean), F.lit(r"(?U)\d+"), F.lit(0)), " ")


def normalize_name_for_matching(c: Column | str) -> Column:
    """The stripped clean form, or the clean form where nothing is left of it."""
    clean = clean_text(c)
    stripped = strip_legal_suffixes(normalize_ampersand(clean))
    return F.when(stripped != "", stripped).otherwise(clean)


def tokens(c: Column | str) -> Column:
    """Words between spaces; an empty text has none."""
    return F.filter(F.split(_text(c), " "), lambda w: w != "")


def first_token(c: Column | str) -> Column:
    return F.coalesce(F.get(tokens(c), F.lit(0)), F.lit(""))


def significant_words(c: Column | str, least: int) -> Column:
    """Words of `least` characters or more that are no stop words."""
    return F.filter(tokens(c), lambda w: (F.length(w) >= least) & ~w.isin(*STOP_WORDS))


def prepare_records(records: DataFrame) -> DataFrame:
    """Source records with all text forms that matching reads, computed once for each record.

    Adds name_clean, name_norm, name_stripped, addr_clean, addr_norm, numbers and country_clean (blank is an
    ordinary country). Other columns stay.
    """
    base = records.withColumns({"name_clean": clean_text("business_name"), "addr_clean": clean_text("business_address"), "country_clean": clean_text("country")})
    return base.withColumns({
        "name_norm": normalize_abbreviations("name_clean"), "name_stripped": strip_legal_suffixes("name_clean"),
        "addr_norm": normalize_abbreviations("addr_clean"), "numbers": extract_numerical_tokens("addr_clean"),
    })


def preprocess_dataframe(records: DataFrame) -> DataFrame:
    """The derived columns under their long names, each only where its input column is there."""
    out = {}
    if "business_name" in records.columns:
        clean = clean_text("business_name")
        out |= {"business_name_clean": clean, "business_name_norm": normalize_abbreviations(clean), "business_name_stripped": strip_legal_suffixes(clean)}
    if "business_address" in records.columns:
        clean = clean_text("business_address")
        out |= {"business_address_clean": clean, "business_address_norm": normalize_abbreviations(clean), "address_numbers": extract_numerical_tokens(clean)}
    if "country" in records.columns:
        out["country_clean"] = clean_text("country")
    return records.withColumns(out) if out else records
