"""Places: names of cities and cantons, codes in text, postal codes, labels and search terms. The tables lie in tables.json."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from opalgrid.functions.text import as_col, clean, fold, squeeze

TABLES = json.loads(Path(__file__).with_name("tables.json").read_text(encoding="utf-8"))
CODES = "AG AI AR BE BL BS FR GE GL GR JU LU NE NW OW SG SH SO SZ TG TI UR VD VS ZG ZH".split()
CITY_CANTON, CANTON_NAMES, CITY_DISPLAY = TABLES["city_canton"], TABLES["canton_names"], TABLES["city_display"]
#: Ranges of postal codes, both ends in, by canton; they don't overlap.
_POSTAL = "AG 5000-5799;BE 3000-3999;BL 4300-4499;BS 4000-4299;FR 1500-1799;GE 1200-1299;GR 7000-7799;LU 6000-6499;NE 2000-2999;SG 9000-9299 9400-9999;SO 4500-4999;SZ 8800-8899;TG 9300-9399;TI 6500-6999;VD 1000-1199 1400-1499;VS 1800-1999;ZH 8000-8799"
POSTAL = [(int(r[:4]), int(r[5:]), part.split()[0]) for part in _POSTAL.split(";") for r in part.split()[1:]]


def lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for p in pairs.items() for x in p)), key)


def place_key(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(fold(c), "[^a-z0-9]+", " "))


def city_name(c: Column | str) -> Column:
    """Without a postal code before and a canton's code after; known spellings as they are shown."""
    s = F.regexp_replace(F.trim(F.regexp_replace(clean(c), r"^\d{4}\s*/?\s*", "")), rf"\s+({'|'.join(CODES)})$", "")
    return F.coalesce(lookup(CITY_DISPLAY, place_key(s)), s)


def postal_canton(code: Column) -> Column:
    out = None
    for a, b, k in POSTAL:
        out = (F if out is None else out).when(code.between(a, b), k)
    return out


def named_canton(c: Column | str) -> Column:
    """Code of a code or of a canton's name."""
    s = F.trim(clean(c))
    return F.coalesce(F.when(F.upper(s).isin(CODES), F.upper(s)), lookup(CANTON_NAMES, place_key(s)))


def single_code(c: Column | str) -> Column:
    """The code among a text's words of two capitals, if it is one."""
    found = F.array_intersect(F.array_distinct(F.regexp_extract_all(clean(c), F.lit(r"\b([A-Z]{2})\b"), 1)), F.array(*map(F.lit, CODES)))
    return F.when(F.size(found) == 1, F.try_element_at(found, F.lit(1)))


def suffix_code(c: Column | str) -> Column:
    s = F.regexp_extract(clean(c), r"\b([A-Z]{2})$", 1)
    return F.when(s.isin(CODES), s)


def postal_in(c: Column | str) -> Column:
    """Canton of the first four digits that stand alone in a text."""
    return postal_canton(F.regexp_extract(clean(c), r"\b(\d{4})\b", 1).try_cast("int"))


def city_canton(c: Column | str) -> Column:
    """Canton of a city's name, else of the names that stand in the text as words, if they agree."""
    key = place_key(city_name(c))
    by: dict[str, list[str]] = {}
    for name, code in CITY_CANTON.items():
        by.setdefault(code, []).append(re.escape(name).replace(r"\ ", " "))
    found = F.array_compact(F.array(*(F.when(key.rlike(rf"\b(?:{'|'.join(names)})\b"), F.lit(code)) for code, names in by.items())))
    return F.coalesce(lookup(CITY_CANTON, key), F.when(F.size(found) == 1, F.try_element_at(found, F.lit(1))))


def derived_canton(region: Column | str, locality: Column | str, place: Column | str, postal: Column | str) -> Column:
    """The region's code; else, of the locality or the place: a single code, a code at the end, a postal code, a city; else the
    canton of the postal code's digits."""
    places = (as_col(locality), as_col(place))
    digits = F.regexp_replace(clean(postal), "[^0-9]", "")
    own = postal_canton(F.when(F.length(digits) >= 4, F.substring(digits, 1, 4)).try_cast("int"))
    return F.coalesce(named_canton(region), *(f(c) for f in (single_code, suffix_code, postal_in, city_canton) for c in places), own)


def canton_code(canton: Column | str, city: Column | str) -> Column:
    """A code or a canton's name as a code; else what text and city tell; else the text itself."""
    none = F.lit(None).cast("string")
    return F.coalesce(named_canton(canton), derived_canton(canton, city, city, none), F.trim(clean(canton)))


# ---- labels and search


def _tidy(c: Column) -> Column:
    return F.regexp_replace(squeeze(c), r"^[ ,;/|]+|[ ,;/|]+$", "")


def location_parts(c: Column | str) -> Column:
    s = F.regexp_replace(_tidy(F.coalesce(as_col(c).cast("string"), F.lit(""))), r"\([^)]*\)", " ")
    return F.filter(F.transform(F.split(s, r"(?i)\s*(?:,|;|\||/|\n|•|\+|\band\b|\bund\b)\s*"), _tidy), lambda x: x != "")


_SKIP = [*TABLES["location_generic"], *TABLES["location_ignored"]]
_QUALIFIERS = r"\b(?:" + "|".join(re.escape(x).replace(r"\ ", " ") for x in sorted(_SKIP, key=lambda x: (-len(x), x))) + r")\b"
_DISPLAY = TABLES["location_display"]


def location_part(x: Column) -> Column:
    """The canonical name of a part; empty for a country or a canton's code."""
    key = place_key(x)
    bare = F.trim(F.regexp_replace(F.regexp_replace(key, _QUALIFIERS, " "), " +", " "))
    return F.when(key.isin(TABLES["location_ignored"]), F.lit("")).otherwise(F.coalesce(lookup(_DISPLAY, key), lookup(_DISPLAY, bare), x))


def location_label(c: Column | str) -> Column:
    """Places of a text, each once by its key, joined by ` / `; empty if there is none."""
    named = F.filter(F.transform(location_parts(c), location_part), lambda x: x != "")
    keys = F.transform(named, place_key)
    return F.array_join(F.filter(named, lambda x, i: F.array_position(keys, place_key(x)) == i + 1), " / ")


def location_terms(c: Column | str) -> Column:
    """What a search for a place looks for: its parts, their labels, all spellings of a known city, with and without accents, in lower case."""
    label, key = location_label(c), place_key(F.coalesce(as_col(c).cast("string"), F.lit("")))
    terms = [location_parts(c), F.filter(F.split(label, " / "), lambda x: x != "")]
    for display, aliases in TABLES["location_search"].items():
        known = (label == display) | key.isin(sorted({_plain(a) for a in aliases}))
        terms.append(F.when(known, F.array(F.lit(display), *map(F.lit, aliases))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.flatten(F.transform(F.flatten(F.array(*terms)), lambda x: F.array(F.lower(_tidy(x)), fold(_tidy(x))))))


def _plain(alias: str) -> str:
    import unicodedata

    return "".join(ch for ch in unicodedata.normalize("NFKD", alias.lower()) if not unicodedata.combining(ch))
