"""A posting's text, board record and structured data to roles, seniority, languages, work mode, address, employer and tags.

Everything is one select of column expressions. The board's record and the structured data (schema.org JobPosting) come as JSON text,
whose fields may be a string, a list or an object.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opalgrid.functions.places import TABLES
from opalgrid.functions.taxonomy import SKILLS, matched_skills, matching_text
from opalgrid.functions.text import as_col, squeeze

FIRM = ("intern", "junior", "senior", "manager")
_ANY = {k: "|".join(TABLES[f"experience_{k}"]) for k in ("units", "kinds", "words")}
#: A number of years, or two, before a word for experience.
EXPERIENCE = rf"(?i)(\d{{1,2}})\s*(?:\+|plus)?\s*(?:-|to|–|—)?\s*(\d{{1,2}})?\s*(?:{_ANY['units']})(?=[^a-z0-9]{{0,20}}(?:of\s+)?(?:{_ANY['kinds']})?[^a-z0-9]{{0,20}}(?:{_ANY['words']}))"


def empty() -> Column:
    return F.array().cast("array<string>")


def field(json: Column | str, *path: str) -> Column:
    """Trimmed text of the first of several paths that has any; null if none has."""
    return F.coalesce(*(F.nullif(F.trim(F.get_json_object(as_col(json), p)), F.lit("")) for p in path))


def strings(json: Column | str, path: str) -> Column:
    """A string as a list of one, a list of strings as it is; blanks collapsed, empty ones left out."""
    x = F.get_json_object(as_col(json), path)
    listed = F.when(x.rlike(r"^\s*\["), F.coalesce(F.from_json(x, "array<string>"), empty())).otherwise(F.array(x))
    return F.filter(F.transform(F.coalesce(F.when(x.isNotNull(), listed), empty()), squeeze), lambda s: s.isNotNull() & (s != ""))


def once(c: Column) -> Column:
    """The first of items that differ in case only; blanks collapsed."""
    tidy = F.filter(F.transform(c, squeeze), lambda s: s != "")
    low = F.transform(tidy, F.lower)
    return F.filter(tidy, lambda s, i: F.array_position(low, F.lower(s)) == i + 1)


def alias_pattern(aliases: list[str]) -> str:
    words = {" ".join(re.sub(r"[/_?:‐-―]", " ", a.lower()).split()) for a in aliases}
    return "(?i)(?<![a-z0-9])(?:" + "|".join(re.escape(w).replace(r"\ ", " ") for w in sorted(words, key=lambda w: (-len(w), w)) if w) + ")(?![a-z0-9])"


def named(text: Column, catalogue: dict[str, list[str]]) -> Column:
    """Keys of a catalogue that a text names, in its order."""
    return F.array_compact(F.array(*(F.when(text.rlike(alias_pattern(a)), F.lit(k)) for k, a in catalogue.items())))


def tags(raw: Column | str) -> Column:
    one = lambda x: F.when(x.rlike(r"^\s*\{"), F.coalesce(field(x, "$.name"), field(x, "$.label"))).otherwise(x)
    found = [F.when(F.get_json_object(as_col(raw), p).rlike(r"^\s*\["), F.from_json(F.get_json_object(as_col(raw), p), "array<string>")) for p in ("$.listingTags", "$.tags")]
    return once(F.array_compact(F.transform(F.flatten(F.array(*(F.coalesce(x, empty()) for x in found))), one)))


def employment_types(raw: Column | str, schema: Column | str) -> Column:
    own = strings(schema, "$.employmentType")
    return F.when(F.size(own) > 0, own).otherwise(once(F.flatten(F.array(*(strings(raw, f"$.{k}") for k in ("employmentType", "employment_type", "jobType", "employmentTypeText"))))))


def address(raw: Column | str, schema: Column | str, place: Column | str) -> Column:
    """Of the first job location; without any field of it, the place and the board's slug."""
    names = {"street_address": "streetAddress", "locality": "addressLocality", "postal_code": "postalCode", "region": "addressRegion", "country": "addressCountry"}
    parts = {k: field(schema, f"$.jobLocation[0].address.{v}", f"$.jobLocation.address.{v}") for k, v in names.items()}
    some = F.coalesce(*parts.values()).isNotNull()
    slug = F.when(~some, field(raw, "$.jobLocationSlug"))
    parts["locality"] = F.when(some, parts["locality"]).otherwise(F.nullif(F.trim(as_col(place)), F.lit("")))
    return F.struct(*(c.alias(k) for k, c in parts.items()), slug.alias("job_location_slug"))


def employer(raw: Column | str, schema: Column | str, company: Column | str) -> Column:
    own = {"name": field(schema, "$.hiringOrganization.name"), "website": field(schema, "$.hiringOrganization.sameAs"), "logo": field(schema, "$.hiringOrganization.logo")}
    name = F.nullif(F.trim(as_col(company)), F.lit(""))
    boards = {"name": F.coalesce(field(raw, "$.company.name"), name), "website": field(raw, "$.company.sameAs", "$.company.website"), "logo": field(raw, "$.company.logo", "$.company.logoImage.src", "$.logo")}
    first, second = F.coalesce(*own.values()).isNotNull(), F.get_json_object(as_col(raw), "$.company").rlike(r"^\s*\{")
    only = {"name": name, "website": F.lit(None).cast("string"), "logo": F.lit(None).cast("string")}
    return F.struct(*(F.when(first, own[k]).when(second, boards[k]).otherwise(only[k]).alias(k) for k in own))


def years(text: Column) -> Column:
    """struct(min, max) of the requirement with the largest minimum, the first of equals; null if there is none."""
    low = F.transform(F.regexp_extract_all(text, F.lit(EXPERIENCE), 1), lambda x: x.cast("int"))
    high = F.transform(F.regexp_extract_all(text, F.lit(EXPERIENCE), 2), lambda x: x.try_cast("int"))
    at = F.array_position(low, F.array_max(low)).cast("int")
    return F.when(F.size(low) > 0, F.struct(F.array_max(low).alias("min"), F.try_element_at(high, F.when(at > 0, at)).alias("max")))


def inferred_seniority(labels: Column, least: Column) -> Column:
    """Labels, and, unless one of them is firm, what the years asked for say: 5 senior, 3 mid, 1 junior."""
    more = F.when(least >= 5, "senior").when(least >= 3, "mid").when(least >= 1, "junior")
    open_ = (F.size(F.array_intersect(labels, F.array(*map(F.lit, FIRM)))) == 0) & more.isNotNull()
    return F.when(open_, F.array_distinct(F.concat(labels, F.array(more)))).otherwise(labels)


_RAW_LABELS = [*(f"$.{k}" for k in ("expLevel", "experienceLevel", "experience_level", "seniorityLevel", "job_seniority_level", "seniority_level", "seniority")), *(f"$.detailPayload.{k}" for k in ("expLevel", "experienceLevel", "seniorityLevel"))]


def workload(raw: Column | str) -> Column:
    """struct(min, max) of the grades, else of the percentages in the board's text; null if there are none."""
    grades = F.from_json(F.get_json_object(as_col(raw), "$.employmentGrades"), "array<int>")
    text = F.coalesce(F.nullif(F.regexp_extract(F.coalesce(field(raw, "$.employmentGrade"), F.lit("")), r"(.*\d{1,3}\s*%.*)", 1), F.lit("")), field(raw, "$.workload"))
    found = F.coalesce(F.when(F.size(grades) > 0, F.array_compact(grades)), F.transform(F.regexp_extract_all(text, F.lit(r"(\d{1,3})\s*%"), 1), lambda x: x.cast("int")))
    return F.when(F.size(found) > 0, F.struct(F.array_min(found).alias("min"), F.array_max(found).alias("max")))


def classified(df: DataFrame) -> DataFrame:
    """df (title, company, place, description_text, description_html, raw, schema; any may be null) with the classifier's columns."""
    raw, schema = F.col("raw"), F.col("schema")
    t = TABLES
    x = df.withColumns({"occupational_categories": strings(schema, "$.occupationalCategory"), "listing_tags": tags(raw), "employment_types": employment_types(raw, schema), "industry": field(schema, "$.industry")})
    joined = lambda *c: F.concat(F.lit(" "), matching_text(F.concat_ws(" ", *c)), F.lit(" "))
    lists = [F.array_join(c, " ") for c in ("occupational_categories", "listing_tags", "employment_types")]
    x = x.withColumns({"__text": joined("title", "place", "description_text", "description_html", *lists, "industry"), "__title": joined("title", lists[0])})
    text, title = F.col("__text"), F.col("__title")
    roles, languages = named(title, t["role_families"]), named(text, t["spoken_languages"])
    spoken = F.from_json(F.get_json_object(raw, "$.languageSkills"), "array<string>")
    label = lambda s: F.when(s.rlike(r"^\s*\{"), field(s, "$.name", "$.language", "$.title", "$.label")).otherwise(s)
    more = named(matching_text(F.array_join(F.transform(F.coalesce(spoken, empty()), label), " ")), t["spoken_languages"])
    values = F.flatten(F.array(strings(raw, "$.detailAttributes.seniorityLevel"), *(strings(raw, p) for p in _RAW_LABELS)))
    stated = F.array_distinct(F.concat(F.flatten(F.transform(values, lambda v: named(v, t["seniority_keywords"]))), named(title, t["seniority_keywords"])))
    x = x.withColumns({"__stated": stated, "experience_years": years(text)})
    labels = F.when(F.size("__stated") > 0, F.col("__stated")).otherwise(named(text, t["seniority_keywords"]))
    kind = F.lower(F.coalesce(field(schema, "$.jobLocationType"), F.lit("")))
    mode = F.when(kind.rlike("telecommute|remote"), F.lit("remote"))
    for m in ("hybrid", "remote", "onsite"):
        mode = mode.when(text.rlike(alias_pattern(t["remote_keywords"][m])), F.lit(m))
    blank = F.trim(F.coalesce("description_text", F.lit(""))) == ""
    x = x.withColumn("role_family_matches", F.when(F.size(roles) > 0, roles).otherwise(named(text, t["role_families"])))
    out = x.withColumns({
        "role_family_primary": F.try_element_at("role_family_matches", F.lit(1)), "seniority_labels": inferred_seniority(labels, F.coalesce(F.col("experience_years.min"), F.lit(0))), "spoken_languages": F.array_union(languages, more), "remote_mode": mode,
        "workload_percent": workload(raw), "job_location": address(raw, schema, "place"), "employer": employer(raw, schema, "company"), "normalized_title": squeeze("title"), "skills": matched_skills(text, list(SKILLS)),
        "confidence": F.when(blank, "low").otherwise("high"), "confidence_reasons": F.when(blank, F.array(F.lit("missing_description_text"))).otherwise(empty()),
    })
    return out.drop("__text", "__title", "__stated")
