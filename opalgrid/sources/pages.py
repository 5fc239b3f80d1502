"""Raw pages: text, embedded objects, structured data, page counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opalgrid.functions.text import as_col, html_text, squeeze


def title(c: Column | str) -> Column:
    return F.nullif(squeeze(F.regexp_extract(as_col(c), r"(?is)<title[^>]*>(.*?)</title\s*>", 1)), F.lit(""))


def page_text(pages: DataFrame) -> DataFrame:
    """page_id, title, text and characters of text, by native expressions alone."""
    return pages.select("page_id", title("html").alias("title"), html_text("html").alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def embedded_object(text: str | None, marker: str) -> str | None:
    """The object in braces after a marker; braces in strings and after backslashes don't count. None if it doesn't end."""
    at = text.find(marker) if text else -1
    at = text.find("{", at + len(marker)) if at >= 0 else -1
    if at < 0:
        return None
    depth, quote, k = 0, "", at
    while k < len(text):
        c = text[k]
        if quote:
            if c == "\\":
                k += 1
            elif c == quote:
                quote = ""
        elif c in "\"'":
            quote = c
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return text[at : k + 1]
        k += 1
    return None


def embedded(c: Column | str, marker: str) -> Column:
    """Embedded object of pages that have the marker; only those go to Python."""

    @F.pandas_udf("string")
    def scan(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda t: embedded_object(t, marker))

    c = as_col(c)
    return scan(F.when(F.contains(c, F.lit(marker)), c))


def json_ld(c: Column | str, kind: str = "JobPosting") -> Column:
    """The first ld+json script whose @type is, or holds, the kind; null if there is none."""
    found = F.regexp_extract_all(as_col(c), F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script\s*>"), 1)
    is_kind = lambda s: F.coalesce((F.get_json_object(s, "$['@type']") == kind) | F.contains(F.get_json_object(s, "$['@type']"), F.lit(f'"{kind}"')), F.lit(False))
    return F.try_element_at(F.filter(F.transform(found, F.trim), is_kind), F.lit(1))


def page_count(text: Column | str, per_page: int) -> Column:
    """Pages of a result list: `Page n / m`, else the first number of the title over the page size, else 1."""
    s = as_col(text)
    total = F.regexp_extract(s, r"(?i)page\s+\d+\s*/\s*(\d+)", 1).try_cast("int")
    hits = F.regexp_replace(F.regexp_extract(s, r"(\d[\d'’]*)", 1), "[^0-9]", "").try_cast("int")
    return F.coalesce(total, F.greatest(F.lit(1), F.ceil(hits / F.lit(per_page)).cast("int")), F.lit(1))


def page_lines(pages: DataFrame, least: int = 2) -> DataFrame:
    """page_id, title and body: the lines of a page's text outside its head, each once (case doesn't count), those of fewer than `least`
    characters left out; null for a null page."""
    body = F.regexp_replace("html", r"(?is)<(head|title)\b.*?</\1\s*>", " ")
    lines = F.filter(F.transform(F.split(html_text(body), "\n"), squeeze), lambda x: F.length(x) >= least)
    low = F.transform(lines, F.lower)
    once = F.filter(lines, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)
    return pages.select("page_id", title("html").alias("title"), F.array_join(once, "\n").alias("body"))


def total_pages(c: Column | str) -> Column:
    """Pages of a result list: the embedded state's own number, else from its total and page size, else the largest page linked to; 1 at least."""
    c = as_col(c)
    number = lambda p: F.nullif(F.regexp_extract(c, p, 1), F.lit("")).try_cast("int")
    total, size = number(r'"total(?:Hits|Results|Count)?"\s*:\s*(\d+)'), number(r'"(?:pageSize|perPage|rows)"\s*:\s*(\d+)')
    linked = F.array_max(F.transform(F.regexp_extract_all(c, F.lit(r"[?&](?:amp;)?page=(\d+)"), 1), lambda x: x.try_cast("int")))
    return F.greatest(F.lit(1), F.coalesce(number(r'"(?:numPages|totalPages|pageCount)"\s*:\s*(\d+)'), F.when(size > 0, F.ceil(total / size)).cast("int"), linked, F.lit(1)))


def list_items(c: Column | str, row: str, fields: dict[str, str]) -> Column:
    """Rows of an HTML list without a parser: each match of the pattern `row` gives a struct of the first group of each field's pattern,
    tags stripped and entities replaced; null where it isn't there."""
    found = F.regexp_extract_all(as_col(c), F.lit(row), 0)
    value = lambda x, p: F.nullif(squeeze(html_text(F.regexp_extract(x, p, 1))), F.lit(""))
    return F.transform(found, lambda x: F.struct(*(value(x, p).alias(k) for k, p in fields.items())))


def posting_schema(title_: Column, company: Column, place: Column, posted: Column, html: Column, url: Column) -> Column:
    """A schema.org JobPosting as JSON text, of a board's fields; what is null or empty is left out."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    org = F.when(some(company).isNotNull(), F.struct(F.lit("Organization").alias("@type"), some(company).alias("name")))
    where = F.when(some(place).isNotNull(), F.struct(F.lit("Place").alias("@type"), F.struct(F.lit("PostalAddress").alias("@type"), some(place).alias("addressLocality")).alias("address")))
    return F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("JobPosting").alias("@type"), some(title_).alias("title"), org.alias("hiringOrganization"), where.alias("jobLocation"), some(posted).alias("datePosted"), some(html).alias("description"), some(url).alias("url")))


def description_html(sections: Column) -> Column:
    """HTML of an array of struct(heading, text, items): headings, paragraphs and lists, escaped; empty parts are left out."""
    safe = lambda c: F.replace(F.replace(F.replace(F.trim(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    tag = lambda t, c: F.when(F.trim(c) != "", F.concat(F.lit(f"<{t}>"), safe(c), F.lit(f"</{t}>")))
    listed = lambda x: F.when(F.size(x) > 0, F.concat(F.lit("<ul>"), F.array_join(F.array_compact(F.transform(x, lambda i: tag("li", i))), ""), F.lit("</ul>")))
    return F.array_join(F.transform(sections, lambda s: F.concat_ws("", tag("h3", s["heading"]), tag("p", s["text"]), listed(s["items"]))), "")
