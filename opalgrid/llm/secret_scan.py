"""Secrets: sliding-window Shannon entropy of candidate strings, with a threshold for each character class.

A candidate is a maximal run of at least 16 characters of `A-Z a-z 0-9 + / _ -`. A window of 16
characters moves over it; the counts of characters change by one in and one out, and with them the sum
of c * log2(c), so that a step costs the same at any window. The largest entropy of any window is held
against the threshold of the candidate's class. Known placeholders are suppressed, with the reason.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opalgrid.llm.common import buffers, narrow, slices

WINDOW = 16
#: Class: least entropy in bits. Words (letters of one case, or letters without digits) need almost
#: 16 different letters; digits alone can't reach theirs.
THRESHOLDS = {"hex": 2.6, "upper": 3.1, "mixed": 3.2, "word": 3.85, "digits": 3.4}
#: Reason and pattern of values that are no secrets.
ALLOW = (
    ("example", "(?i)example|placeholder|changeme|your[_-]?(key|token|secret|password)"),
    ("sequence", "(?i)0123456789|abcdefghij|1234567890|qwertyuiop"),
    ("repeated", "^(x+|X+|0+|-+|_+|[+]+|/+)$|xxxxxxxx|XXXXXXXX|00000000"),
    ("uuid", "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"),
)
RESULT = "doc_id long, start long, length long, char_class string, windows long, max_entropy double, masked string, suppressed string"
_CAND = np.zeros(256, bool)
_CAND[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")] = True
_XLOGX = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]


def compiled(allow: tuple[tuple[str, str], ...]) -> list[tuple[str, re.Pattern[str]]]:
    return [(why, re.compile(p)) for why, p in allow]


def char_class(value: str) -> str:
    if re.fullmatch(r"[0-9+/_-]+", value):
        return "digits"
    if re.fullmatch(r"[A-Za-z+/_-]+", value):
        return "word"
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value):
        return "hex"
    return "upper" if re.fullmatch(r"[A-Z0-9+/_-]+", value) else "mixed"


def max_entropy(value: str) -> float:
    """The largest Shannon entropy of a window, each window's counts made from the one before."""
    counts: dict[str, int] = {}
    total = 0.0
    least = math.inf
    for k, c in enumerate(value):
        if k >= WINDOW:  # one out before one in, so that no count exceeds the window
            out = value[k - WINDOW]
            n = counts[out]
            total += _XLOGX[n - 1] - _XLOGX[n]
            counts[out] = n - 1
        n = counts.get(c, 0)
        total += _XLOGX[n + 1] - _XLOGX[n]
        counts[c] = n + 1
        if k >= WINDOW - 1:
            least = min(least, total)
    return math.log2(WINDOW) - least / WINDOW


def suppression(value: str, allow: list[tuple[str, re.Pattern[str]]]) -> str:
    """The reason of the first pattern that a value meets; '' if it meets none."""
    return next((why for why, p in allow if p.search(value)), "")


def candidates(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Text number, start and end (bytes of raw) of each maximal run of candidate characters."""
    mask = _CAND[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[offsets[:-1]] = True
    first = first[:-1]
    start, end = mask.copy(), mask.copy()
    start[1:] &= ~mask[:-1] | first[1:]
    end[:-1] &= ~mask[1:] | first[1:]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    long = e - s >= WINDOW
    s, e = s[long], e[long]
    doc = np.searchsorted(offsets, s, side="right") - 1
    yield from zip(doc.tolist(), s.tolist(), e.tolist())


def _scan(allow: tuple[tuple[str, str], ...], thresholds: dict[str, float]):  # noqa: ANN202
    allowed = compiled(allow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, (raw_all, off) = batch.column(0).to_pylist(), buffers(batch.column(1))
            out: list[tuple] = []
            for i, j in slices(off):
                raw = raw_all[off[i] : off[j]]
                if not len(raw):
                    continue
                local = off[i : j + 1] - off[i]
                for doc, s, e in candidates(raw, local):
                    value = raw[s:e].tobytes().decode("ascii")
                    kind, bits = char_class(value), max_entropy(value)
                    if round(bits, 4) >= thresholds[kind]:
                        before = raw[local[doc] : s]
                        at = int(((before & 0xC0) != 0x80).sum())
                        out.append((ids[i + doc], at, e - s, kind, e - s - WINDOW + 1, round(bits, 4), value[:4] + "*" * 8, suppression(value, allowed)))
            cols = list(zip(*out)) if out else [()] * 8
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [x.split()[0] for x in RESULT.split(", ")])

    return run


def secret_scan(docs: DataFrame, allow: tuple[tuple[str, str], ...] = ALLOW, thresholds: dict[str, float] | None = None) -> DataFrame:
    """One row for each string whose entropy reaches its class's threshold: start and length in
    characters, windows, entropy (4 decimals), the first four characters, and why it is suppressed ('' if not): the reason of the
    first pattern of `allow` that it meets. `thresholds` replace those of some classes.

    Null and empty texts give no rows, nor does an empty table; a null doc_id stays null; repeated rows
    give repeated findings; a run of any length is one candidate; other columns are ignored.
    """
    return narrow(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scan(allow, THRESHOLDS | (thresholds or {})), RESULT)


def _sql() -> str:
    run = "[A-Za-z0-9+/_-]{16,}"
    limits = " ".join(f"WHEN '{k}' THEN {v}" for k, v in THRESHOLDS.items())
    allow = " ".join(f"WHEN regexp_matches(value, '{p}') THEN '{why}'" for why, p in ALLOW)
    return f"""
WITH m AS (
  SELECT doc_id, regexp_extract_all(text, '{run}') AS v, string_split_regex(text, '{run}') AS s
  FROM documents WHERE regexp_matches(text, '{run}')
), e AS (SELECT doc_id, v, s, unnest(range(1, len(v) + 1)) AS k FROM m
), c AS (
  SELECT row_number() OVER () AS id, doc_id, v[k] AS value,
    CAST(list_sum(list_transform(s[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(v[1:k-1], lambda x: length(x))), 0) AS BIGINT) AS start
  FROM e
), w AS (SELECT id, value, unnest(range(1, length(value) - 14)) AS i FROM c
), x AS (SELECT id, i, substr(value, CAST(i + j AS INTEGER), 1) AS ch FROM w, range(0, 16) AS r(j)
), n AS (SELECT id, i, ch, count(*) AS n FROM x GROUP BY ALL
), h AS (SELECT id, i, -sum(n / 16.0 * log2(n / 16.0)) AS bits FROM n GROUP BY ALL
), b AS (SELECT id, round(max(bits), 4) + 0.0 AS max_entropy, count(*) AS windows FROM h GROUP BY id
), k AS (
  SELECT *, CASE WHEN regexp_full_match(value, '[0-9+/_-]+') THEN 'digits' WHEN regexp_full_match(value, '[A-Za-z+/_-]+') THEN 'word'
    WHEN regexp_full_match(value, '[0-9a-f]+|[0-9A-F]+') THEN 'hex' WHEN regexp_full_match(value, '[A-Z0-9+/_-]+') THEN 'upper' ELSE 'mixed' END AS char_class
  FROM c JOIN b USING (id)
)
SELECT doc_id, start, CAST(length(value) AS BIGINT) AS length, char_class, CAST(windows AS BIGINT) AS windows, CAST(max_entropy AS DOUBLE) AS max_entropy,
  substr(value, 1, 4) || '********' AS masked, CASE {allow} ELSE '' END AS suppressed
FROM k WHERE max_entropy >= CASE char_class {limits} END"""


SQL = _sql()
