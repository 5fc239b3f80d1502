"""Benchmark decontamination by templates: numbers, names and units become typed placeholders.

Windows of template tokens of the benchmark are joined by hash with those of every document, in Spark. A filter of
bounded size, made of the benchmark's hashes, keeps the windows of documents that can't match out of the join, so one pass over the
documents does, however large the benchmark is. Matches on one alignment (document position minus item position) that
follow each other without a gap are a stretch of equal template tokens, and the words behind its
placeholders must map consistently: one value of the item always stands for the same value in
the document. So a question with other numbers or names is caught, and a chance likeness isn't. Where they
don't, only the inconsistent stretch is left out.

A text is read in more than one way, each against the same reading of the items: a capitalised word that
begins a sentence as a word, and as a name; and by the words, numbers and names as they are, so that verbatim
copies match however few plain words they have. What is found depends on a text alone, so copies are looked at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opalgrid.llm.common import BROADCAST_ROWS, buffers, mix64, narrow, saved, slices
from opalgrid.llm.words import hashes, lower_bytes, spans

#: Template tokens of a window, and those that must be words and not placeholders.
WINDOW, LITERALS = 8, 4
#: Template tokens in a row that make a leak, and words among them; of an item with fewer, all.
TOKENS, WORDS = 13, 6
#: Fewest tokens of an item that can be looked for; it then has to match as a whole.
SHORTEST = 5
#: log2 of the bits of the filter: 8 MB at most, whatever the benchmark's size.
FILTER_BITS = 26
#: Matched windows that one task aligns, about.
ALIGN_ROWS = 100_000
UNITS = (
    "mm cm dm m km mi mile miles inch inches ft foot feet yard yards mg g kg t ton tons tonne tonnes lb lbs oz ounce ounces ms s sec second seconds min minute minutes h hr hrs hour hours day days week weeks "
    "month months year years ml cl l liter liters litre litres gallon gallons usd eur gbp chf dollar dollars euro euros cent cents pound pounds percent pct degree degrees k c f n pa kpa j kj w kw v a hz khz mhz ghz kb mb gb tb kmh mph"
).split()
#: Ways in which a text is read.
READINGS = 3
RESULT = "doc_id long, item_id long, matched_windows long, item_windows long, coverage double, n_slots long, n_changed long, kind string"
_NUM, _NAME, _UNIT = (mix64(np.array([k], np.uint64))[0] for k in (101, 102, 103))
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOPS = np.zeros(256, bool)
_STOPS[list(b".!?\n\r:")] = True


def _unit_hashes() -> np.ndarray:
    raw = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    s, e, _ = spans(raw, np.array([0, len(raw)]))
    return np.sort(hashes(raw, s, e))


@dataclass
class Templates:
    """Template tokens of several texts: token, the value behind it, whether it is a placeholder, text number."""

    token: np.ndarray
    value: np.ndarray
    slot: np.ndarray
    doc: np.ndarray


def readings(raw: np.ndarray, offsets: np.ndarray) -> list[Templates]:
    """A number is digits, with `.` or `,` between; a unit is a known unit right after a number; a name is one
    or more capitalised words in a row that don't begin a sentence or a line. The rest are lower-cased words.
    In the second reading, those that begin a sentence or a line are names too. In the third,
    nothing is a placeholder: numbers and single lower-cased words by their values."""
    s, e, doc = spans(raw, offsets)
    if not len(s):
        return [Templates(np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, bool), doc)] * READINGS
    low = lower_bytes(raw)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[raw], dtype=np.int64)])
    number = digits[e] - digits[s] == e - s
    first = raw[s]
    second = raw[np.minimum(s + 1, len(raw) - 1)]
    upper = (first >= 65) & (first <= 90) | (first == 0xC3) & (second >= 0x80) & (second <= 0x9E)
    ends = np.concatenate([[0], np.cumsum((low != raw), dtype=np.int64)])
    lower_rest = (ends[e] - ends[s] <= 1) & (e - s > 1)  # one capital, the first
    new = np.ones(len(s), bool)
    new[1:] = doc[1:] != doc[:-1]
    stops = np.concatenate([[0], np.cumsum(_STOPS[raw], dtype=np.int64)])
    begins = new.copy()
    begins[1:] |= stops[s[1:]] - stops[e[:-1]] > 0
    capital = upper & lower_rest & ~number
    gap = np.zeros(len(s), np.int64)
    gap[1:] = s[1:] - e[:-1]
    between = np.zeros(len(s), np.uint8)
    between[1:] = raw[e[:-1]]
    prior = lambda x, new: np.concatenate([[False], x[:-1]]) & ~new
    decimal = number & prior(number, new) & (gap == 1) & ((between == 46) | (between == 44))
    units = _unit_hashes()

    def read(name: np.ndarray) -> Templates:
        head = np.flatnonzero(~(decimal | (name & prior(name, new) & (gap == 1) & (between == 32))))
        value = hashes(low, s[head], e[np.append(head[1:], len(s)) - 1])
        is_number, is_name = number[head], name[head]
        unit = (units[np.minimum(np.searchsorted(units, value), len(units) - 1)] == value) & prior(is_number, new[head])
        token = value.copy()
        token[is_number], token[is_name], token[unit] = _NUM, _NAME, _UNIT
        return Templates(token, value, is_number | is_name | unit, doc[head])

    plain = read(np.zeros(len(s), bool))
    return [read(capital & ~begins), read(capital), Templates(plain.value, plain.value, np.zeros(len(plain.doc), bool), plain.doc)]


def windows(t: Templates, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each window of n tokens of one text that has enough words."""
    if len(t.token) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    m = len(t.token) - n + 1
    total = np.zeros(m, np.uint64)
    for k in range(n):
        total *= np.uint64(0x9E3779B97F4A7C15)
        total += t.token[k : k + m]
    words = np.concatenate([[0], np.cumsum(~t.slot)])
    ok = (t.doc[:m] == t.doc[n - 1 :]) & (words[n:] - words[:-n] >= min(LITERALS, n - 1))
    at = np.flatnonzero(ok)
    return mix64(total[at]), at


def _probes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each hash in the filter."""
    low = np.uint64((1 << FILTER_BITS) - 1)
    return h & low, h >> np.uint64(64 - FILTER_BITS)


def _slots(t: Templates, at: np.ndarray, n: int) -> tuple[np.ndarray, list[bytes]]:
    """Of each window: which tokens are placeholders, as bits, and the values behind them."""
    where = at[:, None] + np.arange(n)
    slot, value = t.slot[where], t.value[where].astype("<u4")
    return (slot * (1 << np.arange(n))).sum(axis=1), [v[m].tobytes() for v, m in zip(value, slot)]


_ITEM = "reading int, n int, hash long, item_id long, at int, mask int, theirs binary, tokens int, words int, windows int"
_FOUND = "t1 long, t2 long, reading int, n int, hash long, pos int, ours binary"
_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "string": pa.string()}


def _batch(ddl: str, columns: list) -> pa.RecordBatch:
    fields = [x.split() for x in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of items in each reading. An item of fewer than WINDOW tokens is one window."""
    for batch in batches:
        ids, (raw, off) = batch.column(0).to_numpy(zero_copy_only=False), buffers(batch.column(1))
        for a, b in slices(off):
            for reading, t in enumerate(readings(raw[off[a] : off[b]], off[a : b + 1] - off[a])):
                count, words = np.bincount(t.doc, minlength=b - a), np.bincount(t.doc, weights=~t.slot, minlength=b - a)
                for n in sorted({min(WINDOW, int(c)) for c in count if c >= SHORTEST}):
                    h, at = windows(t, n)
                    own = np.minimum(count[t.doc[at]], WINDOW) == n
                    h, at = h[own], at[own]
                    item = t.doc[at]
                    mask, theirs = _slots(t, at, n)
                    first = np.concatenate([[0], np.cumsum(count)])[item]
                    yield _batch(_ITEM, [np.full(len(h), reading), np.full(len(h), n), h.view(np.int64), ids[a + item], at - first, mask, theirs, count[item], words[item].astype(int), np.bincount(item, minlength=b - a)[item]])


def _doc_windows(present: np.ndarray, lengths: list[int]):  # noqa: ANN202
    """Windows of documents whose hash the filter doesn't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t1, t2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            raw, off = buffers(batch.column(2))
            for a, b in slices(off):
                for reading, t in enumerate(readings(raw[off[a] : off[b]], off[a : b + 1] - off[a])):
                    for n in lengths:
                        h, at = windows(t, n)
                        for x in range(2):
                            where = _probes(h)[x].astype(np.int64)
                            m = (present[where >> 3] >> (where & 7).astype(np.uint8)) & 1 == 1
                            h, at = h[m], at[m]
                        if len(h):
                            d = a + t.doc[at]
                            _, ours = _slots(t, at, n)
                            yield _batch(_FOUND, [t1[d], t2[d], np.full(len(h), reading), np.full(len(h), n), h.view(np.int64), at - np.searchsorted(t.doc, t.doc[at]), ours])

    return run


def _consistent(hits: np.ndarray, n: int, at: np.ndarray, theirs: np.ndarray, ours: np.ndarray) -> np.ndarray:
    """The most windows (starts, in order) with consistent placeholders: the longest stretch of them, or all without a
    placeholder whose value isn't the most frequent one for the item's value (of equally frequent ones the item's own)."""
    pairs, number, times = np.unique(np.stack([theirs, ours], 1), axis=0, return_inverse=True, return_counts=True)
    if len(np.unique(pairs[:, 0])) == len(pairs):
        return hits
    order = np.lexsort((pairs[:, 0] != pairs[:, 1], -times, pairs[:, 0]))
    usual = np.zeros(len(pairs), bool)
    usual[order[np.concatenate([[True], pairs[order[1:], 0] != pairs[order[:-1], 0]])]] = True
    odd = at[~usual[number.ravel()]]
    kept = hits[np.searchsorted(odd, hits + n) == np.searchsorted(odd, hits)]
    last: dict[int, tuple[int, int, int]] = {}  # by the item's value: the latest value and place, and the latest place of another value
    clash = np.empty(len(at), np.int64)
    for j, (p, x, y) in enumerate(zip(at.tolist(), theirs.tolist(), ours.tolist())):
        value, place, other = last.get(x, (y, -1, -1))
        clash[j] = other if y == value else place
        last[x] = (y, p, int(clash[j]))
    clash = np.concatenate([[-1], np.maximum.accumulate(clash)])
    first = np.searchsorted(hits, clash[np.searchsorted(at, hits + n)], "right")
    b = int(np.argmax(np.arange(len(hits)) - first))
    stretch = hits[first[b] : b + 1]
    return stretch if len(stretch) >= len(kept) else kept


def _stretches(hits: np.ndarray, n: int) -> list[np.ndarray]:
    """Window starts cut where a token lies between one window's end and the next one's start."""
    return np.split(hits, np.flatnonzero(np.diff(hits) > n) + 1)


def aligned(pos: np.ndarray, n: int, mask: np.ndarray, theirs: list[bytes], ours: list[bytes], tokens: int, words: int) -> tuple[int, int, int] | None:
    """(windows, slots, changed slots) of the longest stretch of one alignment, given its windows in order, with
    enough equal template tokens in a row and consistent slots; None if there is none."""
    best = None
    for hits in _stretches(np.arange(len(pos))[:0] if not len(pos) else pos, n):
        if not len(hits) or hits[-1] + n - hits[0] < min(TOKENS, tokens):
            continue
        own = np.searchsorted(pos, hits)
        value: dict[int, tuple[int, int]] = {}
        for k in own:
            places = [i for i in range(n) if mask[k] >> i & 1]
            for i, x, y in zip(places, np.frombuffer(theirs[k], "<u4").tolist(), np.frombuffer(ours[k], "<u4").tolist()):
                value[int(pos[k]) + i] = (x, y)
        at = np.array(sorted(value), np.int64)
        a, b = (np.array([value[i][side] for i in at.tolist()], np.int64) for side in (0, 1))
        for kept in _stretches(_consistent(hits, n, at, a, b) if len(at) else hits, n):
            if not len(kept):
                continue
            low, high = np.searchsorted(at, (kept[0], kept[-1] + n))
            length = int(kept[-1] + n - kept[0])
            # windows that were left out may lie inside: what they alone hold doesn't count as consistent
            if length >= min(TOKENS, tokens) and length - (high - low) >= min(WORDS, words):
                found = (len(kept), int(high - low), int((a[low:high] != b[low:high]).sum()))
                best = max(best or found, found, key=lambda x: (x[0], -x[2]))
    return best


def _align(t: pa.Table) -> pa.Table:
    """The best match of each text and item over alignments and readings: by the share of the item's windows, then the
    fewest changes, then the first reading."""
    c = {x: t.column(x).to_numpy(zero_copy_only=False) for x in ("t1", "t2", "item_id", "reading", "n", "pos", "at", "mask", "tokens", "words", "windows")}
    shift = c["pos"] - c["at"]
    keys = (c["t1"], c["t2"], c["item_id"], c["reading"], c["n"], shift)
    o = np.lexsort((c["pos"], *keys[::-1]))
    theirs, ours = t.column("theirs").to_pylist(), t.column("ours").to_pylist()
    cut = np.flatnonzero(np.concatenate([[True], np.any([k[o][1:] != k[o][:-1] for k in keys], axis=0)])) if len(o) else []
    best: dict[tuple[int, int, int], tuple] = {}
    for a, b in zip(cut, [*cut[1:], len(o)]):
        rows = o[a:b]
        rows = rows[np.concatenate([[True], c["pos"][rows][1:] != c["pos"][rows][:-1]])]
        i = rows[0]
        found = aligned(c["pos"][rows].astype(np.int64), int(c["n"][i]), c["mask"][rows], [theirs[k] for k in rows], [ours[k] for k in rows], int(c["tokens"][i]), int(c["words"][i]))
        if found:
            k, slots, changed = found
            total, key = int(c["windows"][i]), (int(c["t1"][i]), int(c["t2"][i]), int(c["item_id"][i]))
            x = (k / total, -changed, -int(c["reading"][i]), k, slots, total)
            best[key] = max(best.get(key, x), x)
    rows = [(*key, k, total, round(min(share, 1.0), 6), slots, -changed, "reparameterised" if changed else "verbatim") for key, (share, changed, _, k, slots, total) in sorted(best.items())]
    return pa.Table.from_batches([_batch(f"t1 long, t2 long, {RESULT.removeprefix('doc_id long, ')}", list(zip(*rows)) if rows else [[]] * 9)])


def _keys() -> tuple[Column, Column]:
    """128 bits that identify a text."""
    text = F.col("text").cast("string")
    return F.xxhash64(text), F.xxhash64(F.lit(77), text)


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """t1, t2 (the text's identity, `_keys`) and the columns of RESULT after doc_id, for each text and item that match."""
    schema = f"t1 long, t2 long, {RESULT.removeprefix('doc_id long, ')}"
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and length(text) > 0").distinct()
    items = saved(items.mapInArrow(_item_windows, _ITEM), "items")
    lengths = sorted(r.n for r in items.select("n").distinct().collect())  # from SHORTEST to WINDOW
    if not lengths:
        return docs.sparkSession.createDataFrame([], schema)
    low = F.lit((1 << FILTER_BITS) - 1)
    bit = F.explode(F.array(F.col("hash").bitwiseAND(low), F.shiftrightunsigned("hash", 64 - FILTER_BITS)))
    present = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    spread = items.select(bit.alias("bit")).select((F.col("bit") / 32768).cast("long").alias("k"), (F.col("bit") % 32768).alias("at"))
    for r in spread.groupBy("k").agg(F.bitmap_construct_agg("at").alias("bits")).toLocalIterator():  # 8 MB in all, at most
        present[r.k * 4096 : (r.k + 1) * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    t1, t2 = _keys()
    found = narrow(docs).select(t1.alias("t1"), t2.alias("t2"), F.col("text").cast("string").alias("text")).filter("text is not null").mapInArrow(_doc_windows(present, lengths), _FOUND)
    on = ["reading", "n", "hash"]
    small = items.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = found.join(F.broadcast(items) if small else items, on).groupBy("t1", "t2", "item_id", *on[:2], "pos", "at").agg(*(F.first(c).alias(c) for c in ("mask", "tokens", "words", "windows", "theirs", "ours")))
    joined = saved(joined, "matched")
    parts = max(1, joined.count() // ALIGN_ROWS)
    return joined.withColumn("part", F.pmod(F.col("t1"), F.lit(parts))).groupBy("part").applyInArrow(_align, schema)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id) of every document that holds a benchmark item or a part of it of TOKENS template
    tokens in a row (a shorter item: all of it), as it is or with other numbers, names or units, each value
    always for the same one.

    With the windows of the longest such stretch, their share of the item's, the placeholders in it (none where it is
    found by its literal values), how many have another value, and the kind. Null or empty texts and items match nothing; null item_ids are
    left out; null doc_ids stay null; items of fewer than SHORTEST tokens can't be told from chance and are left
    out; an item_id with several texts stands for each of them, and the best match counts; an item that
    matches in two places or readings is one row, that of the larger share, then of fewer changes; repeated rows give repeated
    matches; other columns are ignored; empty tables give an empty result.
    """
    t1, t2 = _keys()
    found = saved(matches(docs, benchmark), "leaks")
    few = found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), t1.alias("t1"), t2.alias("t2"))
    return rows.join(F.broadcast(found) if few else found, ["t1", "t2"]).drop("t1", "t2")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no item leaks, with all their columns. Null and empty texts stay; so do rows with a null doc_id
    whose text holds no item; repeated rows stay or go together; an empty benchmark leaves all."""
    names = ["__opalgrid_t1", "__opalgrid_t2"]
    gone = saved(matches(docs, benchmark).select("t1", "t2").distinct(), "leaks").toDF(*names)
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = docs.withColumns(dict(zip(names, _keys())))
    return rows.join(F.broadcast(gone) if few else gone, names, "left_anti").select([F.col(f"`{c}`") for c in docs.columns])
