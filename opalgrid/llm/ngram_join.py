"""Near duplicates: a prefix-tree join of word n-gram sets by Jaccard similarity, exact at every size.

Sets are brought into one global order (rarest n-gram first, ties by hash). Packed exchanges,
each a few binary arrays instead of one row per n-gram, bring sets that can be similar to one place:

1. n-grams that occur in one document only can't be shared. A document with fewer than
   `threshold * size` shared n-grams has no partner and goes no further.
2. The sets left, copies collapsed, get the frequency of each n-gram among them and with it their order.
3. Two sets as similar as `threshold` share an n-gram in their prefixes, and as many as the lengths
   after the prefixes demand. Sets that do are brought together; a group of many sets is cut into
   blocks, and each pair of its blocks that can hold similar sets is a task of its own. An n-gram in
   many prefixes makes no pairs, which would be the square of a group once for each of its n-grams:
   the sets that hold it, in stretches of sizes that can be similar, are brought together as a star.

There one block's ordered sets form a trie with merged single paths. One walk carries the overlap of
each trie path with a block of queries, so sets share the work of their common beginning, and drops a
query from a subtree once even its longest possible rest can't reach the overlap that the sizes demand.
The walk finds the links. Each task hands on sums of links and one edge for each linked set, never a list of all
pairs, so what is written grows with the documents and not with the square of a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opalgrid.llm.common import buffers, components, keyed, mix64, narrow, saved, slices, text_bytes, trim
from opalgrid.llm.words import ngrams, word_hashes

NGRAM = 3
THRESHOLD = 0.5
#: n-grams and documents of one packed block (documents are numbered by 16 bits in it), documents of one
#: step, and bytes of text for each range of n-grams.
BLOCK_NGRAMS, BLOCK_DOCS, STEP_DOCS, RANGE_BYTES = 500_000, 40_000, 20_000, 12 << 20
#: n-grams of the ranges that order sets and compare prefixes, and pairs that are summed up at once.
SET_RANGE, PREFIX_RANGE, PAIRS_AT_ONCE = 1_000_000, 1_000_000, 400_000
#: Prefixes up to which an n-gram makes pairs; those of a more frequent one come together as stars.
HOT_SETS = 128
#: Sets of one block of a group, queries that walk a trie together, and cells of their table of n-grams.
BLOCK_SETS, QUERIES, CELLS = 3_000, 256, 24_000_000
_EPS = 1e-9
_STAR = 1 << 40  # shared n-grams that an edge of a star counts for

BLOBS = "r int, block long, meta boolean, a binary, b binary, c binary"
LINKS = "rep long, root long, links long, best double"


def _unique_sets(k: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    o = np.lexsort((k, d))
    k, d = k[o], d[o]
    m = np.ones(len(k), bool)
    m[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    return k[m], d[m]


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Row and document ids, sizes and concatenated ascending sets of blocks of documents; empty sets are left out.
    A batch has the row's id, the document's id and the text."""
    parts: list[tuple[np.ndarray, ...]] = []
    held = docs = 0
    for batch in batches:
        raw, off = buffers(batch.column(2))
        rids, ids = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        for i, j in slices(off, most_values=STEP_DOCS):
            h, d = word_hashes(raw[off[i] : off[j]], off[i : j + 1] - off[i])
            k, d = _unique_sets(*ngrams(h, d, n))
            size = np.bincount(d, minlength=j - i)
            some = size > 0
            parts.append((rids[i:j][some], ids[i:j][some], size[some], k))
            held, docs = held + len(k), docs + int(some.sum())
            if held >= BLOCK_NGRAMS or docs >= BLOCK_DOCS:
                yield tuple(map(np.concatenate, zip(*parts)))
                parts, held, docs = [], 0, 0
    if held:
        yield tuple(map(np.concatenate, zip(*parts)))
    parts.clear()
    trim()


def _set_keys(sets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that identify each set."""
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return np.add.reduceat(mix64(sets), at), np.add.reduceat(mix64(sets ^ np.uint64(0x5DEECE66D)), at) ^ sizes.astype(np.uint64)


_WIDE = np.uint64((1 << 24) - 1)


def _gaps(sorted_values: np.ndarray, docs: np.ndarray) -> tuple[bytes, bytes]:
    """Ascending numbers as 24-bit gaps (low two bytes, then high ones); a longer gap is reached by fillers (document 65535)."""
    gap = np.diff(sorted_values, prepend=np.uint64(0))
    fill = (gap // _WIDE).astype(np.int64)
    if fill.any():
        if fill.sum() > len(gap) + 1024:
            return b"", np.concatenate([sorted_values.astype("<u8").view("<u2"), docs.astype("<u2")]).tobytes()
        at = np.cumsum(fill + 1) - 1
        g, d = np.full(at[-1] + 1, _WIDE, np.uint64), np.full(at[-1] + 1, 65535, "<u2")
        g[at], d[at] = gap - fill.astype(np.uint64) * _WIDE, docs
        gap, docs = g, d
    return (gap & np.uint64(0xFFFF)).astype("<u2").tobytes() + (gap >> np.uint64(16)).astype(np.uint8).tobytes(), docs.astype("<u2").tobytes()


def _ungap(a: bytes, b: bytes) -> tuple[np.ndarray, np.ndarray]:
    if not a and b:
        both = np.frombuffer(b, "<u2")
        n = len(both) // 5
        return both[: 4 * n].view("<u8"), both[4 * n :]
    n = len(a) // 3
    gap = np.frombuffer(a, "<u2", n).astype(np.uint64) | np.frombuffer(a, np.uint8, n, 2 * n).astype(np.uint64) << np.uint64(16)
    values, docs = np.cumsum(gap, dtype=np.uint64), np.frombuffer(b, "<u2")
    real = docs != 65535
    return values[real], docs[real]


def _block_id(n: int) -> int:
    return (TaskContext.get().partitionId() << 24) + n


_SCHEMA = pa.schema([("r", pa.int32()), ("block", pa.int64()), ("meta", pa.bool_()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])


def _rows(schema_rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*schema_rows), _SCHEMA)], schema=_SCHEMA)


def _check(docs: int) -> None:
    if docs >= 65535:
        raise ValueError("a block has more documents than 16 bits can number")


def _send_fingerprints(n: int, ranges: int, bits: int):  # noqa: ANN202
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, (rids, ids, sizes, sets) in enumerate(_sets(batches, n)):
            _check(len(ids))
            block = _block_id(number)
            k1, k2 = _set_keys(sets, sizes)
            rows = [(block % ranges, block, True, np.concatenate([rids, ids]).astype("<i8").tobytes(), sizes.astype("<i8").tobytes(), np.concatenate([k1, k2]).tobytes())]
            owner = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
            # order by n-gram with the document in the low bits, so that a plain sort does it
            both = (sets >> np.uint64(64 - bits)) << np.uint64(16) | owner
            both.sort()
            values, docs = both >> np.uint64(16), (both & np.uint64(0xFFFF)).astype("<u2")
            cut = np.searchsorted(values, (np.arange(ranges + 1, dtype=object) * (1 << bits) // ranges).astype(np.uint64))
            for r in range(ranges):
                if cut[r] < cut[r + 1]:
                    rows.append((r, block, False, *_gaps(values[cut[r] : cut[r + 1]], docs[cut[r] : cut[r + 1]]), None))
            yield _rows(rows)

    return send


def _mark_shared(t: pa.Table) -> pa.Table:
    """For one range: how many n-grams of each document of each block occur in another document too."""
    rows, blocks, parts = [], [], []
    for r, block, meta, a, b, c in zip(*(t.column(x).to_pylist() for x in ("r", "block", "meta", "a", "b", "c"))):
        if meta:
            rows.append((r, block, True, a, b, c))
        else:
            blocks.append((r, block))
            parts.append(_ungap(a, b))
    if parts:
        order = np.concatenate([v for v, _ in parts])
        order.sort()
        again = order[1:][order[1:] == order[:-1]]
        del order
        again = again[np.diff(again, prepend=np.uint64((1 << 64) - 1)) != 0]
        for (r, block), (v, d) in zip(blocks, parts):
            if len(again):
                at = np.minimum(np.searchsorted(again, v), len(again) - 1)
                counts = np.bincount(d[again[at] == v])
                rows.append((r, block, False, counts.astype("<u4").tobytes(), None, None))
    return pa.Table.from_batches([_rows(rows)] if rows else [], _SCHEMA)


def _survivors(threshold: float):  # noqa: ANN202
    def block(t: pa.Table) -> pa.Table:
        total: np.ndarray | None = None
        parts = []
        for x in t.to_pylist():
            if x["meta"]:
                both, sizes, keys = np.frombuffer(x["a"], "<i8"), np.frombuffer(x["b"], "<i8"), np.frombuffer(x["c"], "<i8")
                total = np.zeros(len(sizes), np.int64)
            else:
                parts.append(np.frombuffer(x["a"], "<u4"))
        if total is None:
            raise ValueError("a block came without its documents")
        for p in parts:
            total[: len(p)] += p
        keep, n = total >= np.ceil(threshold * sizes - _EPS), len(sizes)
        return pa.table({"rid": both[:n][keep], "doc_id": both[n:][keep], "size": sizes[keep], "k1": keys[:n][keep], "k2": keys[n:][keep]})

    return block


def _send_sets(n: int, ranges: int):  # noqa: ANN202
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, (rids, _, sizes, sets) in enumerate(_sets(batches, n)):
            _check(len(rids))
            block = _block_id(number)
            rows = [(block % ranges, block, True, rids.astype("<i8").tobytes(), sizes.astype("<i8").tobytes(), None)]
            owner = np.repeat(np.arange(len(sizes)), sizes).astype("<u2")
            o = np.argsort(sets, kind="stable")
            values, docs = sets[o], owner[o]
            cut = np.searchsorted(values, (np.arange(ranges, dtype=object) * (1 << 64) // ranges).astype(np.uint64))
            cut = np.append(cut, len(values))
            for r in range(ranges):
                if cut[r] < cut[r + 1]:
                    rows.append((r, block, False, values[cut[r] : cut[r + 1]].tobytes(), docs[cut[r] : cut[r + 1]].tobytes(), None))
            yield _rows(rows)

    return send


def _count_sets(t: pa.Table) -> pa.Table:
    """For one range: the n-grams that two sets or more hold, with their number, back to each block."""
    rows, own = [], []
    for x in t.to_pylist():
        if x["meta"]:
            rows.append((x["r"], x["block"], True, x["a"], x["b"], None))
        else:
            own.append((x["r"], x["block"], np.frombuffer(x["a"], "<u8"), np.frombuffer(x["b"], "<u2")))
    if own:
        u, c = np.unique(np.concatenate([v for *_, v, _ in own]), return_counts=True)
        for r, block, v, d in own:
            df = c[np.searchsorted(u, v)]
            m = df > 1
            rows.append((r, block, False, v[m].tobytes(), d[m].tobytes(), df[m].astype("<u4").tobytes()))
    return pa.Table.from_batches([_rows(rows)] if rows else [], _SCHEMA)


def _order_sets(t: pa.Table) -> pa.Table:
    """The sets of a block in the global order: rarest first, ties by hash; n-grams of one set alone left out."""
    ids = sizes = None
    v, d, c = [], [], []
    for x in t.to_pylist():
        if x["meta"]:
            ids, sizes = np.frombuffer(x["a"], "<i8"), np.frombuffer(x["b"], "<i8")
        else:
            v.append(np.frombuffer(x["a"], "<u8"))
            d.append(np.frombuffer(x["b"], "<u2"))
            c.append(np.frombuffer(x["c"], "<u4"))
    if ids is None:
        raise ValueError("a block came without its documents")
    v, d, c = (np.concatenate(x) if x else np.empty(0, k) for x, k in ((v, "<u8"), (d, "<u2"), (c, "<u4")))
    o = np.lexsort((v, c, d))
    v, d, c = v[o], d[o], c[o]
    cut = np.searchsorted(d, np.arange(len(ids) + 1))
    out = [(int(ids[k]), int(sizes[k]), v[cut[k] : cut[k + 1]].tobytes(), c[cut[k] : cut[k + 1]].tobytes()) for k in range(len(ids)) if cut[k] < cut[k + 1]]
    a, b, x, y = zip(*out) if out else ((), (), (), ())
    return pa.table({"rep": pa.array(a, pa.int64()), "size": pa.array(b, pa.int64()), "grams": pa.array(x, pa.binary()), "df": pa.array(y, pa.binary())})


def _prefix_length(size: int, shared: int, threshold: float) -> int:
    """Shared n-grams in the prefix: those of one set alone come first in the order and take its places."""
    return min(shared, size - math.ceil(threshold * size - _EPS) + 1 - (size - shared))


def _send_prefixes(ranges: int, threshold: float):  # noqa: ANN202
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(batches):
            grams: list[np.ndarray] = []
            lengths, ids, sizes = [], [], []
            for row in batch.to_pylist():
                g = np.frombuffer(row["grams"], "<u8")
                p = _prefix_length(row["size"], len(g), threshold)
                if p > 0:
                    grams.append(g[:p])
                    lengths.append(p)
                    ids.append(row["rep"])
                    sizes.append(row["size"])
            if not grams:
                continue
            v = np.concatenate(grams)
            i, s = np.repeat(np.array(ids, "<i8"), lengths), np.repeat(np.array(sizes, "<u4"), lengths)
            part = (v % np.uint64(ranges)).astype(np.int64)
            o = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[o], np.arange(ranges + 1))
            rows = [(r, number, False, v[x].tobytes(), i[x].tobytes(), s[x].tobytes()) for r in range(ranges) if len(x := o[cut[r] : cut[r + 1]])]
            yield _rows(rows)

    return send


_PAIRS = pa.schema([(x, pa.int64()) for x in ("a", "b", "sa", "sb", "n")])


def _stars(group: np.ndarray, i: np.ndarray, size: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges from the first set to the others in each stretch of a group, ordered by size, without a gap that no similar sets
    bridge. Sets of one group that can be similar by their sizes lie in one stretch."""
    o = np.lexsort((size[i], group))
    group, i = group[o], i[o]
    s = size[i]
    cut = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (s[:-1] < threshold * s[1:] - _EPS)]))
    head = np.repeat(np.minimum.reduceat(i, cut), np.diff(np.append(cut, len(i))))
    k = np.unique((head << 32 | i)[head != i])
    return k >> 32, k & 0xFFFFFFFF


def _pairs_of_range(threshold: float, most: int = HOT_SETS):  # noqa: ANN202
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sets that share n-grams of this range in their prefixes, and how many: sums over stretches of the range.
        Of n-grams in more than `most` prefixes the edges of stars."""
        v, i, s = ([], [], [])
        for batch in batches:
            for out, column, kind in zip((v, i, s), ("a", "b", "c"), ("<u8", "<i8", "<u4")):
                out += [np.frombuffer(x, kind) for x in batch.column(column).to_pylist()]
        v, i, s = map(np.concatenate, (v, i, s))
        ids, first, i = np.unique(i, return_index=True, return_inverse=True)
        size = s[first].astype(np.int64)
        o = np.lexsort((i, v))
        v, i = v[o], i[o].astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        group = np.diff(np.append(start, len(v)))
        del o, v
        if (group > most).any():
            hot = np.repeat(group > most, group)
            a, b = _stars(np.repeat(np.arange(len(group)), group)[hot], i[hot], size, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[a], ids[b], size[a], size[b], np.full(len(a), _STAR))], schema=_PAIRS)
            i, group = i[~hot], group[group <= most]
            start = np.cumsum(group) - group
        later = np.repeat(start + group, group) - np.arange(len(i)) - 1  # partners after each entry in its group
        done = np.cumsum(later)
        at = 0
        while at < len(i):
            stop = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
            rep = later[at:stop]
            if m := int(rep.sum()):
                left = np.repeat(np.arange(at, stop), rep)
                a, b = i[left], i[left + 1 + np.arange(m) - np.repeat(np.cumsum(rep) - rep, rep)]
                near = (np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]) - _EPS) & (a != b)
                k, c = np.unique(a[near] << 32 | b[near], return_counts=True)
                a, b = k >> 32, k & 0xFFFFFFFF
                if len(k):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[a], ids[b], size[a], size[b], c.astype(np.int64))], schema=_PAIRS)
            at = stop
        trim()

    return pairs


class _Node:
    """A path of the trie without branches: its n-grams, the sets that end at its end, its children, and
    bounds over all sets below: least size and the most n-grams that still follow."""

    __slots__ = ("grams", "ends", "kids", "least", "rest")

    def __init__(self, grams: np.ndarray) -> None:
        self.grams, self.ends, self.kids, self.least, self.rest = grams, [], [], 1 << 60, 0


def build_trie(sets: list[np.ndarray], sizes: np.ndarray) -> _Node:
    """A trie over sets given as ascending arrays of ranks."""
    order = sorted(range(len(sets)), key=lambda k: sets[k].tolist())
    root = _Node(np.empty(0, np.int64))
    stack = [(root, order, 0)]
    todo = []
    while stack:
        node, members, depth = stack.pop()
        todo.append(node)
        node.least = int(min(sizes[k] for k in members))
        node.rest = max(len(sets[k]) for k in members) - depth
        i = 0
        while i < len(members) and len(sets[members[i]]) == depth:
            node.ends.append(members[i])
            i += 1
        while i < len(members):
            head, j = sets[members[i]][depth], i
            while j < len(members) and sets[members[j]][depth] == head:
                j += 1
            a, b = sets[members[i]][depth:], sets[members[j - 1]][depth:]
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[:n] != b[:n])
            common = int(differ[0]) if len(differ) else n
            kid = _Node(a[:common])
            node.kids.append(kid)
            stack.append((kid, members[i:j], depth + common))
            i = j
    return root


def walk(root: _Node, sizes: np.ndarray, width: int, queries: list[np.ndarray], q_sizes: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(set of the trie, queries, overlaps) of all queries whose Jaccard similarity with the set reaches threshold."""
    share, together = threshold / (1 + threshold), max(8, min(QUERIES, CELLS // max(width, 1)))
    for at in range(0, len(queries), together):
        ids = np.arange(at, min(at + together, len(queries)))
        has = np.zeros((width, len(ids)), bool)
        for c, k in enumerate(ids):
            has[queries[k], c] = True
        stack = [(root, np.arange(len(ids)), np.zeros(len(ids), np.int64), np.array([len(queries[k]) for k in ids]))]
        while stack:
            node, live, overlap, left = stack.pop()
            if len(node.grams):
                if len(live) < len(ids) // 2:
                    inside = has[np.ix_(node.grams, live)].sum(axis=0)
                else:
                    inside = has[node.grams].sum(axis=0)[live]
                overlap, left = overlap + inside, left - inside
            size = q_sizes[ids[live]]
            for k in node.ends:
                hit = overlap >= share * (size + sizes[k]) - _EPS
                if hit.any():
                    yield k, ids[live[hit]], overlap[hit]
            for kid in node.kids:
                # what this subtree can still add: no more than its longest rest or the query's own
                most = overlap + np.minimum(left, len(kid.grams) + kid.rest)
                m = most >= share * (size + kid.least) - _EPS
                if m.any():
                    stack.append((kid, live[m], overlap[m], left[m]))


def _ranked(t: pa.Table) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, int]:
    """Reps, sets as ascending ranks of the global order, sizes, documents of each set, its side, and the number of ranks."""
    t = t.sort_by([("rep", "ascending"), ("side", "ascending")])
    rep, side = t.column("rep").to_numpy(), t.column("side").to_numpy()
    own = np.flatnonzero(np.concatenate([[True], (rep[1:] != rep[:-1]) | (side[1:] != side[:-1])])) if len(rep) else np.empty(0, int)
    t = t.take(own)
    grams, df = ([np.frombuffer(x, k) for x in t.column(c).to_pylist()] for c, k in (("grams", "<u8"), ("df", "<u4")))
    u, first, flat = np.unique(np.concatenate(grams), return_index=True, return_inverse=True)
    rank = np.empty(len(u), np.int64)
    rank[np.lexsort((u, np.concatenate(df)[first]))] = np.arange(len(u))
    sets = np.split(rank[flat], np.cumsum([len(g) for g in grams])[:-1])
    return rep[own], sets, t.column("size").to_numpy(), t.column("n").to_numpy(), side[own], len(u)


def _join_blocks(threshold: float):  # noqa: ANN202
    def join(t: pa.Table) -> pa.Table:
        """Links between the sets of side 0 and those of side 1, or, where there is one side only, among them."""
        rep, sets, sizes, n, side, width = _ranked(t)
        mine, theirs = np.flatnonzero(side == side.min()), np.flatnonzero(side == side.max())
        alone = side.min() == side.max()
        root = build_trie([sets[k] for k in theirs], sizes[theirs])
        links, best, label = np.zeros(len(rep), np.int64), np.zeros(len(rep)), np.arange(len(rep))
        for k, hits, overlap in walk(root, sizes[theirs], width, [sets[k] for k in mine], sizes[mine], threshold):
            a, b = theirs[k], mine[hits]
            if alone:  # the walk meets each pair from both ends
                overlap, b = overlap[b != a], b[b != a]
                if not len(b):
                    continue
            similarity = overlap / (sizes[a] + sizes[b] - overlap)
            links[a] += n[b].sum()
            best[a] = max(best[a], similarity.max())
            if not alone:
                links[b] += n[a]
                best[b] = np.maximum(best[b], similarity)
            joined = np.unique(np.append(label[b], label[a]))
            if len(joined) > 1:
                label[np.isin(label, joined)] = joined[0]
        some = links > 0
        return pa.table({"rep": rep[some], "root": rep[label[some]], "links": links[some], "best": best[some]})

    return join


def row_id() -> Column:
    """Identity of a row's doc_id and text, nulls told apart from values."""
    i, t = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return F.xxhash64(i.isNull(), F.coalesce(i, F.lit(0)), t)


def members(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of docs that are in a class of two or more or that are repeated, each once: rid (row_id), doc_id, times (how often the
    row is there), keep (the rid of the class's first row: smallest doc_id, null last, then smallest rid), class_id (its doc_id), class_size
    (rows, repeated ones once), n_links, max_jaccard. A null doc_id is a document of its own."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold lies above 0 and not above 1")
    missing = F.lit(-(1 << 63))  # packed in place of a null doc_id
    docs = narrow(docs).select(row_id().alias("rid"), F.coalesce(F.col("doc_id").cast("long"), missing).alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = text_bytes(docs)
    ranges = max(4, math.ceil(size / RANGE_BYTES))
    bits = min(48, max(24, (size // 4 + 1).bit_length() + 8))  # a chance match of fingerprints: 1 in 256
    marks = docs.mapInArrow(_send_fingerprints(n, ranges, bits), BLOBS).groupBy("r").applyInArrow(_mark_shared, BLOBS)
    alive = marks.groupBy("block").applyInArrow(_survivors(threshold), "rid long, doc_id long, size long, k1 long, k2 long")
    alive = saved(alive.groupBy("rid", "k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.min("size").alias("size"), F.count(F.lit(1)).alias("times")), "alive")
    i = F.col("doc_id")
    first = F.min(F.struct((i == missing).alias("unnamed"), i.alias("id"), F.col("rid"))).alias("first")
    groups = saved(alive.groupBy("k1", "k2").agg(F.min("rid").alias("rep"), first, F.count(F.lit(1)).alias("n"), F.max("times").alias("again"), F.min("size").alias("size")), "groups")
    chosen = keyed(docs, groups.select(F.col("rep").alias("rid")).distinct(), "rid", "left_semi")
    tokens = groups.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    ranges = max(4, math.ceil(tokens / SET_RANGE))
    counted = chosen.sortWithinPartitions("rid").mapInArrow(_send_sets(n, ranges), BLOBS).groupBy("r").applyInArrow(_count_sets, BLOBS)
    ordered = saved(counted.groupBy("block").applyInArrow(_order_sets, "rep long, size long, grams binary, df binary"), "ordered")
    ranges = max(4, math.ceil(tokens / PREFIX_RANGE))
    found = ordered.mapInArrow(_send_prefixes(ranges, threshold), BLOBS).groupBy("r").applyInArrow(_pairs_of_range(threshold, HOT_SETS), "a long, b long, sa long, sb long, n long")
    sums = found.groupBy("a", "b").agg(F.max("sa").alias("sa"), F.max("sb").alias("sb"), F.sum("n").alias("n"))
    rest = F.floor(F.lit(threshold) * F.greatest("sa", "sb") + 1)  # n-grams of a set after its prefix, at most
    near = saved(sums.filter(F.col("n") + rest >= F.lit(threshold / (1 + threshold)) * (F.col("sa") + F.col("sb")) - _EPS).select("a", "b", (F.col("n") >= _STAR).alias("star")), "near")
    # sets that can be similar come together: small groups whole, others by pairs of blocks that such sets lie in;
    # sets with the same first partner are neighbours in the blocks
    together = components(near)
    counted = together.join(together.groupBy("comp").agg(F.count(F.lit(1)).alias("sets")), "comp").select(F.col("node").alias("rep"), "comp", "sets")
    partner = near.groupBy(F.col("b").alias("rep")).agg(F.min("a").alias("partner"))
    place = F.row_number().over(Window.partitionBy("comp").orderBy(F.coalesce("partner", "rep"), "rep")) - 1
    large = counted.filter(F.col("sets") > BLOCK_SETS).join(partner, "rep", "left").withColumn("place", place.cast("long"))
    large = large.select("rep", "comp", F.floor(F.col("place") * F.ceil(F.col("sets") / BLOCK_SETS) / F.col("sets")).cast("int").alias("block"))
    placed = saved(large.withColumn("many", F.lit(True)).unionByName(counted.filter(F.col("sets") <= BLOCK_SETS).select("rep", "comp", F.lit(0).alias("block"), F.lit(False).alias("many"))), "placed")
    end = lambda x: placed.filter("many").select(F.col("rep").alias(x), F.col("comp").alias("comp" + x), F.col("block").alias("block" + x))
    tasks = near.join(end("a"), "a").join(end("b"), "b").select(F.col("compa").alias("comp"), F.least("blocka", "blockb").alias("i"), F.greatest("blocka", "blockb").alias("j")).distinct()
    stars = near.filter("star").select(F.col("a").alias("head"), F.explode(F.array("a", "b")).alias("rep")).distinct().join(placed.filter("many"), "rep").select("head", "comp", "block").distinct()
    tasks = tasks.unionByName(stars.select("head", "comp", F.col("block").alias("i")).join(stars.select("head", F.col("block").alias("j")), "head").filter("i <= j").select("comp", "i", "j")).distinct()
    sides = tasks.select("comp", F.col("i").alias("block"), "i", "j", F.lit(0).alias("side")).unionByName(tasks.filter("i != j").select("comp", F.col("j").alias("block"), "i", "j", F.lit(1).alias("side")))
    spread = placed.filter("many").join(sides, ["comp", "block"]).select("rep", "comp", "i", "j", "side").unionByName(placed.filter("not many").select("rep", "comp", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side")))
    inside = ordered.join(groups.select("rep", "n"), "rep").join(spread, "rep")
    links = saved(inside.groupBy("comp", "i", "j").applyInArrow(_join_blocks(threshold), LINKS), "links")
    # classes of sets, then of documents
    classes = components(links.select("rep", "root"), "rep", "root")
    stats = links.groupBy("rep").agg(F.sum("links").alias("links"), F.max("best").alias("best")).join(classes.withColumnRenamed("node", "rep"), "rep")
    sets = groups.join(stats, "rep", "left").filter("n > 1 or links > 0 or again > 1").withColumn("comp", F.coalesce("comp", "rep"))
    heads = sets.groupBy("comp").agg(F.min("first").alias("head"), F.sum("n").alias("class_size"))
    sets = sets.join(heads, "comp").select("k1", "k2", F.col("head.rid").alias("keep"), F.when(~F.col("head.unnamed"), F.col("head.id")).alias("class_id"), "class_size", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.when(F.col("n") > 1, F.lit(1.0)).otherwise(F.col("best")).alias("max_jaccard"))
    return alive.join(saved(sets, "classes"), ["k1", "k2"]).select("rid", F.when(i != missing, i).alias("doc_id"), "times", "keep", "class_id", "class_size", "n_links", "max_jaccard")


def ngram_join(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document whose set of word n-grams has a Jaccard similarity of `threshold` or more with that
    of another one: doc_id, class_id, class_size, n_links, max_jaccard.

    n_links is the number of such other documents, copies included; documents joined by links in any number of
    steps are a class, class_id is the smallest doc_id of it; max_jaccard is the largest similarity.

    Words are lower-cased runs of letters and digits. Null doc_id: not in the result. Null, empty or
    word-free text: an empty set, similar to nothing. Fewer than n words: one shorter n-gram. Repeated
    rows with the same doc_id and text are one document; with another text they are documents of their own. Columns other than
    doc_id and text are ignored. An empty table gives an empty result. Similarity exactly `threshold` is in.
    """
    return members(docs.filter("doc_id is not null"), n, threshold).filter("n_links > 0").select("doc_id", "class_id", "class_size", "n_links", "max_jaccard")


def distinct(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, of which each class of near duplicates keeps one: that with the smallest
    doc_id, null ids last. Of repeated rows one stays. Rows with a null, empty or word-free text are in no class and all stay.
    An empty table gives an empty one."""
    rid, at = "__opalgrid_rid", [F.col(f"`{c}`") for c in docs.columns]
    found = saved(members(docs, n, threshold).select(F.col("rid").alias(rid), "times", "keep"), "members")
    gone, again = found.filter(f"{rid} != keep or times > 1").select(rid), found.filter(f"{rid} = keep and times > 1").select(rid)
    rows = docs.withColumn(rid, row_id())
    kept = keyed(rows, gone, rid, "left_anti").select(at)
    if again.isEmpty():
        return kept
    return kept.unionAll(keyed(rows, again, rid, "left_semi").dropDuplicates([rid]).select(at))
