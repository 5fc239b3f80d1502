"""Code length of text under context-tree weighting over the whole corpus.

A byte is eight binary decisions; each of the 255 nodes of the byte's binary tree has a context tree over
the bytes before. A node's weighted probability is half the Krichevsky-Trofimov (KT) estimate of
its own counts and half the product of its children's, so that every depth up to DEPTH takes part.

Counts are of all text, but a byte never helps to predict itself: its probability is that of the corpus with it, divided by that of
the corpus without it, which changes counts along one path only. So a code length is what the byte costs once all other bytes of the corpus are
known, and a passage that occurs elsewhere costs less than one that doesn't.

Documents are dealt to chunks; a chunk sends its sorted (context, byte) keys with
counts to ranges of contexts, in packed arrays. A range holds all of the subtree below two context bytes, so it
weights depths 2 and more by itself, and hands up sums for depths 1 and 0, of which there are 257 contexts at most. Then each range
returns to each chunk the code lengths of the keys that the chunk sent, and the chunk adds them up over
its texts. Nothing that grows with the corpus is broadcast or collected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opalgrid.llm.common import buffers, mix64, narrow, saved, slices, text_bytes, trim

#: Bytes of context, 7 at most: with the byte itself they are a 64-bit key.
DEPTH = 6
#: Bytes of text of a chunk, and for each range of contexts.
CHUNK_BYTES, RANGE_BYTES = 24 << 20, 12 << 20
RESULT = "doc_id long, n_bytes long, bits double, bits_per_byte double"
BLOBS = "r int, chunk long, keys binary, bits binary"
_HALF = math.log(0.5)


def keys_of(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each byte: the DEPTH bytes before it, the nearest in the highest place, and the byte itself.
    Before a text's beginning lie zeros."""
    inside = np.arange(len(raw), dtype=np.int64) - np.repeat(off[:-1], np.diff(off))
    key = raw.astype(np.uint64)
    for k in range(1, DEPTH + 1):
        before = np.zeros(len(raw), np.uint64)
        before[k:] = raw[:-k]
        before[inside < k] = 0
        key |= before << np.uint64(8 * (DEPTH + 1 - k))
    return key


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts)
    o = np.argsort(k, kind="stable")
    k, c = k[o], c[o]
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
    return k[at], np.add.reduceat(c, at) if len(k) else c


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending keys as gaps, and counts, each in as few bytes as it needs."""
    gaps, counts = np.diff(keys, prepend=np.uint64(0)), counts.astype("<u8")
    size = [np.ones(len(keys), np.uint8), np.ones(len(keys), np.uint8)]
    for n, v in zip(size, (gaps, counts)):
        for i in range(1, 8):
            more = v >= np.uint64(1 << 8 * i)
            if not more.any():
                break
            n += more
    out = [np.array([len(keys)], "<u8").tobytes(), (size[0] | size[1] << 4).tobytes()]
    out += [v.astype("<u8").view(np.uint8).reshape(-1, 8)[np.arange(8) < n[:, None]].tobytes() for n, v in zip(size, (gaps, counts))]
    return b"".join(out)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(blob, "<u8", 1)[0])
    sizes, at, out = np.frombuffer(blob, np.uint8, n, 8), 8 + n, []
    for size in (sizes & 15, sizes >> 4):
        total = int(size.sum(dtype=np.int64))
        wide = np.zeros((n, 8), np.uint8)
        wide[np.arange(8) < size[:, None]] = np.frombuffer(blob, np.uint8, total, at)
        out.append(wide.view("<u8").ravel())
        at += total
    return np.cumsum(out[0], dtype=np.uint64), out[1].astype(np.int64)


def count_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, off = buffers(texts)
    keys, counts, held = [], [], 0
    for i, j in slices(off):
        x = np.sort(keys_of(raw[off[i] : off[j]], off[i : j + 1] - off[i]))
        at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)
        keys.append(x[at])
        counts.append(np.diff(np.append(at, len(x))))
        held += len(at)
        if held > 1_000_000:
            k, c = _merge(keys, counts)
            keys, counts, held = [k], [c], len(k) // 2
    return _merge(keys, counts)


_SMALL = np.array([math.lgamma(n + 0.5) for n in range(4096)]), np.array([math.lgamma(n + 1.0) for n in range(4096)])


def _lgamma(n: np.ndarray, plus: float) -> np.ndarray:
    """log Gamma(n + plus) of counts, plus 0.5 or 1: a table, then Stirling's series."""
    table = _SMALL[0] if plus == 0.5 else _SMALL[1]
    x = np.maximum(n, 4096) + plus
    far = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n < 4096, table[np.minimum(n, 4095)], far)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the KT probability of a sequence with these counts."""
    return _lgamma(zeros, 0.5) + _lgamma(ones, 0.5) - math.log(math.pi) - _lgamma(zeros + ones, 1.0)


class Level:
    """Binary nodes of all contexts of one depth: for each bit j the node ids (context, first j bits of
    the byte), their counts, log KT, log weighted probability and the log weight of stopping here."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys, self.counts = keys, counts
        self.ids: list[np.ndarray] = []
        self.zeros: list[np.ndarray] = []
        self.ones: list[np.ndarray] = []
        for j in range(8):
            node = keys >> np.uint64(8 - j)
            at = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.empty(0, np.int64)
            bit = (keys >> np.uint64(7 - j)) & np.uint64(1)
            ones = np.add.reduceat(counts * bit.astype(np.int64), at) if len(at) else np.empty(0, np.int64)
            total = np.add.reduceat(counts, at) if len(at) else ones
            self.ids.append(node[at])
            self.ones.append(ones)
            self.zeros.append(total - ones)

    def weigh(self, below: list[np.ndarray] | None) -> None:
        """below: for each bit the sum of the children's log weighted probabilities; None at full depth."""
        self.kt = [log_kt(z, o) for z, o in zip(self.zeros, self.ones)]
        if below is None:
            self.weighted, self.stop = self.kt, [np.zeros(len(x)) for x in self.kt]
            return
        self.weighted = [_HALF + np.logaddexp(k, b) for k, b in zip(self.kt, below)]
        self.stop = [_HALF + k - w for k, w in zip(self.kt, self.weighted)]

    def children_sum(self, child: Level) -> list[np.ndarray]:
        out = []
        for j in range(8):
            parent = self._up(child.ids[j], j)
            out.append(np.bincount(np.searchsorted(self.ids[j], parent), weights=child.weighted[j], minlength=len(self.ids[j])))
        return out

    @staticmethod
    def _up(ids: np.ndarray, j: int) -> np.ndarray:
        """The id, one context byte shorter: the farthest byte lies above the j bits of the node."""
        low = np.uint64((1 << j) - 1)
        return ids >> np.uint64(8 + j) << np.uint64(j) | ids & low


def _shorter(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys without their farthest context byte."""
    return _merge([keys >> np.uint64(16) << np.uint64(8) | keys & np.uint64(255)], [counts])


def subtree(keys: np.ndarray, counts: np.ndarray, top: int) -> list[Level]:
    """Weighted levels from depth `top` to DEPTH (list index 0 is `top`)."""
    levels = [Level(keys, counts)]
    levels[0].weigh(None)
    for _ in range(DEPTH - top):
        up = Level(*_shorter(levels[0].keys, levels[0].counts))
        up.weigh(up.children_sum(levels[0]))
        levels.insert(0, up)
    return levels


def path_ratios(levels: list[Level], keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each bit j of each key of full depth: at the top level, the weighted probability without one of the key's own
    occurrences, divided by that with it.

    At the deepest node it is 1 / e with e = (n - 1/2) / all, the KT probability of the last of n equal bits among all. Above, the
    node's own share of its probability changes by 1 / e and the rest by its child's ratio."""
    for j in range(8):
        bit = ((keys >> np.uint64(7 - j)) & np.uint64(1)).astype(bool)
        node, ratio = keys >> np.uint64(8 - j), None
        for level in reversed(levels):
            at = np.searchsorted(level.ids[j], node)
            zeros, ones, stop = level.zeros[j][at], level.ones[j][at], np.exp(level.stop[j])[at]
            own = (zeros + ones) / (np.where(bit, ones, zeros) - 0.5)
            ratio = own if ratio is None else stop * own + (1 - stop) * ratio
            node = Level._up(node, j)
        yield j, ratio


def _send(ranges: int):  # noqa: ANN202
    def run(key: tuple, t: pa.Table) -> pa.Table:
        keys, counts = count_keys(t.column("text").combine_chunks())
        part = range_of(keys, ranges)
        o = np.argsort(part, kind="stable")
        keys, counts = keys[o], counts[o]
        cut = np.searchsorted(part[o], np.arange(ranges + 1))
        rows = [(r, pack(keys[cut[r] : cut[r + 1]], counts[cut[r] : cut[r + 1]])) for r in range(ranges) if cut[r] < cut[r + 1]]
        trim()
        return pa.table({"r": pa.array([x[0] for x in rows], pa.int32()), "chunk": pa.array([key[0].as_py()] * len(rows), pa.int64()), "keys": pa.array([x[1] for x in rows], pa.binary()), "bits": pa.array([None] * len(rows), pa.binary())})

    return run


def range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Range of a key by its two nearest context bytes, scattered: letters share few of the 65,536 values."""
    return (mix64(keys >> np.uint64(8 * (DEPTH - 1))) % np.uint64(ranges)).astype(np.int64)


def _read(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all chunks of a range with their counts, a few chunks merged at a time."""
    keys, counts, held = [], [], 0
    for x in t.column("keys"):
        k, c = unpack(x.as_py())
        keys.append(k)
        counts.append(c)
        held += len(k)
        if held > 1_200_000:
            k, c = _merge(keys, counts)
            keys, counts, held = [k], [c], len(k) // 2
    return _merge(keys, counts)


def _hand_up(t: pa.Table) -> pa.Table:
    """Of a range: for each node under each single context byte, its counts and the sum of the log
    weighted probabilities of its children at depth 2."""
    two = subtree(*_read(t), 2)[0]
    out = {"j": [], "id": [], "zeros": [], "ones": [], "below": []}
    for j in range(8):
        up = Level._up(two.ids[j], j)
        u, inv = np.unique(up, return_inverse=True)
        out["j"].append(np.full(len(u), j))
        out["id"].append(u.astype(np.int64))
        for n, v in (("zeros", two.zeros[j]), ("ones", two.ones[j]), ("below", two.weighted[j])):
            out[n].append(np.bincount(inv, weights=v, minlength=len(u)))
    c = {k: np.concatenate(v) for k, v in out.items()}
    return pa.table({"j": pa.array(c["j"].astype(np.int32)), "id": pa.array(c["id"]), "zeros": pa.array(c["zeros"].astype(np.int64)), "ones": pa.array(c["ones"].astype(np.int64)), "below": pa.array(c["below"])})


def crown(rows: list[tuple[int, int, int, int, float]]) -> np.ndarray:
    """Depths 1 and 0 from (bit, node under a context byte, zeros, ones, sum below): for each node under a
    context byte, (weight of stopping here, zeros, ones) at depth 0 and at depth 1, as an array [byte, node, 6]."""
    top = np.full((256, 256, 6), np.nan)
    counts, below = np.zeros((256, 2)), np.zeros(256)
    for j, i, z, o, b in rows:
        byte, node = i >> j, (1 << j) | (i & ((1 << j) - 1))
        kt = float(log_kt(np.array([z]), np.array([o]))[0])
        w = _HALF + np.logaddexp(kt, b)
        top[byte, node, 3:] = math.exp(_HALF + kt - w), z, o
        counts[node] += (z, o)
        below[node] += w
    kt = log_kt(counts[:, 0].astype(np.int64), counts[:, 1].astype(np.int64))
    top[:, :, 0] = np.exp(_HALF + kt - (_HALF + np.logaddexp(kt, below)))
    top[:, :, 1:3] = counts
    return top


def code_lengths(levels: list[Level], keys: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Bits of each key's byte in its context."""
    bits = np.zeros(len(keys))
    first = (keys >> np.uint64(8 * DEPTH)).astype(np.int64)
    byte = (keys & np.uint64(255)).astype(np.int64)
    for j, ratio in path_ratios(levels, keys):
        x = top[first, (1 << j) | (byte >> (8 - j))]
        bit = ((byte >> (7 - j)) & 1).astype(bool)
        for stop, zeros, ones in (x[:, 3:].T, x[:, :3].T):
            ratio = stop * (zeros + ones) / (np.where(bit, ones, zeros) - 0.5) + (1 - stop) * ratio
        bits += np.log2(ratio)
    return bits


def _lengths(top: np.ndarray):  # noqa: ANN202
    def run(t: pa.Table) -> pa.Table:
        keys, counts = _read(t)
        bits = code_lengths(subtree(keys, counts, 2), keys, top).astype("<f4")
        back = [bits[np.searchsorted(keys, unpack(x.as_py())[0])].tobytes() for x in t.column("keys")]
        del keys, counts, bits
        trim()
        return pa.table({"r": t.column("r"), "chunk": t.column("chunk"), "keys": t.column("keys"), "bits": pa.array(back, pa.binary())})

    return run


def _score(docs: pa.Table, lengths: pa.Table) -> pa.Table:
    keys = np.concatenate([np.empty(0, "<u8"), *(unpack(x.as_py())[0] for x in lengths.column("keys"))])
    bits = np.concatenate([np.empty(0, "<f4"), *(np.frombuffer(x.as_py(), "<f4") for x in lengths.column("bits"))])
    del lengths
    o = np.argsort(keys)
    keys, bits = keys[o], bits[o]
    del o
    texts = docs.column("text").combine_chunks()
    raw, off = buffers(texts)
    total = np.zeros(len(off) - 1)
    for i, j in slices(off):
        if off[i] < off[j]:
            local = off[i : j + 1] - off[i]
            wanted = keys_of(raw[off[i] : off[j]], local)
            o = np.argsort(wanted)
            each = np.empty(len(wanted))
            each[o] = bits[np.searchsorted(keys, wanted[o])]
            total[i:j] = np.diff(np.concatenate([[0.0], np.cumsum(each)])[local])
    n = np.diff(off)
    trim()
    return pa.table({"doc_id": docs.column("doc_id"), "n_bytes": pa.array(n), "bits": pa.array(total), "bits_per_byte": pa.array(np.where(n > 0, total / np.maximum(n, 1), 0.0), mask=n == 0)})


def lm_score(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: bytes, code length in bits given all other bytes of docs, bits per byte.

    Null and empty texts: 0 bytes, 0 bits, bits per byte null. Null doc_ids stay null; repeated rows count as
    often as they occur and are scored each; texts may have any length (none is split from its context);
    an empty table gives an empty result; other columns are ignored.
    """
    rows = narrow(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = text_bytes(rows)
    chunks, ranges = max(1, math.ceil(size / CHUNK_BYTES)), max(4, min(65536, math.ceil(size / RANGE_BYTES)))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64(F.lit(5), "doc_id", "text"), F.lit(chunks)))
    sent = saved(rows.groupBy("chunk").applyInArrow(_send(ranges), BLOBS), "contexts")
    handed = sent.groupBy("r").applyInArrow(_hand_up, "j int, id long, zeros long, ones long, below double")
    sums = handed.groupBy("j", "id").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below"))
    top = crown([(r.j, r.id, r.zeros, r.ones, r.below) for r in sums.collect()])  # 256 * 255 rows at most
    lengths = sent.groupBy("r").applyInArrow(_lengths(top), BLOBS)
    return rows.groupBy("chunk").cogroup(lengths.groupBy("chunk")).applyInArrow(_score, RESULT)
