"""Context-tree weighting against a plain recursive version."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa

from opalgrid.llm import ctw


def brute(texts: list[str]) -> list[float]:
    """Code length of each text by direct recursion over context strings."""
    counts: dict = defaultdict(lambda: [0, 0])
    kids = defaultdict(set)
    steps = []
    for t in texts:
        data = bytes(ctw.DEPTH) + t.encode()
        own = []
        for i in range(ctw.DEPTH, len(data)):
            ctx = data[i - ctw.DEPTH : i][::-1]
            for j in range(8):
                node, bit = (1 << j) | (data[i] >> (8 - j)), (data[i] >> (7 - j)) & 1
                own.append((ctx, node, bit))
                for d in range(ctw.DEPTH + 1):
                    counts[ctx[:d], node][bit] += 1
                    if d:
                        kids[ctx[: d - 1], node].add(ctx[:d])
        steps.append(own)

    def kt(a: int, b: int) -> float:
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    memo: dict = {}

    def weighted(ctx: bytes, node: int) -> float:
        if (ctx, node) not in memo:
            k = kt(*counts[ctx, node])
            memo[ctx, node] = k if len(ctx) == ctw.DEPTH else math.log(0.5) + np.logaddexp(k, sum(weighted(c, node) for c in kids[ctx, node]))
        return memo[ctx, node]

    def without(ctx: bytes, node: int, bit: int) -> float:
        """log of the weighted probability at the root, with one occurrence of bit taken out of its path."""
        w = 0.0
        for d in range(ctw.DEPTH, -1, -1):
            a, b = counts[ctx[:d], node]
            k = kt(a - (bit == 0), b - (bit == 1))
            w = k if d == ctw.DEPTH else math.log(0.5) + np.logaddexp(k, w + sum(weighted(c, node) for c in kids[ctx[:d], node] if c != ctx[: d + 1]))
        return w

    return [-sum(weighted(b"", node) - without(ctx, node, bit) for ctx, node, bit in own) / math.log(2) for own in steps]


def test_kt_is_the_sequential_product():
    p, zeros, ones = 0.0, 0, 0
    for bit in (1, 0, 1, 1, 0):
        p += math.log(((ones if bit else zeros) + 0.5) / (zeros + ones + 1))
        zeros, ones = zeros + (bit == 0), ones + bit
    assert abs(p - ctw.log_kt(np.array([zeros]), np.array([ones]))[0]) < 1e-9
    big = ctw.log_kt(np.array([10_000]), np.array([5]))[0]
    assert abs(big - (math.lgamma(10_000.5) + math.lgamma(5.5) - math.log(math.pi) - math.lgamma(10_006))) < 1e-6


def test_scores_match_brute_force(spark):
    texts = ["abracadabra abracadabra", "the cat sat on the mat", "", "ünïcödé ünïcödé", "abracadabra", "x" * 3000, "abracadabra"]
    rows = [(i, t, "extra") for i, t in enumerate(texts)] + [(None, "the cat", "x"), (99, None, None)]
    got = ctw.lm_score(spark.createDataFrame(rows, "doc_id long, text string, chunk string").repartition(3)).collect()
    want = brute([r[1] or "" for r in rows])
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    for (i, t, _), w in zip(rows, want):
        assert abs(by[i].bits - w) < 1e-2 + 1e-4 * w, (i, by[i].bits, w)
        assert by[i].n_bytes == len((t or "").encode())
        assert (by[i].bits_per_byte is None) == (not t)


def test_packed_keys_come_back():
    rng = np.random.default_rng(1)
    keys = np.unique(np.concatenate([rng.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2), np.arange(300, dtype=np.uint64), np.array([(1 << 64) - 1], np.uint64)]))
    counts = rng.integers(1, 1 << 40, len(keys))
    k, c = ctw.unpack(ctw.pack(keys, counts))
    assert (k == keys).all() and (c == counts).all() and len(ctw.unpack(ctw.pack(keys[:0], counts[:0]))[0]) == 0


def test_a_text_that_occurs_twice_costs_less(spark):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(400)]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(120)]
    got = {r.doc_id: r.bits_per_byte for r in ctw.lm_score(spark.createDataFrame([*enumerate(texts), *((200 + k, texts[k]) for k in range(10))], "doc_id long, text string")).collect()}
    assert max(got[k] for k in range(10)) < min(got[k] for k in range(10, 120)) and all(abs(got[k] - got[200 + k]) < 1e-9 for k in range(10))


def test_empty_table(spark):
    assert ctw.lm_score(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_counts_survive_merging():
    texts = pa.array(["abcabc", "bcabca"])
    k, c = ctw.count_keys(texts)
    assert c.sum() == 12 and (np.diff(k.astype(np.int64)) > 0).all()
