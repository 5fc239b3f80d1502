"""Personal data by a character-level bidirectional LSTM with a conditional random field over its tags.

The network is trained in numpy from labelled spans: a generator writes lines of words with e-mail
addresses, telephone numbers, IP addresses, card and account numbers, and with numbers, dates, versions and keys
that are none of these. Forward-backward gives the gradient of the random field, backpropagation through time
that of the network; its gates and states are piecewise linear. Texts are cut into overlapping windows, every window is labelled,
and the spans of all windows of a text are reconciled together: the set of spans that don't overlap, with the largest weight.

Viterbi runs where it can matter: where even a tag with the best scores and transitions of all tags gains nothing over none, the path
without a span is the best one, and decoding would find it.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opalgrid.llm.common import buffers, narrow, slices

TAGS = ("O", "EMAIL", "PHONE", "IP", "CARD", "IBAN")
HIDDEN, WINDOW, STRIDE, LANES = 12, 256, 208, 512
STEPS, BATCH, LENGTH = 640, 24, 128
RESULT = "doc_id long, start long, length long, pii_type string, weight double"

_PAD = 0


def _classes() -> np.ndarray:
    """Class of a character by its first UTF-8 byte: each ASCII letter and mark is its own, other letters share one, as do
    blanks, line ends and control characters."""
    lut = np.full(256, 1, np.int64)
    lut[[*range(9), 11, 12, *range(14, 32), 127]] = 2
    lut[[32, 9]], lut[[10, 13]] = 3, 4
    rest = [b for b in range(33, 127) if not 48 <= b < 58]
    lut[rest] = 5 + np.arange(len(rest))
    lut[48:58] = 5 + len(rest)
    return lut


_LUT = _classes()
_DIGIT = int(_LUT[48])
#: Digits are told apart by the length of their run, those in a word with letters have the last class.
_RUNS = np.array([3, 4, 5, 10, 13, 20])
_N = _DIGIT + len(_RUNS) + 2
_AT = int(_LUT[ord("@")])
_LETTER = np.zeros(_N, bool)
_LETTER[[1, *_LUT[65:91], *_LUT[97:123]]] = True


def codes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the characters of several texts, and each text's first character."""
    lead = (raw & 0xC0) != 0x80
    first = np.concatenate([[0], np.cumsum(lead, dtype=np.int64)])[off]
    c = _LUT[raw[lead]]
    digit = c == _DIGIT
    if digit.any():
        edge = np.zeros(len(c) + 1, bool)
        edge[first] = True
        change = digit[1:] != digit[:-1]
        starts = np.flatnonzero(np.concatenate([[True], change]) | edge[:-1])
        starts = starts[digit[starts]]
        stops = np.flatnonzero(np.concatenate([change, [True]]) | edge[1:]) + 1
        stops = stops[digit[stops - 1]]
        letter = np.concatenate([_LETTER[c], [False]])
        mixed = letter[starts - 1] & ~edge[starts] | letter[stops] & ~edge[stops]
        kind = _DIGIT + np.where(mixed, len(_RUNS) + 1, np.searchsorted(_RUNS, stops - starts, side="right"))
        c[digit] = np.repeat(kind, stops - starts)
    return c, first


# ---- labelled spans


def _digits(rng: random.Random, n: int) -> str:
    return f"{rng.randrange(10**n):0{n}d}"


def _letters(rng: random.Random, n: int) -> str:
    return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))


def _pii(rng: random.Random, tag: int) -> str:
    n = rng.randrange
    d = lambda k: _digits(rng, k)
    if tag == 1:
        local = _letters(rng, n(1, 12)) + rng.choice(["", "", "." + d(n(1, 4)), d(n(1, 4)), "." + _letters(rng, n(1, 10)), "_" + _letters(rng, n(1, 6)), "-" + _letters(rng, 3), "+" + _letters(rng, 4)])
        host = rng.choice(["", "", "mail" + d(1) + ".", _letters(rng, n(2, 8)) + "."]) + _letters(rng, n(2, 12)) + rng.choice(["", "", "-" + _letters(rng, 4), d(1)]) + "." + rng.choice(["com", "org", "net", "ch", "de", "co.uk", "info"])
        out = local + "@" + host
        return out.upper() if rng.random() < 0.05 else out
    if tag == 2:
        return rng.choice([f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+{d(2)} {d(2)} {d(3)} {d(2)} {d(2)}", f"+{d(1)}-{d(3)}-{d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(7)}", f"{d(3)}.{d(3)}.{d(4)}", f"+{d(11)}", f"0{d(2)} {d(3)} {d(2)} {d(2)}"])
    if tag == 3:
        return ".".join(str(n(0, 256)) for _ in range(4))
    if tag == 5:
        body = rng.choice(["CH", "DE", "FR", "GB", "ES", "IT", "AT", "NL"]) + d(2) + rng.choice(["", "", "NWBK"]) + d(n(12, 19))
        return " ".join(body[i : i + 4] for i in range(0, len(body), 4)) if rng.random() < 0.5 else body
    return rng.choice([d(16), d(16), d(16), " ".join(d(4) for _ in range(4)), "-".join(d(4) for _ in range(4)), d(15)])


def _other(rng: random.Random) -> str:
    n = rng.randrange
    d = lambda k: _digits(rng, k)
    hexa = lambda k: "".join(rng.choices("0123456789abcdef", k=k))
    return rng.choice([
        d(n(1, 9)), d(n(1, 5)), d(4), d(n(20, 30)), f"{d(4)}-{d(2)}-{d(2)}", f"{d(2)}.{d(2)}.{d(4)}", f"{d(1)}/{d(2)}/{d(2)}", f"{d(2)}:{d(2)}", f"{d(1)}.{d(1)}", f"{d(1)}.{d(2)}.{d(1)}", f"version {d(1)}.{d(1)}", f"${d(n(1, 4))}.{d(2)}", f"{d(2)}%",
        f'token = "{hexa(40)}"', f"password={hexa(18)}", "AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=16)), "@" + _letters(rng, n(3, 9)), f"{hexa(8)}-{hexa(4)}-{hexa(4)}-{hexa(4)}-{hexa(12)}",
        f"https://{_letters(rng, 6)}.example.com/{_letters(rng, 2)}/{d(3)}?page={d(1)}", f"{_letters(rng, 3)}{d(2)}", f"{d(n(1, 3))},{d(3)}", f"({d(4)})", f"{_letters(rng, 3)} @ {_letters(rng, 3)}", f"{d(1)} {d(2)} {d(3)}", "&amp;", hexa(32),
    ])


def labelled_line(rng: random.Random, length: int) -> tuple[str, list[tuple[int, int, int]]]:
    """A line of at least `length` characters and its (start, end, tag) spans."""
    text, found = "", []
    style = rng.randrange(5)
    busy = rng.choice((0.0, 0.0, 0.02, 0.28, 0.28))  # share of words that aren't plain; most text has none for pages
    while len(text) < length:
        r = rng.random()
        if r < busy * 0.57:
            tag = rng.randrange(1, len(TAGS))
            value = _pii(rng, tag)
            before = rng.choice(["", "", "", "", "(", '"', "<", "["])
            found.append((len(text) + len(before), len(text) + len(before) + len(value), tag))
            word = before + value + {"(": ")", '"': '"', "<": ">", "[": "]", "": ""}[before]
        elif r < busy:
            word = _other(rng)
        else:
            word = _letters(rng, rng.randrange(1, 13))
            word = word.capitalize() if rng.random() < 0.15 else word.upper() if style == 4 else word
            if rng.random() < 0.12:
                at = rng.randrange(len(word))
                word = word[:at] + "é" + word[at:]
        if style == 1:
            word += rng.choice(["###", "***", "&&&", "%%%", "$$$"])
        elif style == 4:
            word += rng.choice(["", "!!"])
        if rng.random() < 0.22:
            word += rng.choice([".", ",", ".", ",", ";", ":", "!", "?"])
        text += word + (" | " if style == 2 else rng.choice([" "] * 9 + ["\n"]))
    return text, found


def batch_of(rng: random.Random, b: int, t: int) -> tuple[np.ndarray, np.ndarray]:
    x, y = np.zeros((t, b), np.int64), np.zeros((t, b), np.int64)
    for k in range(b):
        text, found = labelled_line(rng, t + 40)
        at = rng.randrange(40)
        raw = np.frombuffer(text.encode(), np.uint8)
        c, _ = codes(raw, np.array([0, len(raw)]))
        tags = np.zeros(len(c), np.int64)
        for s, e, tag in found:
            tags[s:e] = tag
        n = t if k % 6 else rng.randrange(8, t)
        x[:n, k], y[:n, k] = c[at : at + n], tags[at : at + n]
    return x, y


# ---- network


@dataclass
class Network:
    embed: np.ndarray  # direction, 4 * hidden (input, forget, output, candidate), class; bias within
    recur: np.ndarray  # direction, 4 * hidden, hidden
    out: np.ndarray  # tags, 2 * hidden
    bias: np.ndarray
    trans: np.ndarray  # tags, tags
    start: np.ndarray


def _lstm(embed: np.ndarray, recur: np.ndarray, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States (time + 1, hidden, lane) of one direction over classes x (time, lane)."""
    (t, b), n = x.shape, recur.shape[1]
    hs, c = np.zeros((t + 1, n, b), embed.dtype), np.zeros((n, b), embed.dtype)
    z, e, bound = np.empty((4 * n, b), embed.dtype), np.empty((b, 4 * n), embed.dtype), np.empty((n, b), embed.dtype)
    tape, rows, own = [], np.ascontiguousarray(embed.T), np.empty((4 * n, b), embed.dtype)
    for k in range(t):
        if keep:
            z, bound = np.empty_like(z), np.empty_like(bound)
        np.matmul(recur, hs[k], out=z)
        np.take(rows, x[k], axis=0, out=e, mode="clip")
        np.copyto(own, e.T)  # quicker than taking columns
        z += own
        gates, cand = z[: 3 * n], z[3 * n :]
        gates.clip(0, 1, out=gates)
        cand.clip(-1, 1, out=cand)
        if keep:
            tape.append((z, c, bound))
            c = c * z[n : 2 * n]
        else:
            c *= z[n : 2 * n]
        c += z[:n] * cand
        c.clip(-1, 1, out=bound)
        if keep:
            tape[-1] += (c,)
        np.multiply(z[2 * n : 3 * n], bound, out=hs[k + 1])
    return hs, tape


def _lstm_back(recur: np.ndarray, x: np.ndarray, hs: np.ndarray, tape: list, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t, n, b = grad.shape
    dh, dc = np.zeros((n, b), grad.dtype), np.zeros((n, b), grad.dtype)
    dz_all, turned = np.empty((t, 4 * n, b), grad.dtype), np.ascontiguousarray(recur.T)
    for k in range(t - 1, -1, -1):
        z, before, bound, c = tape[k]
        i, f, o, cand = z[:n], z[n : 2 * n], z[2 * n : 3 * n], z[3 * n :]
        dh += grad[k]
        dc += dh * o * (np.abs(c) < 1)
        dz = dz_all[k]
        dz[:n], dz[n : 2 * n], dz[2 * n : 3 * n], dz[3 * n :] = dc * cand, dc * before, dh * bound, dc * i
        dz[: 3 * n] *= (z[: 3 * n] > 0) & (z[: 3 * n] < 1)
        dz[3 * n :] *= np.abs(cand) < 1
        dh, dc = turned @ dz, dc * f
    rows = np.ascontiguousarray(dz_all.transpose(1, 0, 2)).reshape(4 * n, -1)
    d_embed = np.stack([np.bincount(x.reshape(-1), weights=r, minlength=_N) for r in rows]).astype(grad.dtype)
    return d_embed, np.matmul(dz_all, hs[:-1].transpose(0, 2, 1)).sum(axis=0)


def emissions(net: Network, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
    """Scores (time, tag, lane)."""
    fwd, ft = _lstm(net.embed[0], net.recur[0], x, keep)
    bwd, bt = _lstm(net.embed[1], net.recur[1], x[::-1], keep)
    n = net.recur.shape[-1]
    e = np.matmul(net.out[:, :n], fwd[1:])
    e += np.matmul(net.out[:, n:], bwd[1:][::-1])
    e += net.bias[:, None]
    return e, (fwd, ft, bwd, bt)


def gradients(net: Network, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean negative log-likelihood a character of the tags y (time, lane), and its gradients by the weights."""
    e, (fwd, ft, bwd, bt) = emissions(net, x, keep=True)
    loss, de, d_trans, d_start = crf_gradient(e.transpose(0, 2, 1), y, net.trans, net.start)
    g, n = np.ascontiguousarray(de.transpose(0, 2, 1)).astype(e.dtype) / x.size, net.recur.shape[-1]
    back = np.ascontiguousarray(g[::-1])
    e0, r0 = _lstm_back(net.recur[0], x, fwd, ft, np.matmul(net.out[:, :n].T, g))
    e1, r1 = _lstm_back(net.recur[1], x[::-1], bwd, bt, np.matmul(net.out[:, n:].T, back))
    d_out = np.concatenate([np.matmul(d, h[1:].transpose(0, 2, 1)).sum(axis=0) for h, d in ((fwd, g), (bwd, back))], axis=1)
    return loss / x.size, [np.stack([e0, e1]), np.stack([r0, r1]), d_out, g.sum(axis=(0, 2)), d_trans / x.size, d_start / x.size]


def _lse(z: np.ndarray, axis: int) -> np.ndarray:
    m = z.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(z - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def crf_gradient(e: np.ndarray, y: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Negative log-likelihood of the tags y (time, lane) and its gradients by emissions, transitions and start."""
    t, b, k = e.shape
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0] + start
    for s in range(1, t):
        alpha[s] = _lse(alpha[s - 1][:, :, None] + trans, 1) + e[s]
    for s in range(t - 2, -1, -1):
        beta[s] = _lse(trans + (beta[s + 1] + e[s + 1])[:, None, :], 2)
    z = _lse(alpha[-1], 1)
    p = np.exp(alpha + beta - z[None, :, None])
    pair = np.exp(alpha[:-1, :, :, None] + trans + (beta[1:] + e[1:])[:, :, None, :] - z[None, :, None, None])
    lanes = np.arange(b)
    gold = start[y[0]] + sum(e[s, lanes, y[s]] for s in range(t)) + sum(trans[y[s - 1], y[s]] for s in range(1, t))
    hot = np.eye(k, dtype=e.dtype)
    d_trans = pair.sum(axis=(0, 1)) - np.einsum("sbi,sbj->ij", hot[y[:-1]], hot[y[1:]])
    return float((z - gold).sum()), p - hot[y], d_trans, (p[0] - hot[y[0]]).sum(axis=0)


@cache
def train(steps: int = STEPS, seed: int = 23) -> Network:
    """The trained network; it depends on its parameters alone, so a process trains it once."""
    lines, rng = random.Random(seed), np.random.default_rng(seed)
    f = np.float32
    k = len(TAGS)
    h = HIDDEN
    net = Network((rng.normal(size=(2, 4 * h, _N)) * 0.3).astype(f), (rng.normal(size=(2, 4 * h, h)) * 0.2).astype(f), (rng.normal(size=(k, 2 * h)) * 0.2).astype(f), np.zeros(k, f), np.zeros((k, k), f), np.zeros(k, f))
    net.embed[:, :h] += f(0.5)
    net.embed[:, h : 2 * h] += f(0.8)
    net.embed[:, 2 * h : 3 * h] += f(0.5)
    params = [net.embed, net.recur, net.out, net.bias, net.trans, net.start]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        _, grads = gradients(net, *batch_of(lines, BATCH, LENGTH))
        norm = math.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = 0.02 * min(1, step / 20) * (0.05 + 0.95 * (1 - step / steps))
        for q, g, a, c in zip(params, grads, m, v):
            g = g * min(1.0, 0.5 / (norm + 1e-12))
            a *= 0.9
            a += 0.1 * g
            c *= 0.99
            c += 0.01 * g * g
            q -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(c / (1 - 0.99**step)) + 1e-6)).astype(f)
    return net


def viterbi(e: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Best tags (time, lane) of emissions (time, lane, tag); ties go to the lower tag."""
    t, b, k = e.shape
    back = np.empty((t, b, k), np.int8)
    score = e[0] + start
    for s in range(1, t):
        z = score[:, :, None] + trans
        back[s] = z.argmax(axis=1)
        score = z.max(axis=1) + e[s]
    tags = np.empty((t, b), np.int64)
    tags[-1] = score.argmax(axis=1)
    for s in range(t - 1, 0, -1):
        tags[s - 1] = back[s, np.arange(b), tags[s]]
    return tags


# ---- windows and spans


def reconcile(spans: list[tuple[int, int, int, float, bool]]) -> list[tuple[int, int, int, float]]:
    """Of (start, end, tag, weight, cut) of all windows of a text, spans that don't overlap, with the largest
    sum of weights. A span cut by a window's edge goes if a whole one overlaps it; cut ones of one tag
    that touch are first joined."""
    whole = sorted({(s, e, t): w for s, e, t, w, cut in sorted(spans, key=lambda x: x[3]) if not cut}.items())
    joined: list[list] = []
    for s, e, t, w, _ in sorted(x for x in spans if x[4]):
        if joined and joined[-1][2] == t and s <= joined[-1][1]:
            joined[-1][1], joined[-1][3] = max(e, joined[-1][1]), max(w, joined[-1][3]) + 1e-6
        elif not any(a < e and s < b for (a, b, _), _ in whole):
            joined.append([s, e, t, w])
    items = sorted([(e, s, t, w) for (s, e, t), w in whole] + [(e, s, t, w) for s, e, t, w in joined])
    ends = [x[0] for x in items]
    best: list[tuple[float, int, int]] = [(0.0, 0, -1)]  # sum, spans used before, item
    for k, (_, s, _, w) in enumerate(items):
        p = int(np.searchsorted(ends[:k], s, side="right"))
        take = best[p][0] + w
        best.append((take, p, k) if take > best[k][0] else (best[k][0], k, -1))
    out, k = [], len(items)
    while k:
        _, before, item = best[k]
        if item >= 0:
            e, s, t, w = items[item]
            out.append((s, e, t, w))
        k = before
    return out[::-1]


def without_span(e: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Lanes of emissions (time, tag, lane) whose best path is surely the one without a span: all tags but none are taken as one that has the best
    of their scores and transitions at every step, and even its best path gains nothing."""
    enter, stay, leave = trans[0, 1:].max() - trans[0, 0], trans[1:, 1:].max() - trans[0, 0], trans[1:, 0].max() - trans[0, 0]
    lead = e[:, 1:].max(axis=1) - e[:, 0]
    none, some = np.zeros_like(lead[0]), lead[0] + (start[1:].max() - start[0])
    for x in lead[1:]:
        none, some = np.maximum(none, some + leave), np.maximum(none + enter, some + stay) + x
    return np.maximum(none, some) <= 0


def find(net: Network, chars: np.ndarray, first: np.ndarray, everywhere: bool = False) -> list[tuple[int, int, int, int, float]]:
    """(text, start, end, tag, weight) of several texts. `everywhere` runs Viterbi over windows that surely have no span too."""
    sizes = np.diff(first)
    per = np.where(sizes > 0, np.maximum(1, -(-(sizes - (WINDOW - STRIDE)) // STRIDE)), 0)
    text = np.repeat(np.arange(len(sizes)), per)
    begin = STRIDE * (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per))
    # by definition an e-mail address holds an `@` and each other type a digit; a reading without it is no span
    holds = [np.concatenate([[0], np.cumsum(x, dtype=np.int32)]) for x in (chars >= _DIGIT, chars == _AT)]
    lo = first[text] + begin
    hi = np.minimum(lo + WINDOW, first[text + 1])
    by: dict[int, list] = {}
    for a in range(0, len(lo), LANES):
        at = lo[a : a + LANES][None, :] + np.arange(WINDOW)[:, None]
        inside = at < hi[a : a + LANES]
        x = np.where(inside, chars[np.minimum(at, len(chars) - 1)], _PAD)
        e, _ = emissions(net, x)
        some = np.arange(x.shape[1]) if everywhere else np.flatnonzero(~without_span(e, net.trans, net.start))
        if not len(some):
            continue
        e, inside = np.ascontiguousarray(e[:, :, some].transpose(0, 2, 1)), inside[:, some]
        tags = np.where(inside, viterbi(e, net.trans, net.start), 0)
        gain = np.take_along_axis(e, tags[:, :, None], 2)[:, :, 0] - e[:, :, 0]
        edge = np.zeros((1, tags.shape[1]), np.int64)
        padded = np.concatenate([edge, tags, edge])
        change = padded[1:] != padded[:-1]
        for lane in np.flatnonzero((tags > 0).any(axis=0)):
            cuts = np.flatnonzero(change[:, lane])
            k = a + int(some[lane])
            for s, t in zip(cuts[:-1], cuts[1:]):
                tag = int(tags[s, lane])
                if tag and holds[tag == 1][lo[k] + t] > holds[tag == 1][lo[k] + s]:
                    cut = bool(s == 0 and begin[k] > 0 or t == WINDOW and lo[k] + t < first[text[k] + 1])
                    by.setdefault(int(text[k]), []).append((int(begin[k] + s), int(begin[k] + t), tag, float(gain[s:t, lane].sum()), cut))
    return [(d, *x) for d in sorted(by) for x in reconcile(by[d])]


def _detect(net: Network):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, (raw, off) = batch.column(0).to_pylist(), buffers(batch.column(1))
            rows = []
            for i, j in slices(off):
                if off[i] < off[j]:
                    rows += [(ids[i + d], s, e - s, TAGS[t], round(w, 3)) for d, s, e, t, w in find(net, *codes(raw[off[i] : off[j]], off[i : j + 1] - off[i]))]
            cols = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (*(pa.int64(),) * 3, pa.string(), pa.float64()))], [x.split()[0] for x in RESULT.split(", ")])

    return run


def pii(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """One row for each span of personal data: start and length in characters, type, weight (how far the
    network prefers its tags to none).

    Null and empty texts give no rows, nor does an empty table; a null doc_id stays null; repeated rows
    give repeated spans; texts of any length are covered by windows; of overlapping readings the heavier
    counts, of equal ones the earlier; other columns are ignored.
    """
    return narrow(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_detect(net or train()), RESULT)
