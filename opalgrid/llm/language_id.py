"""Language identification by a bidirectional gated recurrent network over bytes.

Each direction is a minimal gated unit (one gate that both resets and updates) with piecewise-linear
activations; forward and backward states together give language probabilities for every byte. A
document's probabilities are the mean over all its bytes. The network is trained in numpy by
backpropagation through time on windows of documents whose language is given, and on generated
strings without language (class `zxx`), the ground for rejecting a document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opalgrid.llm.common import SLICE_BYTES, buffers, map_rows, narrow, slices, trim

HIDDEN, WINDOW, CONTEXT, LANES = 16, 160, 16, 512
#: Bound on the labelled documents that the network is fitted on, and the share of them held out to say when to stop.
TRAIN_DOCS, HELD_OUT = 1200, 0.15
#: Most steps, steps between two looks at the held-out documents, and bytes of held-out text that a look takes.
TRAIN_STEPS, LOOK, LOOK_BYTES = 480, 30, 200_000
#: Windows of a step. They are as long as those that are labelled later, so that states don't drift where training never was.
TRAIN_BATCH = 64
NONE = "zxx"
#: Least mean probability of `zxx` that rejects a text, with so many bytes of a language as prior evidence: what a
#: few bytes say is weak, and weak evidence keeps.
REJECT, PRIOR_BYTES = 0.7, 32
RESULT = "doc_id long, lang_pred string, probability double, n_bytes long, n_positions_pred long, n_switches long, accepted boolean"


@dataclass
class Network:
    """Weights: columns of 257 bytes (256 is padding) by direction, recurrences, output. Of the 2 * hidden rows of a
    direction the first half is the gate, the second the candidate state."""

    langs: list[str]
    embed: np.ndarray  # direction, 2 * hidden, 257
    recur: np.ndarray  # direction, 2 * hidden, hidden
    out: np.ndarray  # 2 * hidden, classes
    bias: np.ndarray
    held_out: float = math.nan  # loss over documents that weren't used in the fit
    steps: int = 0

    def weights(self) -> list[np.ndarray]:
        return [self.embed, self.recur, self.out, self.bias]


def _run(x: np.ndarray, embed: np.ndarray, recur: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """States of one direction for x (time, lane) -> (time + 1, hidden, lane); the tape holds what BPTT needs."""
    (t, b), size = x.shape, recur.shape[1]
    hs = np.zeros((t + 1, size, b), embed.dtype)
    z, e, n = np.empty((2 * size, b), embed.dtype), np.empty((2 * size, b), embed.dtype), np.empty((size, b), embed.dtype)
    f, q = z[:size], z[size:]
    tape, rows, taken = [], np.ascontiguousarray(embed.T), np.empty((b, 2 * size), embed.dtype)
    for k in range(t):
        if keep:
            z, n = np.empty_like(z), np.empty_like(n)
            f, q = z[:size], z[size:]
        h, new = hs[k], hs[k + 1]
        np.matmul(recur, h, out=z)
        np.take(rows, x[k], axis=0, out=taken, mode="clip")
        np.copyto(e, taken.T)  # quicker than taking columns
        f += e[:size]
        f.clip(0, 1, out=f)
        np.multiply(q, f, out=n)
        n += e[size:]
        n.clip(-1, 1, out=n)
        if keep:
            tape.append((f, n, q))
        np.subtract(n, h, out=new)
        new *= f
        new += h
    return hs, tape


def _back(x: np.ndarray, hs: np.ndarray, tape: list, recur: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the columns and recurrences from the gradient of every state (time, hidden, lane)."""
    t, size, b = grad.shape
    at_byte, at_state = (np.empty((t, 2 * size, b), grad.dtype) for _ in range(2))
    dh, turned = np.zeros((size, b), grad.dtype), np.ascontiguousarray(recur.T)
    for k in range(t - 1, -1, -1):
        f, n, q = tape[k]
        h = hs[k]
        dh += grad[k]
        dc = dh * f * (np.abs(n) < 1)
        da = (dh * (n - h) + dc * q) * ((f > 0) & (f < 1))
        at_byte[k, :size] = at_state[k, :size] = da
        at_byte[k, size:] = dc
        np.multiply(dc, f, out=at_state[k, size:])
        dh *= 1 - f
        dh += turned @ at_state[k]
    codes, rows = x.reshape(-1), np.ascontiguousarray(at_byte.transpose(1, 0, 2)).reshape(2 * size, -1)
    d_embed = np.stack([np.bincount(codes, weights=r, minlength=257) for r in rows]).astype(grad.dtype)
    return d_embed, np.matmul(at_state, hs[:-1].transpose(0, 2, 1)).sum(axis=0)


def _logits(net: Network, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
    """Scores (time, class, lane)."""
    fwd, ft = _run(x, net.embed[0], net.recur[0], keep)
    bwd, bt = _run(x[::-1], net.embed[1], net.recur[1], keep)
    size = net.recur.shape[-1]
    scores = np.matmul(net.out[:size].T, fwd[1:])
    scores += np.matmul(net.out[size:].T, bwd[1:][::-1])
    scores += net.bias[:, None]
    return scores, (fwd, ft, bwd, bt)


def noise(rng: np.random.Generator, n: int, size: int) -> np.ndarray:
    """Byte windows without language: digits, hex, base64, symbols, random bytes, runs of one byte."""
    alphabets = [b"0123456789 .,:-/", b"0123456789abcdef", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", b"#*&%$=-_~|<>{}[]()@!?;:.,/\\ ", b"\t\n |0123456789", bytes(range(256))]
    out = np.empty((n, size), np.int64)
    for k in range(n):
        a = np.frombuffer(alphabets[k % len(alphabets)], np.uint8)
        out[k] = a[rng.integers(0, len(a), size)] if k % 7 else a[rng.integers(0, len(a))]
    return out


def gradients(net: Network, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy of the classes y of the lanes of x (time, lane) over all bytes that aren't padding, and its
    gradients by the weights."""
    b, size = x.shape[1], net.recur.shape[-1]
    real = (x < 256)[:, None, :].astype(net.bias.dtype)
    scores, (fwd, ft, bwd, bt) = _logits(net, x, keep=True)
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    p = e / e.sum(axis=1, keepdims=True)
    lanes = np.arange(b)
    loss = float(-(np.log(np.maximum(p[:, y, lanes], 1e-30)) * real[:, 0]).sum() / real.sum())
    p[:, y, lanes] -= 1
    g = p * (real / real.sum())
    back = np.ascontiguousarray(g[::-1])
    e0, r0 = _back(x, fwd, ft, net.recur[0], np.matmul(net.out[:size], g))
    e1, r1 = _back(x[::-1], bwd, bt, net.recur[1], np.matmul(net.out[size:], back))
    d_out = np.concatenate([np.matmul(h[1:], d.transpose(0, 2, 1)).sum(axis=0) for h, d in ((fwd, g), (bwd, back))])
    return loss, [np.stack([e0, e1]), np.stack([r0, r1]), d_out, g.sum(axis=(0, 2))]


def _held_out_loss(net: Network, texts: list[np.ndarray], labels: list[str], junk: np.ndarray) -> float:
    """Mean over classes of the loss a document: minus the log of the pooled probability of its class."""
    raw, off = np.concatenate([*texts, *junk.astype(np.uint8)]), np.concatenate([[0], np.cumsum([*map(len, texts), *[junk.shape[1]] * len(junk)])])
    _, sums, _ = label_positions(net, raw, off)
    p = sums / sums.sum(axis=1, keepdims=True)
    y = np.array([net.langs.index(c) for c in [*labels, *[NONE] * len(junk)]])
    loss = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-9))
    return float(np.mean([loss[y == c].mean() for c in np.unique(y)]))


def train(texts: list[str], labels: list[str], steps: int = TRAIN_STEPS, seed: int = 17) -> Network | None:
    """A network for the labels given plus `zxx`; None if there is nothing to learn from.

    Each class is drawn as often as any other. Some documents are held out; every LOOK steps they are
    labelled as whole texts, the weights with the least loss on them are kept, and training ends when two looks in a row were
    no better. Without documents to hold out it runs to the last step.
    """
    data = [(np.frombuffer(t.encode("utf-8", "replace"), np.uint8), lab) for t, lab in zip(texts, labels) if t and lab and t.strip()]
    if not data:
        return None
    rng = np.random.default_rng(seed)
    langs = sorted({lab for _, lab in data})
    classes = [*langs, NONE] if NONE not in langs else langs
    order, aside, seen = rng.permutation(len(data)), [], 0
    for i in order[: int(len(data) * HELD_OUT)]:
        if seen + len(data[i][0]) <= LOOK_BYTES:
            aside.append(data[i])
            seen += len(data[i][0])
    chosen = {id(d) for d, _ in aside}
    by = [[d for d, lab in data if lab == c and id(d) not in chosen] for c in classes]
    if not all(own or c == NONE for c, own in zip(classes, by)):
        aside, by = [], [[d for d, lab in data if lab == c] for c in classes]
    k, size, b, t = len(classes), HIDDEN, TRAIN_BATCH, WINDOW + 2 * CONTEXT
    f = np.float32
    net = Network(classes, (rng.normal(size=(2, 2 * size, 257)) * 0.3).astype(f), (rng.normal(size=(2, 2 * size, size)) * 0.25).astype(f), (rng.normal(size=(2 * size, k)) * 0.2).astype(f), np.zeros(k, f))
    net.embed[:, :size] += f(0.5)
    params = net.weights()
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    best, kept, worse = math.inf, [p.copy() for p in params], 0
    junk_aside = noise(np.random.default_rng(seed + 1), 24, 400)
    for step in range(1, steps + 1):
        y = rng.permutation(np.arange(b) % k)
        x = np.full((b, t), 256, np.int64)
        junk = noise(rng, b, t)
        for i, c in enumerate(y):
            if not by[c]:
                x[i] = junk[i]
            else:
                d = by[c][rng.integers(0, len(by[c]))]
                at = int(rng.integers(0, max(1, len(d) - t + 1))) if i % 3 else 0
                piece = d[at : at + t]
                x[i, : len(piece)] = piece
            if rng.random() < 0.3:  # short documents: the rest is padding
                x[i, int(rng.integers(3, 60)) :] = 256
        loss, grads = gradients(net, np.ascontiguousarray(x.T), y)
        norm = math.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = 0.02 * min(1, step / 30) * (0.1 + 0.9 * (1 - step / steps))
        for q, gr, a, c in zip(params, grads, m, v):
            gr = gr * min(1.0, 1.0 / (norm + 1e-12))
            a *= 0.9
            a += 0.1 * gr
            c *= 0.99
            c += 0.01 * gr * gr
            q -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(c / (1 - 0.99**step)) + 1e-6)).astype(f)
        net.steps = step
        if aside and (step % LOOK == 0 or step == steps):
            now = _held_out_loss(net, [d for d, _ in aside], [lab for _, lab in aside], junk_aside)
            if now < best - 1e-4:
                best, kept, worse = now, [p.copy() for p in params], 0
            else:
                worse += 1
            if worse == 2 or best < 1e-3:
                break
    if aside:
        for p, q in zip(params, kept):
            p[...] = q
        net.held_out = best
    return net


def label_positions(net: Network, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of every byte, probabilities summed over the bytes of each text (text, class), and bytes by class."""
    k, span = len(net.langs), WINDOW + 2 * CONTEXT
    sizes = np.diff(offsets)
    per = -(-sizes // WINDOW)
    text = np.repeat(np.arange(len(sizes)), per)
    first = offsets[:-1][text] + WINDOW * (np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per))
    labels = np.empty(len(raw), np.int8)
    sums, counts = np.zeros((len(sizes), k)), np.zeros((len(sizes), k), np.int64)
    for i in range(0, len(first), LANES):
        s, own = first[i : i + LANES], text[i : i + LANES]
        at = s[None, :] - CONTEXT + np.arange(span)[:, None]
        inside = (at >= offsets[own]) & (at < offsets[own + 1])
        x = np.where(inside, raw[np.clip(at, 0, len(raw) - 1)].astype(np.int64), 256)
        scores, _ = _logits(net, x)
        core = inside[CONTEXT : CONTEXT + WINDOW]
        z = np.ascontiguousarray(scores[CONTEXT : CONTEXT + WINDOW].transpose(1, 0, 2))
        most = z[0].copy()
        for c in range(1, k):
            np.maximum(most, z[c], out=most)
        top = np.zeros(most.shape, np.int8)
        for c in range(k - 1, 0, -1):
            top[z[c] == most] = c
        top[z[0] == most] = 0
        labels[at[CONTEXT : CONTEXT + WINDOW][core]] = top[core]
        z -= most
        np.exp(z, out=z)
        z *= core / z.sum(axis=0)
        np.add.at(sums, own, z.sum(axis=1, dtype=np.float64).T)
        np.add.at(counts, own, np.stack([((top == c) & core).sum(axis=0) for c in range(k)], 1))
    return labels, sums, counts


def _classify(net: Network | None):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw_all, off_all = buffers(batch.column(1))
            out = {n: [] for n in ("pred", "prob", "n", "same", "switches", "none")}
            for i, j in slices(off_all, SLICE_BYTES // 2):
                raw, off = raw_all[off_all[i] : off_all[j]], off_all[i : j + 1] - off_all[i]
                n = np.diff(off)
                out["n"].append(n)
                if net is None or not len(raw):
                    out["pred"].append(np.full(j - i, -1))
                    for c in ("prob", "same", "switches", "none"):
                        out[c].append(np.zeros(j - i))
                    continue
                labels, sums, counts = label_positions(net, raw, off)
                best = np.where(n > 0, sums.argmax(axis=1), -1)
                switch = np.flatnonzero(labels[1:] != labels[:-1]) + 1
                own = np.searchsorted(off, switch, side="right") - 1
                out["pred"].append(best)
                out["prob"].append(sums.max(axis=1) / np.maximum(n, 1))
                out["same"].append(counts[np.arange(j - i), best])
                out["switches"].append(np.bincount(own[switch > off[own]], minlength=j - i))
                out["none"].append(sums[:, net.langs.index(NONE)] / (n + PRIOR_BYTES))
            pred, prob, n, same, switches, none = (np.concatenate(x) if x else np.empty(0) for x in out.values())
            names = np.array([*(net.langs if net else []), None], object)
            known = names[pred.astype(int)]
            keep = (n > 0) if net is None else (pred >= 0) & ((known != NONE) | (none < REJECT))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(known, pa.string()), pa.array(np.where(pred >= 0, prob, np.nan), pa.float64(), mask=pred < 0), pa.array(n.astype(np.int64)), pa.array(np.where(pred >= 0, same, 0).astype(np.int64)), pa.array(switches.astype(np.int64)), pa.array(keep)],
                ["doc_id", "lang_pred", "probability", "n_bytes", "n_positions_pred", "n_switches", "accepted"],
            )

    return run


def fit(docs: DataFrame, most: int = TRAIN_DOCS) -> Network | None:
    """The network of at most `most` labelled documents, those with the smallest hash of their id; of rows with one
    doc_id the smallest text counts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter("lang is not null and trim(lang) != '' and length(trim(text)) > 0")
    chosen = rows.select("doc_id", F.xxhash64(F.lit(17), "doc_id").alias("h")).distinct().orderBy("h", "doc_id").limit(most)
    one = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("r"))
    sample = sorted(one.select("doc_id", "r.text", "r.lang").collect(), key=lambda r: r.doc_id)
    net = train([r.text for r in sample], [r.lang for r in sample])
    del sample
    trim()
    return net


def language_id(docs: DataFrame, net: Network | None = None, most: int = TRAIN_DOCS) -> DataFrame:
    """One row for each row of docs: the language whose mean probability over all bytes is highest, that
    mean, the bytes, the bytes with that label, the changes of label along the text, and `accepted`.

    Not accepted: text that is null or empty (no label, probability null), and text whose highest class
    is `zxx` with a mean probability of REJECT or more after PRIOR_BYTES of prior evidence for a language. If no document has a language to learn from, labels are null and any text is accepted.
    Without `net` it is fitted on a bounded sample of docs with `lang`. Null doc_ids stay null; repeated
    rows give repeated results; ties go to the first language in order; other columns are ignored.
    """
    if net is None:
        net = fit(docs, most)
    return narrow(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_classify(net), RESULT)


def accepted(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """The rows of docs that language identification accepts, with all their columns, in one pass."""
    if net is None:
        net = fit(docs)
    classify = _classify(net)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.array(np.zeros(batch.num_rows, np.int64))
            (result,) = classify(iter([pa.RecordBatch.from_arrays([ids, batch.column(at)], ["doc_id", "text"])]))
            yield batch.filter(result.column("accepted"))

    return map_rows(docs, keep)
