"""Mixing to target weights by soft membership.

A classifier of the labelled table gives every document its probabilities of the domains `high`, `low`
and `toxic`. Rates from 0 to MOST_RATE are then fitted so that the expected tokens of each domain,
sum of rate * tokens * probability, meet the targets: least squares by projected gradient. A round is one
pass over the table of probabilities that tries several steps at once, each cut to the bounds: along the gradient, from
the step 1 / L that can't fail to lower the error up to longer ones, and along the gradient weighted by the inverse of
sum(tokens * p p') over the documents whose rates aren't at a bound, which is exact where none is cut. The best
step is taken, so the error never rises. The driver holds a few numbers for each step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField

from opalgrid.llm.common import SLICE_BYTES, buffers, map_rows, narrow, saved, slices, trim, unit_hash
from opalgrid.llm.words import word_hashes

DOMAINS = ("high", "low", "toxic")
TARGETS = {"high": 0.85, "low": 0.10, "toxic": 0.05}
#: Bound on the labelled documents of the fit, and on the words that it keeps for each domain.
TRAIN_DOCS, WORDS = 4000, 256
#: The fit ends when the tokens of the domains are off by this share of all tokens, or when the best step lowers the squared
#: error by less than this share of it: then no rates within the bounds come nearer.
TOLERANCE, STALLED = 1e-6, 1e-4
#: Most copies of one document. With the bound, targets that few documents could only meet in thousands of copies stay unmet, and the residual says so.
MOST_RATE = 1000.0
_SHAPES = 6


@dataclass
class Classifier:
    """Softmax regression on the presence of chosen words and on shares of kinds of bytes."""

    words: np.ndarray
    weights: np.ndarray  # words + shapes + 1, domains
    mean: np.ndarray
    scale: np.ndarray


def _shapes(raw: np.ndarray, off: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """For each text: shares of digits, capitals, marks and line ends, mean word length, log of length."""
    kind = np.zeros((4, 256))
    kind[0, 48:58] = kind[1, 65:91] = 1
    kind[2, list(b"#$%&*!|=<>{}~^")] = kind[3, list(b"\n")] = 1
    n = np.maximum(np.diff(off), 1)
    sums = [np.diff(np.concatenate([[0], np.cumsum(k[raw])])[off]) / n for k in kind]
    return np.stack([*sums, n / np.maximum(tokens, 1) / 10, np.log1p(tokens) / 10], 1)


def _features(raw: np.ndarray, off: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens and shapes of each text, and the (text, word number) of the chosen words in it."""
    h, d = word_hashes(raw, off)
    tokens = np.bincount(d, minlength=len(off) - 1) if len(d) else np.zeros(len(off) - 1, np.int64)
    if len(words):
        seen = np.zeros(1 << 16, bool)
        seen[(words >> np.uint64(48)).astype(np.int64)] = True
        m = seen[(h >> np.uint64(48)).astype(np.int64)]
        h, d = h[m], d[m]
        at = np.minimum(np.searchsorted(words, h), len(words) - 1)
        hit = words[at] == h
        both = np.unique(d[hit] * len(words) + at[hit])
        d, at = both // len(words), both % len(words)
    else:
        d = at = np.empty(0, np.int64)
    return tokens, _shapes(raw, off, tokens), d, at


def train(texts: list[str], domains: list[int], steps: int = 300) -> Classifier | None:
    """None if fewer than two domains are labelled."""
    if len(set(domains)) < 2:
        return None
    raw, off = buffers(pa.array(texts, pa.string()))
    y = np.array(domains)
    pieces = [(i, raw[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in slices(off, SLICE_BYTES // 2)]
    found = []
    for i, part, at in pieces:
        h, d = word_hashes(part, at)
        o = np.lexsort((h, d))
        h, d = h[o], d[o]
        m = np.ones(len(h), bool)
        m[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        found.append((h[m], (d[m] + i).astype(np.int32)))
    u, inv = np.unique(np.concatenate([h for h, _ in found]), return_inverse=True)
    pairs = np.concatenate([d for _, d in found]) * np.int64(len(u)) + inv
    del found, inv
    df = np.bincount(pairs % len(u), minlength=len(u))
    chosen: set[int] = set()
    for c in range(len(DOMAINS)):
        own = y == c
        if not own.any() or own.all():
            continue
        inside = np.bincount((pairs % len(u))[own[pairs // len(u)]], minlength=len(u))
        n, k = len(y), own.sum()
        chi = (inside * n - df * k) ** 2 / np.maximum(1.0 * df * (n - df) * k * (n - k), 1)
        chi[df < 5] = 0
        chosen |= set(np.argsort(-chi, kind="stable")[:WORDS][np.sort(chi)[::-1][:WORDS] > 0].tolist())
    words = np.sort(u[sorted(chosen)]) if chosen else np.empty(0, np.uint64)
    parts = [(i, *_features(part, at, words)) for i, part, at in pieces]
    shapes = np.concatenate([x[2] for x in parts])
    mean, scale = shapes.mean(axis=0), shapes.std(axis=0) + 1e-6
    x = np.zeros((len(y), len(words) + _SHAPES + 1), np.float32)
    for i, _, _, d, at in parts:
        x[i + d, at] = 1
    x[:, len(words) : -1] = np.clip((shapes - mean) / scale, -5, 5)
    x[:, -1] = 1
    w = np.zeros((x.shape[1], len(DOMAINS)), np.float32)
    present = np.array([(y == c).any() for c in range(len(DOMAINS))])
    none = np.where(present, 0, -30).astype(np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    target = np.eye(len(DOMAINS), dtype=np.float32)[y]
    for step in range(1, steps + 1):
        p = _softmax(x @ w + none)
        g = x.T @ (p - target) / len(y) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= (0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    w = w.astype(np.float64)
    w[-1] += np.where(present, 0, -30)
    return Classifier(words, w, mean, scale)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def predict(model: Classifier | None, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and domain probabilities of each text; without a model all domains are as likely."""
    if model is None:
        tokens = _features(raw, off, np.empty(0, np.uint64))[0]
        return tokens, np.full((len(off) - 1, len(DOMAINS)), 1 / len(DOMAINS))
    tokens, shapes, d, at = _features(raw, off, model.words)
    n = len(model.words)
    z = np.clip((shapes - model.mean) / model.scale, -5, 5) @ model.weights[n:-1] + model.weights[-1]
    for c in range(len(DOMAINS)):
        z[:, c] += np.bincount(d, weights=model.weights[at, c], minlength=len(off) - 1)
    return tokens, _softmax(z)


def _posteriors(model: Classifier | None):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = buffers(batch.column(1))
            parts = [predict(model, raw[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in slices(off)]
            tokens = np.concatenate([t for t, _ in parts]) if parts else np.empty(0, np.int64)
            p = np.concatenate([p for _, p in parts]) if parts else np.empty((0, len(DOMAINS)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens.astype(np.int64)), *(pa.array(p[:, c]) for c in range(len(DOMAINS)))], ["doc_id", "tokens", *(f"p_{n}" for n in DOMAINS)])

    return run


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Classifier | None:
    """The classifier of at most `most` labelled documents, those with the smallest hash of their id; of labels or
    texts with one doc_id the smallest counts."""
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 0)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), domain.alias("domain")).filter("doc_id is not null and domain is not null")
    chosen = known.groupBy("doc_id").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64(F.lit(29), "doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    rows = sorted(texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("domain").alias("domain")).collect(), key=lambda r: r.doc_id)
    model = train([r.text for r in rows], [r.domain for r in rows]) if rows else None
    del rows
    trim()
    return model


@dataclass
class Rates:
    """Steps that lead from rate 1 to the fitted rates: each takes `step @ probabilities` off a rate and cuts it to the bounds."""

    steps: list[np.ndarray]
    residual: float  # tokens that the domains are off by, as a share of all
    errors: list[float]  # squared error after each round, from the start

    def __call__(self, p: np.ndarray) -> np.ndarray:
        r = np.ones(len(p))
        for g in self.steps:
            r = np.clip(r - p @ g, 0.0, MOST_RATE)
        return r


def _try(steps: list[np.ndarray], trials: list[np.ndarray]):  # noqa: ANN202
    """For each trial step: tokens of each domain, and sum(tokens * p p') over rates within the bounds."""
    k = len(DOMAINS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(trials), k + k * k))
        for batch in batches:
            t = batch.column(0).to_numpy(zero_copy_only=False).astype(np.float64)
            p = np.stack([batch.column(1 + c).to_numpy(zero_copy_only=False) for c in range(k)], 1)
            now = Rates(steps, 0, [])(p)
            for n, g in enumerate(trials):
                r = np.clip(now - p @ g, 0.0, MOST_RATE)
                free = (r > 0) & (r < MOST_RATE)
                total[n, :k] += (r * t) @ p
                total[n, k:] += (p.T @ (p * (t * free)[:, None])).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(trials)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["n", "x"])

    return run


def fit_rates(table: DataFrame, targets: dict[str, float]) -> Rates:
    """Rates of a table of tokens and probabilities: the projected gradient, to convergence."""
    k = len(DOMAINS)
    table = table.select("tokens", *(f"p_{n}" for n in DOMAINS))

    def tried(steps: list[np.ndarray], trials: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        sums = table.mapInArrow(_try(steps, trials), "n int, x array<double>").groupBy("n").agg(F.array(*(F.sum(F.col("x")[i]) for i in range(k + k * k))).alias("x"))
        by = {r.n: np.array(r.x) for r in sums.collect()}
        return [(by[n][:k], by[n][k:].reshape(k, k)) if n in by else (np.zeros(k), np.zeros((k, k))) for n in range(len(trials))]

    ((now, free),) = tried([], [np.zeros(k)])
    everything = now.sum()  # at rate 1
    if not everything:
        return Rates([], 0.0, [])
    goal = np.array([targets.get(n, 0.0) for n in DOMAINS]) / sum(targets.values()) * everything
    short = 1 / np.linalg.eigvalsh(free)[-1]  # 1 / L
    square = lambda x: float((((x - goal) / everything) ** 2).sum())
    steps, errors = [], [square(now)]
    while (off := float(np.abs(now - goal).sum() / everything)) > TOLERANCE:
        error = now - goal
        weighted = np.linalg.pinv(free, rcond=1e-9, hermitian=True) @ error
        trials = [*(error * short * x for x in (1, 4, 16, 64, 256, 1024)), *(weighted * x for x in (0.1, 0.25, 0.5, 1, 1.5, 2.5))]
        found = tried(steps, trials)
        best = min(range(len(trials)), key=lambda n: square(found[n][0]))
        if square(found[best][0]) > errors[-1] * (1 - STALLED):
            break
        now, free = found[best]
        steps = [*steps, trials[best]]
        errors.append(square(now))
    return Rates(steps, off, errors)


def _rated(rates: Rates, columns: list[int]):  # noqa: ANN202
    """Batches with a rate and the residual after their columns; `columns` are the places of the probabilities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns], 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rates(p)), pa.array(np.full(len(p), rates.residual))], [*batch.schema.names, "rate", "residual"])

    return run


_P = ", ".join(f"p_{n} double" for n in DOMAINS)


def mixing(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, tokens, p_high, p_low, p_toxic, rate, residual.

    The rates keep the number of tokens and give the domains the target weights, as near as
    rates between 0 and MOST_RATE can; residual says how near, as a share of all tokens, the same in every row.
    Null and empty texts have 0 tokens and a rate all the same. Null doc_ids stay
    null; repeated rows have the same rate; equal probabilities get equal rates. Without labels of two
    domains all probabilities are equal, rates stay 1 and the residual is 0. An empty table gives an empty result.
    Labels without a document, with nulls, or repeated for a doc_id (the lowest domain counts) do no harm; other columns
    are ignored.
    """
    model = fit(docs, labels)
    rows = narrow(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = saved(rows.mapInArrow(_posteriors(model), f"doc_id long, tokens long, {_P}"), "posteriors")
    rates = fit_rates(table, targets or TARGETS) if model else Rates([], 0.0, [])
    return table.mapInArrow(_rated(rates, [2, 3, 4]), f"doc_id long, tokens long, {_P}, rate double, residual double")


def copies(r: Column, doc_id: str = "doc_id", seed: int = 41) -> Column:
    """How often a document with this rate is taken: the whole part, and once more with the probability of the rest."""
    return F.floor(r + unit_hash(doc_id, seed)).cast("int")


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """docs with each row taken as often as its rate says: left out, once, or repeated; all columns stay.
    A row with a null doc_id is taken once; repeated rows are taken equally often; null and empty texts have a rate like others; an
    empty table gives an empty one; without labels of two domains docs are returned as they are."""
    model = fit(docs, labels)
    if model is None:
        return docs
    columns = docs.columns
    extra = ["__opalgrid_tokens", *(f"__opalgrid_p_{n}" for n in DOMAINS)]
    more = [StructField(extra[0], LongType()), *(StructField(x, DoubleType()) for x in extra[1:])]
    run, at = _posteriors(model), columns.index("text")

    def attach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (p,) = run(iter([pa.RecordBatch.from_arrays([pa.array(np.zeros(batch.num_rows, np.int64)), batch.column(at).cast(pa.string())], ["doc_id", "text"])]))
            yield pa.RecordBatch.from_arrays([*batch.columns, *p.columns[1:]], [f"c{k}" for k in range(len(columns) + len(extra))])

    # texts are classified once: rows and probabilities are written together, and the fit reads the probabilities' columns alone
    table = saved(map_rows(docs, attach, more), "posteriors")
    rates = fit_rates(table.select(*(F.col(x).alias(x.removeprefix("__opalgrid_")) for x in extra)), targets or TARGETS)
    rate = F.lit(1.0)
    for g in rates.steps:
        rate = F.least(F.lit(MOST_RATE), F.greatest(F.lit(0.0), rate - sum((F.col(x) * F.lit(float(w)) for x, w in zip(extra[1:], g)), F.lit(0.0))))
    times = F.when(F.col("doc_id").isNull(), F.lit(1)).otherwise(copies(rate))
    return table.withColumn("__opalgrid_copy", F.explode(F.array_repeat(F.lit(1), times))).select([F.col(f"`{c}`") for c in columns])
