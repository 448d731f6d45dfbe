"""Document quality from a linear-chain conditional random field over lines.

Every line is described by numbers (case, symbols, repetition, shape) of its own
and of its neighbours.  The field labels lines good or bad; forward-backward
gives each line's marginal, and a document's quality is the length-weighted mean
of its lines' marginals, calibrated to a probability.  Training lines carry the
label of their document, and the calibration learns what share of bad lines
makes a bad document.

The fit sees at most ``max_rows`` labelled training rows, chosen by a hash of
their ids.  Scoring is a narrow map over all rows and whole texts.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from objtrail.llm.shared import labelled_sample

MAX_ROWS = 3000
OWN = 15
WIDTH = 3 * OWN + 3
#: lines described at a time in a text of many lines
STRETCH = 4096
_SYMBOLS = "*$%#&!|~^<>{}[]=+@\\"


def training_row(id_col: str | Column = "doc_id") -> Column:
    """Rows whose labels may be learnt from: crc32 of the id's text mod 3 is not 1."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1


def line_numbers(line: str) -> list[float]:
    """What a line looks like, each number about within 0..1."""
    words = line.split()
    n, chars = max(1, len(words)), max(1, len(line))
    symbols = sum(map(line.count, _SYMBOLS))
    return [
        min(1.0, len(line) / 500),
        min(1.0, len(words) / 50),
        sum(map(str.isupper, words)) / n,
        sum(map(str.isalpha, words)) / n,
        sum(map(str.isdigit, words)) / n,
        min(1.0, 4 * symbols / chars),
        min(1.0, 2 * line.count("|") / n),
        min(1.0, line.count("!") / n),
        min(1.0, sum(line.count(2 * s) for s in "*$%#&!") / n),
        min(1.0, (chars - len(words)) / n / 12),
        len(set(words)) / n,
        sum(map(eq, words, words[1:])) / n,
        float(line[-1:] in ".?!…\"'»)"),
        float(line[:1].isupper()),
        min(1.0, (line.count(".") + line.count(",")) / n),
    ]


def _lines(text: str) -> list[str]:
    """A text's lines that are not blank; a text without any counts as one empty line."""
    return [x for x in text.split("\n") if x.strip()] or [""]


def _own(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of each line by itself, and the lines' lengths."""
    own = np.empty((len(lines), OWN))
    for k, line in enumerate(lines):
        own[k] = line_numbers(line)
    return own, np.fromiter((len(x) or 1 for x in lines), dtype=np.float64, count=len(lines))


def describe(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature rows of all lines, lines per document, and lines' lengths."""
    listed = [_lines(text) for text in texts]
    count = np.array([len(x) for x in listed], dtype=np.int64)
    own, sizes = _own([line for x in listed for line in x])
    starts = np.cumsum(count) - count
    x = np.zeros((len(own), WIDTH))
    if len(own):
        x[:, :OWN] = own
        x[1:, OWN : 2 * OWN] = own[:-1]
        x[starts, OWN : 2 * OWN] = 0
        x[:-1, 2 * OWN : 3 * OWN] = own[1:]
        x[starts + count - 1, 2 * OWN : 3 * OWN] = 0
        x[:, -3] = 1
        x[starts, -2] = 1
        x[starts + count - 1, -1] = 1
    return x, count, sizes


def _emission(lines: list[str], w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Emission scores and lengths of one long document's lines, described a stretch at a time."""
    emission, sizes, n = np.empty((len(lines), 2)), np.empty(len(lines)), len(lines)
    for at in range(0, n, STRETCH):
        till, low, high = min(at + STRETCH, n), max(0, at - 1), min(at + STRETCH + 1, n)
        own, size = _own(lines[low:high])
        x = np.zeros((high - low, WIDTH))
        x[:, :OWN] = own
        x[1:, OWN : 2 * OWN] = own[:-1]
        x[:-1, 2 * OWN : 3 * OWN] = own[1:]
        x[:, -3] = 1
        x[0, -2], x[-1, -1] = low == 0, high == n
        emission[at:till] = (x @ w)[at - low : till - low]
        sizes[at:till] = size[at - low : till - low]
    return emission, sizes


def long_marginals(emission: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Marginals of one long chain in about the square root of its length in steps.

    The chain is cut into stretches that advance together by products of transfer
    matrices; then messages pass from stretch to stretch.
    """
    n = len(emission)
    e = np.exp(emission - emission.max(axis=1, keepdims=True))
    width = max(1, int(np.ceil(np.sqrt(n - 1))))
    parts = -(-(n - 1) // width)
    step = np.tile(np.eye(2), (parts * width, 1, 1))
    step[: n - 1] = np.exp(transition)[None] * e[1:, None, :]
    step = step.reshape(parts, width, 2, 2)
    before, after = np.empty_like(step), np.empty_like(step)
    before[:, 0], after[:, -1] = step[:, 0], step[:, -1]
    for k in range(1, width):
        before[:, k] = before[:, k - 1] @ step[:, k]
        before[:, k] /= before[:, k].sum(axis=(1, 2), keepdims=True)
        after[:, -1 - k] = step[:, -1 - k] @ after[:, -k]
        after[:, -1 - k] /= after[:, -1 - k].sum(axis=(1, 2), keepdims=True)
    heads, tails = np.empty((parts, 2)), np.empty((parts, 2))
    head, tail = e[0] / e[0].sum(), np.full(2, 0.5)
    for c in range(parts):
        heads[c] = head
        head = head @ before[c, -1]
        head /= head.sum()
        tails[-1 - c] = tail
        tail = after[-1 - c, 0] @ tail
        tail /= tail.sum()
    alpha = np.concatenate([e[:1], np.einsum("ci,ckij->ckj", heads, before).reshape(-1, 2)[: n - 1]])
    beta = np.concatenate([np.einsum("ckij,cj->cki", after, tails).reshape(-1, 2)[: n - 1], np.full((1, 2), 0.5)])
    both = alpha * beta
    return both / both.sum(axis=1, keepdims=True)


def forward_backward(
    emission: np.ndarray, transition: np.ndarray, count: np.ndarray
) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of all lines, summed pair marginals, and the sum of log partitions.

    All chains advance together, longest first, so each step is one array
    operation over the chains that still have a line there.
    """
    order = np.argsort(-count, kind="stable")
    lengths = count[order]
    starts = (np.cumsum(count) - count)[order]
    steps = int(lengths[0]) if len(lengths) else 0
    alive = np.searchsorted(-lengths, -np.arange(steps), side="left")
    e = np.exp(emission - emission.max(axis=1, keepdims=True))
    a = np.exp(transition)
    alpha, scale = np.zeros_like(e), np.ones(len(e))
    for t in range(steps):
        at = starts[: alive[t]] + t
        f = e[at] if t == 0 else (alpha[at - 1] @ a) * e[at]
        s = f.sum(axis=1)
        alpha[at], scale[at] = f / s[:, None], s
    beta, pairs = np.ones_like(e), np.zeros((2, 2))
    for t in range(steps - 2, -1, -1):
        at = starts[: alive[t + 1]] + t
        right = e[at + 1] * beta[at + 1] / scale[at + 1][:, None]
        beta[at] = right @ a.T
        pairs += (alpha[at].T @ right) * a
    log_z = float(np.log(scale).sum() + emission.max(axis=1).sum())
    return alpha * beta, pairs, log_z


def _weighted(marginal: np.ndarray, sizes: np.ndarray, count: np.ndarray) -> np.ndarray:
    owner = np.repeat(np.arange(len(count)), count)
    return np.bincount(owner, weights=marginal * sizes, minlength=len(count)) / np.bincount(
        owner, weights=sizes, minlength=len(count)
    )


class _Adam:
    def __init__(self, size: int, rate: float) -> None:
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * gradient
        self.v = 0.999 * self.v + 0.001 * gradient**2
        return self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def fit(texts: list[str], labels: list[int], steps: int = 120, penalty: float = 1e-3) -> dict:
    """Maximum-likelihood field and its calibration, of one bounded sample."""
    y = np.array(labels, dtype=np.int64)
    if len(y) == 0 or y.min() == y.max():
        base = 0.0 if len(y) == 0 else (2.0 if y[0] else -2.0)
        return {"w": np.zeros((WIDTH, 2)), "a": np.zeros((2, 2)), "slope": 0.0, "base": base}
    x, count, sizes = describe(texts)
    owner = np.repeat(np.arange(len(count)), count)
    state = y[owner]
    # each class and each document weigh the same
    weight = (0.5 / np.bincount(y, minlength=2))[y] / count
    truth = np.zeros((len(x), 2))
    truth[np.arange(len(x)), state] = 1
    pair_truth = np.zeros((2, 2))
    for label in (0, 1):
        pair_truth[label, label] = (count - 1)[y == label].sum()
    w, a = np.zeros((WIDTH, 2)), np.zeros((2, 2))
    move_w, move_a = _Adam(w.size, 0.1), _Adam(4, 0.05)
    total_pairs = max(1, int((count - 1).sum()))
    for _ in range(steps):
        marginal, pairs, _ = forward_backward(x @ w, a, count)
        gw = x.T @ ((marginal - truth) * weight[owner][:, None]) + penalty * w
        ga = (pairs - pair_truth) / total_pairs + 0.05 * a
        w = w - move_w.step(gw.ravel()).reshape(w.shape)
        a = a - move_a.step(ga.ravel()).reshape(2, 2)
    marginal, _, _ = forward_backward(x @ w, a, count)
    p = _weighted(marginal[:, 1], sizes, count)
    z = np.clip(p, 1e-3, 1 - 1e-3)
    z = np.log(z / (1 - z))
    theta, move = np.array([1.0, 0.0]), _Adam(2, 0.05)
    for _ in range(400):
        s = 1 / (1 + np.exp(-np.clip(theta[0] * z + theta[1], -30, 30)))
        theta = theta - move.step(np.array([((s - y) * z).mean(), (s - y).mean()]))
    return {"w": w, "a": a, "slope": float(max(0.0, theta[0])), "base": float(theta[1])}


def score(model: dict, texts: list[str]) -> np.ndarray:
    """Scores of texts; those of many lines are described and scored one by one, a stretch at a time."""
    p = np.empty(len(texts))
    long = np.array([t.count("\n") >= STRETCH for t in texts], dtype=bool)
    short = [t for t, is_long in zip(texts, long, strict=True) if not is_long]
    if short:
        x, count, sizes = describe(short)
        marginal, _, _ = forward_backward(x @ model["w"], model["a"], count)
        p[~long] = _weighted(marginal[:, 1], sizes, count)
    for k in np.flatnonzero(long):
        emission, sizes = _emission(_lines(texts[k]), model["w"])
        # a single line is its own chain
        marginal = long_marginals(emission, model["a"]) if len(sizes) > 1 else forward_backward(emission, model["a"], np.array([1]))[0]
        p[k] = marginal[:, 1] @ sizes / sizes.sum()
    p = np.clip(p, 1e-3, 1 - 1e-3)
    z = model["slope"] * np.log(p / (1 - p)) + model["base"]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _bounded(texts: list[str], rows: int, chars: int) -> Iterator[list[str]]:
    """Runs of texts of at most ``rows`` texts and, but for single longer ones, ``chars`` characters."""
    part: list[str] = []
    held = 0
    for text in texts:
        if part and (len(part) >= rows or held + len(text) > chars):
            yield part
            part, held = [], 0
        part.append(text)
        held += len(text)
    if part:
        yield part


def quality_scorer(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_rows: int = MAX_ROWS,
) -> Callable[[Column | str], Column]:
    """Fit on the labelled training rows of ``docs``; the function returned scores any text column.

    Scores are in 0..1, higher: likelier good.  A null or blank text counts as one
    empty line and is scored like any other.  Without labels of both classes every
    text gets the same score: of the only class seen, or 0.5.  Labels repeated for an
    id count as good only if all are; labels of unknown ids and other columns are
    ignored.
    """
    marked = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(
        F.min(label_col).cast("int").alias("_y")
    )
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    sample = labelled_sample(texts, marked, training_row("_id"), max_rows)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[str] = []
        ys: list[int] = []
        for batch in batches:
            texts += [t or "" for t in batch.column("_text").to_pylist()]
            ys += batch.column("_y").to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(texts, ys))], type=pa.binary())], ["model"])

    rows = sample.select("_text", "_y").coalesce(1).mapInArrow(learn, "model binary").collect()
    model = pickle.loads(rows[0].model) if rows else fit([], [])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = [t or "" for t in batch.to_pylist()]
            scores = [score(model, part) for part in _bounded(texts, 256, 1 << 20)]
            yield pa.array(np.concatenate([np.empty(0), *scores]), type=pa.float64())

    scored = F.arrow_udf(run, "double")
    return lambda text: scored(F.col(text).cast("string") if isinstance(text, str) else text.cast("string"))


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """doc_id, score of every row of ``docs``, by ``quality_scorer``; only texts go to
    the Python workers and only scores come back.

    Repeated rows get equal scores; an empty table gives an empty result.
    """
    score = quality_scorer(docs, labels, id_col, text_col, label_col, max_rows)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), score(F.col(text_col)).alias("score"))
