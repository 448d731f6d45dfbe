"""Toxicity by weak supervision.

Many voters look at a document: fixed lexicons and patterns, and lexicons of
words and word stems induced from labelled training rows.  Lexicons that vote
on one part of the sample are induced from its other parts, so no row's own
label reaches its votes.  A generative label model is estimated from the votes alone, by
expectation maximisation: how much likelier each voter fires on a toxic text
than on a clean one (its accuracy) and how voters move together within a class
(their correlations).  Correlated voters share their say.  The model's
posteriors, not the labels, train a linear classifier over words and stems,
which scores texts.

The fit sees a sample of at most ``max_rows`` labelled training rows, chosen by a
hash of their ids.  Scoring is a narrow map over all rows and whole texts.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from objtrail.llm.shared import labelled_sample

MAX_ROWS = 8000
#: chunks of text whose features a worker remembers; none is longer than ``CACHED_CHARS``
CACHE_LIMIT = 150_000
CACHED_CHARS = 48
STEMS = (4, 5, 6)
#: words in no more than this share of the sample tell near copies from other documents
RARE = 0.005
_WORD = re.compile(r"[^\W\d_]+")

# fixed values: general insults, by language
INSULTS = {
    "en": "idiot moron stupid dumb loser scum trash clown pathetic disgusting worthless imbecile jerk filth vermin",
    "de": "idiot dummkopf trottel abschaum versager widerlich wertlos dreckig armselig",
    "fr": "imbécile crétin débile ordure minable pathétique dégoûtant nul abruti",
    "es": "idiota imbécil estúpido basura escoria patético asqueroso inútil tonto",
}
# fixed values: addressing patterns; {} is any insult
PATTERNS = (
    r"\b(?:you|your|you're|u)\b.{{0,40}}\b(?:{})\b",
    r"\b(?:du|ihr|tu|vous|eres|usted)\b.{{0,40}}\b(?:{})\b",
    r"\b(?:what|such|total|complete|utter)\b.{{0,20}}\b(?:{})\b",
    r"\b(?:{})\b.{{0,40}}\b(?:{})\b",
)


def training_row(id_col: str | Column = "doc_id") -> Column:
    """Rows whose labels may be learnt from: crc32 of the id's text mod 5 is not 0."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0


def features_of(chunk: str) -> set[str]:
    """Words and stems of one white-space chunk."""
    found = set()
    for word in _WORD.findall(chunk.lower()):
        found.add("w" + word)
        for n in STEMS:
            if len(word) > n:
                found.add(f"{n}{word[:n]}")
    return found


#: kinds of features by their first letter; the number takes the last bits of a feature's digest
_KINDS = {"w": 0, "4": 1, "5": 2, "6": 3}


def _digest(feature: str) -> int:
    return xxhash.xxh3_64_intdigest(feature) & ~3 | _KINDS[feature[0]]


class Features:
    """Distinct features of documents: their digests in order (``names``), and flat
    arrays of owners and places in ``names``."""

    def __init__(self, texts: list[str]) -> None:
        known: dict[str, tuple[int, ...]] = {}
        rows = [np.empty(0, dtype=np.uint64)]
        for text in texts:
            found: set[int] = set()
            for chunk in set(text.split()):
                hit = known.get(chunk)
                if hit is None:
                    hit = tuple(map(_digest, features_of(chunk)))
                    if len(chunk) <= CACHED_CHARS:
                        if len(known) >= CACHE_LIMIT:
                            known.clear()
                        known[chunk] = hit
                found.update(hit)
            rows.append(np.fromiter(found, dtype=np.uint64, count=len(found)))
        self.rows = len(texts)
        self.owner = np.repeat(np.arange(self.rows, dtype=np.int32), [len(r) for r in rows[1:]])
        flat = np.concatenate(rows)
        del rows, known
        self.names = np.unique(flat)
        self.index = np.searchsorted(self.names, flat).astype(np.int32)
        self.weight = self._weights()

    def _weights(self) -> np.ndarray:
        """What each document counts as evidence: near copies, told by the first of
        their rare words in an order by digest, count as one together."""
        holders = np.bincount(self.index, minlength=len(self.names))
        rare = (holders > 1) & (holders <= max(2, RARE * self.rows)) & (self.names & np.uint64(3) == 0)
        key = np.full(self.rows, -1, dtype=np.int64)
        at = np.flatnonzero(rare[self.index])
        if len(at):
            # digests are in order, so the least place is the least digest
            owner, first = np.unique(self.owner[at], return_index=True)
            key[owner] = np.minimum.reduceat(self.index[at], first)
        weight = np.ones(self.rows)
        _, group, size = np.unique(key[key >= 0], return_inverse=True, return_counts=True)
        weight[key >= 0] = 1 / np.sqrt(size[group])
        return weight

    def places(self, names: list[int]) -> np.ndarray:
        """A lexicon as a mask over ``names``."""
        return np.isin(self.names, np.array(names, dtype=np.uint64))

    def hits(self, lexicon: np.ndarray) -> np.ndarray:
        """Which documents hold a feature of a lexicon."""
        found = np.zeros(self.rows, dtype=bool)
        found[self.owner[lexicon[self.index]]] = True
        return found

    def counts(self, weight: np.ndarray, share: np.ndarray) -> np.ndarray:
        """Per feature, the summed weight of the documents with it, of a share of all documents."""
        return np.bincount(self.index, (weight * share)[self.owner], len(self.names))


def telling(n1: np.ndarray, n0: np.ndarray, base: float, tried: int) -> np.ndarray:
    """Whether features seen in n1 toxic and n0 clean rows tell the classes apart:
    mostly toxic even after smoothing, and too often so for chance among ``tried``."""
    n = n1 + n0
    rate = np.clip(n1 / np.maximum(n, 1e-9), 1e-9, 1 - 1e-9)
    evidence = n * (rate * np.log(rate / base) + (1 - rate) * np.log((1 - rate) / (1 - base)))
    return ((n1 + 2 * base) / (n + 2) >= 0.75) & (evidence > np.log(tried + 1) + 3)


def _base(weight: np.ndarray) -> float:
    return float(np.clip(weight.mean(), 0.01, 0.5))


class Voters:
    """Votes 1 (toxic), -1 (looked, found nothing) or 0 (no words to look at).

    One voter for each fixed lexicon and pattern, and ``GROUPS`` for each kind of
    feature, among which its induced lexicon is dealt.  Lexicons that vote on one of ``FOLDS`` parts are induced from the others.
    """

    GROUPS = 1
    FOLDS = 8

    def __init__(self) -> None:
        self.fixed = [[_digest("w" + w) for w in ws.split()] for ws in INSULTS.values()]
        every = "|".join(sorted({w for ws in INSULTS.values() for w in ws.split()}))
        self.patterns = [re.compile(p.replace("{{", "{").replace("}}", "}").replace("{}", every), re.S) for p in PATTERNS]

    def induce(self, features: Features, labels: np.ndarray, of: np.ndarray) -> list[np.ndarray]:
        """Lexicons of features that fire almost only in the toxic rows among ``of``."""
        of = of * features.weight
        n1, n0 = features.counts(labels, of), features.counts(1 - labels, of)
        names = features.names
        keep = np.flatnonzero(telling(n1, n0, _base(labels[of > 0]), int((n1 + n0 > 0).sum())))
        keep = keep[np.lexsort((names[keep], -n1[keep]))]
        kind = names[keep] & np.uint64(3)
        lexicons = []
        for k in range(len(_KINDS)):
            for g in range(self.GROUPS):
                lexicons.append(np.zeros(len(names), dtype=bool))
                lexicons[-1][keep[kind == k][g :: self.GROUPS]] = True
        return lexicons

    def votes(self, texts: list[str], features: Features, labels: np.ndarray) -> np.ndarray:
        """A row of votes per text."""
        fixed = [features.hits(features.places(f)) for f in self.fixed]
        low = {i: texts[i].lower() for i in np.flatnonzero(np.any(fixed, axis=0)).tolist()}
        fired = fixed + [np.array([i in low and p.search(low[i]) is not None for i in range(len(texts))]) for p in self.patterns]
        fold = np.arange(len(texts)) % self.FOLDS
        induced = np.zeros((len(_KINDS) * self.GROUPS, len(texts)), dtype=bool)
        for k in range(self.FOLDS):
            for j, lexicon in enumerate(self.induce(features, labels, (fold != k).astype(float))):
                induced[j, fold == k] = features.hits(lexicon)[fold == k]
        votes = np.where(np.concatenate([fired, induced]).T, 1.0, -1.0)
        votes[np.bincount(features.owner, minlength=len(texts)) == 0] = 0.0
        return votes


class LabelModel:
    """Two classes of vote vectors, estimated from the votes alone.

    ``rate[c, j, v + 1]`` is how often voter j says v in class c.  ``correlation``
    holds the voters' correlations within the classes, and ``say`` the share of its
    own evidence that each voter brings, one over the sum of its squared
    correlations: independent voters 1, k copies of one 1 / k each.  ``start`` is a first guess of the posteriors, by default from the
    number of voters that fire.
    """

    def __init__(self, votes: np.ndarray, start: np.ndarray | None = None, rounds: int = 50) -> None:
        if start is None:
            start = 1 - 0.5 ** (votes > 0).sum(axis=1)
        p = np.clip(np.asarray(start, dtype=float), 0.02, 0.98)
        for _ in range(rounds):
            self._maximise(votes, p)
            q = self.posterior(votes)
            moved = np.abs(q - p).max(initial=0.0)
            p = q
            if moved < 1e-4:
                break
        self.rows = p

    def _maximise(self, votes: np.ndarray, p: np.ndarray) -> None:
        self.prior = (p.sum() + 1) / (len(p) + 2)
        share = np.stack([1 - p, p])
        seen = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
        # a voter that hardly ever votes is held to be a little better than chance
        weak = np.array([[1.0, 0.2, 0.1], [0.9, 0.2, 0.2]])[:, None, :]
        counts = np.einsum("cn,njv->cjv", share, seen) + weak
        self.rate = counts / counts.sum(axis=2, keepdims=True)
        mean = self.rate[:, :, 2] - self.rate[:, :, 0]
        #: how much a vote leans the right way, from -1 to 1
        self.accuracy = (mean[1] - mean[0]) / 2
        cov = sum(((votes - mean[c]) * share[c][:, None]).T @ (votes - mean[c]) for c in (0, 1)) / max(1, len(votes))
        scale = np.sqrt(np.diag(cov) + 1e-9)
        self.correlation = cov / scale[:, None] / scale[None, :]
        self.say = 1 / (np.square(np.clip(self.correlation, 0, 1)).sum(axis=1) + 1e-6)
        self.evidence = self.say[:, None] * np.log(self.rate[1] / self.rate[0])
        self.weight = (self.evidence[:, 2] - self.evidence[:, 0]) / 2

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        z = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for j in range(votes.shape[1]):
            z += self.evidence[j][votes[:, j].astype(np.int64) + 1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(texts: list[str], labels: list[int]) -> dict:
    """Voters, label model and linear classifier of one bounded sample."""
    y = np.array(labels, dtype=float)
    if len(y) == 0 or y.min() == y.max():
        # nothing to learn from: only the fixed lexicons speak
        names = sorted({"w" + w for ws in INSULTS.values() for w in ws.split()})
        return {"names": names, "weights": np.full(len(names), 4.0), "bias": -2.0}
    features = Features(texts)
    model = LabelModel(Voters().votes(texts, features, y))
    return _named(texts, _linear(features, model.rows))


def _linear(features: Features, target: np.ndarray, steps: int = 300, penalty: float = 1e-4) -> dict:
    """Logistic regression on all features that tell the posterior classes apart."""
    n1, n0 = target.sum() + 1e-9, (1 - target).sum() + 1e-9
    in1, in0 = features.counts(target, features.weight), features.counts(1 - target, features.weight)
    # what two documents or fewer hold is no evidence
    use = telling(in1, in0, _base(target), len(in1)) & (in1 + in0 > 2.5)
    names = features.names[use]
    column = np.cumsum(use) - 1
    keep = use[features.index]
    owner, flat = features.owner[keep], column[features.index[keep]]
    weights, bias = np.zeros(len(names)), 0.0
    balance = target * (0.5 / n1) + (1 - target) * (0.5 / n0)
    m, v, mb, vb = np.zeros(len(names)), np.zeros(len(names)), 0.0, 0.0
    for t in range(1, steps + 1):
        s = np.bincount(owner, weights=weights[flat], minlength=len(target)) + bias
        g = (1 / (1 + np.exp(-np.clip(s, -30, 30))) - target) * balance
        gw = np.bincount(flat, weights=g[owner], minlength=len(names)) + penalty * weights
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.1 / (1 - 0.9**t)
        weights -= rate * m / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        bias -= rate * mb / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return {"digests": names, "weights": weights, "bias": float(bias)}


def _named(texts: list[str], model: dict) -> dict:
    """The model with its features' names instead of their digests."""
    wanted = dict(zip(model["digests"].tolist(), model["weights"].tolist(), strict=True))
    found: dict[str, float] = {}
    for text in texts:
        if len(found) == len(wanted):
            break
        for chunk in set(text.split()):
            for f in features_of(chunk):
                if (weight := wanted.get(_digest(f))) is not None:
                    found[f] = weight
    names = sorted(found)
    return {"names": names, "weights": np.array([found[f] for f in names]), "bias": model["bias"]}


def fit_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int) -> dict:
    """Fit in one task on a bounded sample of labelled training rows."""
    marked = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(
        F.max(label_col).cast("int").alias("_y")
    )
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    sample = labelled_sample(texts, marked, training_row("_id"), max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[str] = []
        ys: list[int] = []
        for batch in batches:
            texts += [t or "" for t in batch.column("_text").to_pylist()]
            ys += batch.column("_y").to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(texts, ys))], type=pa.binary())], ["model"])

    rows = sample.select("_text", "_y").coalesce(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(rows[0].model) if rows else fit([], [])


class Scorer:
    def __init__(self, model: dict) -> None:
        self.weight = dict(zip(model["names"], model["weights"].tolist(), strict=True))
        self.bias = model["bias"]
        self.chunks: dict[str, frozenset[str] | None] = {}

    def score(self, text: str) -> float:
        chunks, weight, found = self.chunks, self.weight, set()
        for chunk in set(text.split()):
            # most chunks hold no feature of the model: None stands for those
            hit = chunks.get(chunk, 0)
            if hit == 0:
                hit = frozenset(f for f in features_of(chunk) if f in weight) or None
                if len(chunk) <= CACHED_CHARS:
                    if len(chunks) >= CACHE_LIMIT:
                        chunks.clear()
                    chunks[chunk] = hit
            if hit:
                found |= hit
        z = self.bias + sum(weight[f] for f in sorted(found))
        return float(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))


def toxicity_scorer(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_rows: int = MAX_ROWS,
) -> Callable[[Column | str], Column]:
    """Fit on the labelled training rows of ``docs``; the function returned scores any text column.

    Scores are in 0..1, higher: likelier toxic.  Null and empty texts hold no
    feature and get the classifier's base score, which is below one half.  Without
    labels of both classes the fixed lexicons alone decide.  Labels repeated for an
    id count as toxic if any is; labels of unknown ids and other columns are
    ignored.  Labels of rows outside the training share are never read into the fit.
    """
    model = fit_sample(docs, labels, id_col, text_col, label_col, max_rows)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(model)
        for batch in batches:
            yield pa.array([scorer.score(t or "") for t in batch.to_pylist()], type=pa.float64())

    scored = F.arrow_udf(run, "double")
    return lambda text: scored(F.col(text).cast("string") if isinstance(text, str) else text.cast("string"))


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """doc_id, score of every row of ``docs``, by ``toxicity_scorer``; only texts
    go to the Python workers and only scores come back.

    Repeated rows get equal scores; an empty table gives an empty result.
    """
    score = toxicity_scorer(docs, labels, id_col, text_col, label_col, max_rows)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), score(F.col(text_col)).alias("score"))
