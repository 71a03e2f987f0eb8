"""Toxic spans by a linear-chain conditional random field over tokens.

Labels exist for documents only, so tokens get theirs first: in documents
labelled toxic, a token is marked if its word or one of its prefixes is much
commoner in toxic than in clean documents of the training rows.  The field has
two states; its features are the word and its prefixes, hashed.
Forward-backward marginals of every token add up to a document score through a
logistic fit on the same training rows, and give the offsets of the offending
tokens.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXTS, rows_from, stage, with_columns_from
from .words import Memo

TRAIN_DOCS = (5000, 2000)  # clean and toxic documents of the training sample, at most
FEATURES_KEPT = 50_000   # tokens whose features a task keeps
TRAIN_TOKENS = 300_000  # tokens of the chains the field is trained on, half of each label
HASHED = 1 << 18
CHAIN = 64              # tokens of a chain; long documents are several chains
EPOCHS = 4
EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def features(token: str) -> tuple[str, ...]:
    w = token.lower()
    if not w.isalnum():  # else there is nothing to strip
        w = EDGES.sub("", w)
    prefixes = ("4" + w[:4], "5" + w[:5], "6" + w[:6])
    return ("w" + w, *prefixes[:max(0, min(len(w) - 4, 3))])


def _slots(token: str) -> list[int]:
    return [xxhash.xxh32_intdigest(f) % HASHED for f in features(token)]


def token_labels(sample: DataFrame, n: tuple[int, int], lift: float = 12.0, evidence: float = 9.0) -> set[str]:
    """Features that mark a token as toxic: a share of the toxic documents ``lift``
    times that of the clean has them, with a log-likelihood ratio of ``evidence``
    against a feature that does not depend on the label.

    sample: text and toxic, ``n`` documents of label 0 and 1."""
    q = n[1] / (n[0] + n[1])

    def ratio(k: int, c: int) -> float:
        return k * math.log(k / ((k + c) * q)) + (c * math.log(c / ((k + c) * (1 - q))) if c else 0.0)

    seen = rows_from(sample, _feature_counts, "feature string, clean long, toxic long", TEXTS).groupBy("feature").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    common = seen.filter((F.col("toxic") > 2) & (F.length("feature") > 4)
                         & (F.col("toxic") / n[1] > lift * (F.col("clean") + 0.5) / n[0])).collect()
    return {r["feature"] for r in common if ratio(r["toxic"], r["clean"]) > evidence}


def _feature_counts(batches: Iterator[dict]) -> Iterator[dict]:
    """Numbers of clean and toxic documents of a partition that have a feature."""
    seen = (Counter(), Counter())
    known = Memo(features, FEATURES_KEPT)

    def flush() -> dict:
        names = list(seen[0].keys() | seen[1].keys())
        out = {"feature": names, "clean": [seen[0][f] for f in names], "toxic": [seen[1][f] for f in names]}
        for c in seen:
            c.clear()
        return out

    for b in batches:
        for text, t in zip(b["text"], b["toxic"]):
            seen[t].update({f for w in set(text.split()) for f in known[w]})
            if len(seen[0]) + len(seen[1]) > 200_000:
                yield flush()
    yield flush()


def _pieces(batches: Iterator[dict]) -> Iterator[dict]:
    """Chains of all tokens of the texts, with a hash that orders them."""
    for b in batches:
        for text, t in zip(b["text"], b["toxic"]):
            tokens = text.split()
            pieces = [" ".join(tokens[k:k + CHAIN]) for k in range(0, len(tokens), CHAIN)]
            seed = xxhash.xxh32_intdigest(text)
            yield {"piece": pieces, "toxic": [t] * len(pieces),
                   "order": [xxhash.xxh3_64_intdigest(p, seed=seed + k) >> 1 for k, p in enumerate(pieces)]}


def _chains(values: np.ndarray, fill: float) -> np.ndarray:
    """A row of tokens cut into chains of CHAIN."""
    rows = -(-len(values) // CHAIN)
    out = np.full(rows * CHAIN, fill, dtype=values.dtype)
    out[:len(values)] = values
    return out.reshape(rows, CHAIN)


def odds(emission: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward odds of the toxic state for chains (rows) of emission scores.

    With two states the forward vector is known up to scale by the ratio of its
    entries, so each direction is one recursion on a number per chain.
    """
    (oo, ot), (to, tt) = np.exp(trans)
    e = np.exp(np.clip(emission, -30, 30))
    fwd, bwd = np.empty_like(e), np.empty_like(e)
    fwd[:, 0] = e[:, 0] * ot / oo  # a chain starts as if after a clean token
    for k in range(1, e.shape[1]):
        r = fwd[:, k - 1]
        fwd[:, k] = e[:, k] * (ot + r * tt) / (oo + r * to)
    bwd[:, -1] = 1.0
    for k in range(e.shape[1] - 2, -1, -1):
        r = e[:, k + 1] * bwd[:, k + 1]
        bwd[:, k] = (to + tt * r) / (oo + ot * r)
    return fwd, bwd


def marginals(emission: np.ndarray, trans: np.ndarray) -> np.ndarray:
    fwd, bwd = odds(emission, trans)
    o = np.clip(fwd * bwd, 0, 1e30)
    return o / (1 + o)


def _train_field(chains: np.ndarray, labels: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions by stochastic gradient (Adagrad) on the conditional likelihood.

    chains: slots of the features, (chains, CHAIN, 4) with -1 for none."""
    rng = np.random.default_rng(10)
    w, trans = np.zeros(HASHED + 1), np.zeros((2, 2))
    w_sum, t_sum = np.full(HASHED + 1, 1e-6), np.full((2, 2), 1e-6)
    bias = HASHED
    w[bias] = -3.0
    for _ in range(EPOCHS):
        for at in np.array_split(rng.permutation(len(chains)), max(1, len(chains) // 200)):
            slots, y, m = chains[at], labels[at], mask[at]
            emission = np.where(slots >= 0, w[slots], 0).sum(axis=2) + w[bias]
            emission = np.where(m, emission, -30.0)
            fwd, bwd = odds(emission, trans)
            p = fwd * bwd / (1 + fwd * bwd)
            err = np.where(m, y - p, 0)  # gradient of the emission scores
            g = np.bincount(np.where(slots >= 0, slots, bias + 1).ravel(), np.repeat(err.ravel(), slots.shape[2]),
                            minlength=HASHED + 2)[:HASHED + 1]
            g[bias] = err.sum()
            g -= 1e-3 * w
            # pair marginals: alpha_k(a) * exp(trans) * e_(k+1)(b) * beta_(k+1)(b)
            a = np.stack([np.ones_like(fwd[:, :-1]), fwd[:, :-1]], axis=-1)
            b = np.stack([np.ones_like(fwd[:, 1:]), np.exp(np.clip(emission[:, 1:], -30, 30)) * bwd[:, 1:]], axis=-1)
            pair = a[..., :, None] * np.exp(trans) * b[..., None, :]
            pair /= pair.sum(axis=(-1, -2), keepdims=True)
            both = m[:, :-1] & m[:, 1:]
            real = np.zeros((2, 2))
            np.add.at(real, (y[:, :-1][both], y[:, 1:][both]), 1)
            gt = real - pair[both].sum(axis=0) - 1e-2 * trans
            w_sum += g * g
            t_sum += gt * gt
            w += 0.5 * g / np.sqrt(w_sum)
            trans += 0.1 * gt / np.sqrt(t_sum)
    return w, trans


class Tagger:
    """Trained field with the logistic fit of document scores."""

    def __init__(self, weights: np.ndarray, trans: np.ndarray):
        self.weights, self.trans, self.fit = weights, trans, np.zeros(4)

    def scorer(self) -> Memo:
        # a list: most tokens of a large corpus are rare, and a look into an array costs more than their hashes
        *w, bias = self.weights.tolist()

        def emission(token: str) -> float:
            total = bias
            for f in features(token):
                total += w[xxhash.xxh32_intdigest(f) % HASHED]
            return total

        return Memo(emission)

    def tag(self, texts: list[str], emission: Memo) -> list[np.ndarray]:
        """Marginals of every token of every text."""
        rows = [np.fromiter(map(emission.__getitem__, t.split()), dtype=np.float64) for t in texts]
        out: list[np.ndarray] = []
        held: list[int] = []

        def flush() -> None:
            m = marginals(np.concatenate([_chains(rows[i], -30.0) for i in held]), self.trans)
            at = 0
            for i in held:
                n = -(-len(rows[i]) // CHAIN)
                out[i] = m[at:at + n].ravel()[:len(rows[i])]
                at += n
            held.clear()

        size = 0
        for i, r in enumerate(rows):
            out.append(r)
            if len(r):
                held.append(i)
                size += len(r)
                if size > 500_000:
                    flush()
                    size = 0
        if held:
            flush()
        return out

    @staticmethod
    def summary(m: np.ndarray) -> list[float]:
        return [1.0, float(np.log1p(m.sum())), float(m.max()), float(np.log1p(m.sum() * 100 / len(m)))] if len(m) else [1.0, 0.0, 0.0, 0.0]

    def scores(self, tagged: list[np.ndarray]) -> np.ndarray:
        x = np.array([self.summary(m) for m in tagged]).reshape(-1, 4)
        return 1 / (1 + np.exp(-np.clip(x @ self.fit, -30, 30)))

    def fit_scores(self, x: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> None:
        """Logistic regression of summaries by Newton steps with a small ridge; ``weight`` undoes
        that the sample holds the labels in other shares than the labelled rows."""
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ self.fit, -30, 30)))
            h = x.T @ (x * (weight * (p * (1 - p) + 1e-6))[:, None]) + 0.1 * np.eye(4)
            self.fit += np.linalg.solve(h, x.T @ (weight * (toxic - p)) - 0.1 * self.fit)


def train(labelled: DataFrame, text: str = "text", label: str = "toxic", order: str = "doc_id",
          docs: tuple[int, int] = TRAIN_DOCS) -> Tagger | None:
    """Fit on at most ``docs`` documents of label 0 and 1, those with the smallest hashed id,
    one of an id; None if a label has no row.  Rows with a null text or label do not count.

    Whole texts are read, by tasks: the driver gets the features that mark tokens,
    a sample of chains from anywhere in the texts (TRAIN_TOKENS), and four numbers a document.
    """
    # keys are of ids alone: no text is dealt out but those of ids up to the last of the sample
    rows = labelled.filter(F.col(text).isNotNull() & F.col(label).isin(0, 1)).select(
        F.col(text).alias("text"), F.col(label).cast("int").alias("toxic"), F.xxhash64(order).alias("key"))
    keys = stage(rows.select("toxic", "key").groupBy("toxic", "key").count(), "training")
    total = {r["toxic"]: r["n"] for r in keys.groupBy("toxic").agg(F.sum("count").alias("n")).collect()}
    if len(total) < 2:
        return None
    last = [keys.filter(F.col("toxic") == v).select("key").orderBy("key").limit(docs[v]).agg(F.max("key").alias("k")).first()["k"]
            for v in (0, 1)]
    near = rows.filter(F.col("key") <= max(last)).filter(F.col("key") <= F.when(F.col("toxic") == 0, last[0]).otherwise(last[1]))
    sample = stage(near.groupBy("toxic", "key").agg(F.min_by("text", F.xxhash64("text")).alias("text")).drop("key"), "sample")
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    marks = token_labels(sample, (n[0], n[1]))
    pieces = stage(rows_from(sample, _pieces, "piece string, toxic int, order long", TEXTS), "pieces")
    memo: dict[str, tuple[list[int], int]] = {}
    slots, labels = [], []
    for value in (0, 1):
        picked = pieces.filter(F.col("toxic") == value).orderBy("order", "piece").limit(TRAIN_TOKENS // 2 // CHAIN).collect()
        for tokens in (r["piece"].split() for r in picked):
            for w in tokens:
                if w not in memo:
                    memo[w] = (_slots(w), int(any(f in marks for f in features(w))))
            slots.append([memo[w][0] for w in tokens])
            labels.append([memo[w][1] * value for w in tokens])
    x = np.full((len(slots), CHAIN, 4), -1, dtype=np.int64)
    y, mask = np.zeros((len(slots), CHAIN), dtype=np.int64), np.zeros((len(slots), CHAIN), dtype=bool)
    for at, (s, lab) in enumerate(zip(slots, labels)):
        for j, f in enumerate(s):
            x[at, j, :len(f)] = f
        y[at, :len(lab)] = lab
        mask[at, :len(lab)] = True
    tagger = Tagger(*_train_field(x, y, mask))
    model = sample.sparkSession.sparkContext.broadcast(tagger)

    def summaries(texts: list) -> dict[str, object]:
        t = model.value
        t._memo = t.__dict__.get("_memo") or t.scorer()
        return {"summary": [t.summary(m) for m in t.tag(texts, t._memo)]}

    found = with_columns_from(sample, ["text"], summaries, "summary array<double>", drop=("text",), at_once=TEXTS).collect()
    found.sort(key=lambda r: (r["toxic"], r["summary"]))  # sums below do not depend on the order of tasks
    y = np.array([r["toxic"] for r in found])
    weight = np.where(y == 1, total[1] / n[1], total[0] / n[0])
    tagger.fit_scores(np.array([r["summary"] for r in found]), y.astype(float), weight / weight.mean())
    return tagger


def score_documents(docs: DataFrame, tagger: Tagger | None, text: str = "text", spans: bool = True,
                    drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with score (0 to 1), predicted (1 from 0.5) and, on request, toxic_spans:
    start, end (characters) and marginal of every token more likely toxic than not.

    Null and empty texts score as texts without a toxic token; without a tagger
    every score is 0.  Input columns with these names are replaced.
    """
    fields = "score double, predicted int" + (", toxic_spans array<struct<start:int,end:int,p:double>>" if spans else "")
    model = docs.sparkSession.sparkContext.broadcast(tagger)  # HASHED numbers, whatever the input

    def score(texts: list) -> dict[str, object]:
        t = model.value
        if t is None:
            return {"score": [0.0] * len(texts), "predicted": [0] * len(texts), "toxic_spans": [[] for _ in texts]}
        memo = t.__dict__.setdefault("_memo", None) or t.scorer()
        t._memo = memo
        texts = [x or "" for x in texts]
        tagged = t.tag(texts, memo)
        p = t.scores(tagged)
        out: dict[str, object] = {"score": p, "predicted": (p >= 0.5).astype(np.int32)}
        if spans:
            out["toxic_spans"] = [_spans(x, m) for x, m in zip(texts, tagged)]
        return out

    return with_columns_from(docs, [text], score, fields, drop, TEXTS)


def _spans(text: str, m: np.ndarray) -> list[dict]:
    if not (m >= 0.5).any():
        return []
    return [{"start": w.start(), "end": w.end(), "p": float(p)} for w, p in zip(re.finditer(r"\S+", text), m) if p >= 0.5]
