"""Language of texts by a bidirectional gated recurrent network over bytes.

A text's bytes are cut into windows.  One gated recurrent unit reads a window
forwards, another backwards, and both states label every byte with
probabilities of the languages.  The mean over all bytes of the text is the
document's.  The network is trained here, in numpy, by backpropagation through
time on windows from anywhere in the texts of a bounded sample of labelled rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import rows_from, stage, with_columns_from

TRAIN_DOCS = 400      # documents of a language in the training sample
WINDOW = 64           # bytes the network reads at a stretch
HIDDEN = 8            # units of each direction
STEPS, BATCH, RATE = 500, 128, 0.01
AT_ONCE = 2048        # windows labelled together
TRAIN_WINDOWS = STEPS * BATCH // 4  # windows of a language that training draws from
NONE = "und"


def windows_of(data: bytes) -> np.ndarray:
    """(windows, WINDOW) bytes; the last is filled with zeros."""
    n = -(-len(data) // WINDOW)
    return np.frombuffer(data.ljust(n * WINDOW, b"\0"), dtype=np.uint8).reshape(n, WINDOW)


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Direction:
    """A gated recurrent unit: input rows per byte, recurrent weights and candidate bias."""

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.p = {"e": rng.normal(0, 0.3, (256, 3 * hidden)), "u": rng.normal(0, 0.3, (hidden, 2 * hidden)),
                  "c": rng.normal(0, 0.3, (hidden, hidden))}

    def forward(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States (time, rows, hidden) for bytes (time, rows); with ``keep``, what the backward pass needs."""
        e, u, c = (self.p[k] for k in "euc")
        hidden = len(u)
        h = np.zeros((x.shape[1], hidden), dtype=e.dtype)
        out, tape = np.empty((*x.shape, hidden), dtype=e.dtype), []
        for t, b in enumerate(x):
            a = e[b]
            g = _sigmoid(a[:, :2 * hidden] + h @ u)
            z, r = g[:, :hidden], g[:, hidden:]
            n = np.tanh(a[:, 2 * hidden:] + (r * h) @ c)
            if keep:
                tape.append((h, z, r, n))
            h = n + z * (h - n)
            out[t] = h
        return out, tape

    def read(self, x: np.ndarray) -> np.ndarray:
        """``forward`` in single precision without the tape.  Signs and factors are folded
        into the tables, so that a gate is 1 / (1 + exp(.)) and the candidate 2 / (1 + exp(.)) - 1."""
        hidden = len(self.p["u"])
        e, u, c = (self.p[k].astype(np.float32) for k in "euc")
        gate_in, cand_in, u, c = -e[:, :2 * hidden].copy(), -2 * e[:, 2 * hidden:], -u, -2 * c
        h = np.zeros((x.shape[1], hidden), dtype=np.float32)
        out = np.empty((*x.shape, hidden), dtype=np.float32)
        with np.errstate(over="ignore"):
            for t, b in enumerate(x):
                g = h @ u
                g += np.take(gate_in, b, axis=0)
                np.exp(g, out=g)
                g += 1
                np.reciprocal(g, out=g)
                n = (g[:, hidden:] * h) @ c
                n += np.take(cand_in, b, axis=0)
                np.exp(n, out=n)
                n += 1
                np.divide(2, n, out=n)
                n -= 1
                h = h - n
                h *= g[:, :hidden]
                h += n
                out[t] = h
        return out

    def backward(self, x: np.ndarray, tape: list, grad: np.ndarray) -> dict[str, np.ndarray]:
        u, c = self.p["u"], self.p["c"]
        hidden = len(u)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        dh = np.zeros_like(grad[0])
        for t in range(len(x) - 1, -1, -1):
            h, z, r, n = tape[t]
            dh = dh + grad[t]
            dn = dh * (1 - z) * (1 - n * n)
            drh = dn @ c.T
            g["c"] += (r * h).T @ dn
            dgate = np.concatenate([dh * (h - n) * z * (1 - z), drh * h * r * (1 - r)], axis=1)
            g["u"] += h.T @ dgate
            np.add.at(g["e"], x[t], np.concatenate([dgate, dn], axis=1))
            dh = dh * z + drh * r + dgate @ u.T
        return g


class Labeller:
    """The two directions and the output layer."""

    def __init__(self, langs: list[str], seed: int = 1):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.fwd, self.bwd = Direction(rng, HIDDEN), Direction(rng, HIDDEN)
        self.out = {"w": rng.normal(0, 0.3, (2 * HIDDEN, len(langs))), "b": np.zeros(len(langs))}

    def states(self, x: np.ndarray, keep: bool = False):
        hf, tf = self.fwd.forward(x, keep)
        hb, tb = self.bwd.forward(x[::-1], keep)
        return np.concatenate([hf, hb[::-1]], axis=2), tf, tb

    def positions(self, x: np.ndarray) -> np.ndarray:
        """(time, rows, languages) probabilities for bytes (time, rows)."""
        w = self.out["w"].astype(np.float32)
        p = self.fwd.read(x) @ w[:HIDDEN]
        p += self.bwd.read(x[::-1])[::-1] @ w[HIDDEN:]
        p += self.out["b"].astype(np.float32)
        p -= p.max(axis=2, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=2, keepdims=True)
        return p

    def train(self, windows: np.ndarray, labels: np.ndarray) -> None:
        """Adam on the mean cross-entropy of all labelled bytes."""
        rng = np.random.default_rng(7)
        params = [self.fwd.p, self.bwd.p, self.out]
        m = [{k: np.zeros_like(v) for k, v in p.items()} for p in params]
        v = [{k: np.zeros_like(x) for k, x in p.items()} for p in params]
        for step in range(1, STEPS + 1):
            at = rng.integers(0, len(windows), BATCH)
            x, y = np.ascontiguousarray(windows[at].T), labels[at]
            s, tf, tb = self.states(x, keep=True)
            logits = s @ self.out["w"] + self.out["b"]
            p = np.exp(logits - logits.max(axis=2, keepdims=True))
            p /= p.sum(axis=2, keepdims=True)
            p[:, np.arange(BATCH), y] -= 1
            p *= (x != 0)[:, :, None]
            p /= max((x != 0).sum(), 1)
            ds = p @ self.out["w"].T
            grads = [self.fwd.backward(x, tf, ds[:, :, :HIDDEN]), self.bwd.backward(x[::-1], tb, ds[::-1, :, HIDDEN:]),
                     {"w": np.tensordot(s, p, axes=([0, 1], [0, 1])), "b": p.sum(axis=(0, 1))}]
            norm = np.sqrt(sum((g ** 2).sum() for d in grads for g in d.values()))
            rate = RATE * (1 - step / (STEPS + 1))
            for d, pp, mm, vv in zip(grads, params, m, v):
                for k, g in d.items():
                    g = g / max(1.0, norm)
                    mm[k] = 0.9 * mm[k] + 0.1 * g
                    vv[k] = 0.99 * vv[k] + 0.01 * g * g
                    pp[k] -= rate * (mm[k] / (1 - 0.9 ** step)) / (np.sqrt(vv[k] / (1 - 0.99 ** step)) + 1e-8)

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages): mean probabilities over all bytes of each text; zeros for an empty one."""
        cut = [windows_of(t) for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(c) for c in cut])
        total = np.zeros((len(texts), len(self.langs)))
        if len(owner):
            rows = np.concatenate(cut)
            for at in range(0, len(rows), AT_ONCE):
                x = np.ascontiguousarray(rows[at:at + AT_ONCE].T)
                p = self.positions(x)
                p *= (x != 0)[:, :, None]
                np.add.at(total, owner[at:at + AT_ONCE], p.sum(axis=0))
        return total / np.maximum(total.sum(axis=1, keepdims=True), 1e-30)


def _by_lang(values: dict) -> F.Column:
    """The value of the row's language; there are as many as the network has outputs."""
    return F.element_at(F.create_map(*[F.lit(x) for item in values.items() for x in item]), F.col("lang"))


def _sampled(batches):
    """All windows of texts, with a number that is random but the same in every run."""
    for b in batches:
        cut = [windows_of(t.encode()) for t in b["text"]]
        for lang, key, w in zip(b["lang"], b["key"], cut):
            at = np.arange(len(w), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key % 2 ** 64)
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # splitmix64
                at = (at ^ (at >> np.uint64(shift))) * np.uint64(factor)
            order = (at ^ (at >> np.uint64(31))).view(np.int64)
            yield {"lang": [lang] * len(w), "order": order, "window": [r.tobytes() for r in w]}


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", order: str = "doc_id",
          docs: int = TRAIN_DOCS) -> Labeller | None:
    """Fit on at most ``docs`` documents of each language, those with the smallest hashed id, one of an
    id; None without a labelled text.

    Whole texts are read, by tasks; the driver gets at most ``TRAIN_WINDOWS`` windows of a language,
    picked by hash from anywhere in these texts.
    """
    rows = labelled.filter(F.col(lang).isNotNull() & (F.length(F.trim(text)) > 0)).select(
        F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(order).alias("key"))
    keys = stage(rows.groupBy("lang", "key").count().drop("count"), "languages")
    langs = {r["lang"]: r["count"] for r in keys.groupBy("lang").count().collect()}
    if not langs:
        return None
    # four times as many as wanted lie below the first bound, so that not each task sends ``docs`` keys to one
    bound = {v: min(2.0 ** 63, 2.0 ** 64 * 4 * max(docs, 50) / n - 2.0 ** 63) for v, n in langs.items()}
    low = keys.filter(F.col("key").cast("double") <= _by_lang(bound))
    ranked = low.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("key")))
    last = {r["lang"]: r["last"] for r in ranked.filter(F.col("n") <= docs).groupBy("lang").agg(F.max("key").alias("last")).collect()}
    sample = stage(rows.filter(F.col("key") <= _by_lang(last)).groupBy("lang", "key")
                   .agg(F.min_by("text", F.xxhash64("text")).alias("text")), "sample")
    windows = rows_from(sample, _sampled, "lang string, order long, window binary", 50)
    first = windows.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("order", "window")))
    picked = first.filter(F.col("n") <= TRAIN_WINDOWS).drop("n").toPandas().sort_values(["lang", "order", "window"])
    langs = sorted(langs)
    labels = picked["lang"].map(langs.index).to_numpy()
    rows = np.frombuffer(b"".join(picked["window"]), dtype=np.uint8).reshape(-1, WINDOW)
    # as many windows of every language
    each = [np.flatnonzero(labels == k) for k in range(len(langs))]
    size = max(len(e) for e in each)
    at = np.concatenate([np.resize(e, size) for e in each])
    net = Labeller(langs)
    net.train(rows[at], labels[at])
    return net


def label_documents(docs: DataFrame, net: Labeller | None, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with lang_pred and score (the pooled probability of that language).

    Texts that are null or have no letter are ``und`` with score 0, as is every
    text without a trained network.  Input columns with these names are
    replaced.
    """
    model = docs.sparkSession.sparkContext.broadcast(net)  # a few thousand numbers

    def label(texts: list) -> dict[str, list]:
        lettered = [model.value is not None and t is not None and any(map(str.isalpha, t)) for t in texts]
        out = {"lang_pred": [NONE] * len(texts), "score": [0.0] * len(texts)}
        at = [i for i, ok in enumerate(lettered) if ok]
        if at:
            p = model.value.pooled([texts[i].encode() for i in at])
            for i, row in zip(at, p):
                k = int(row.argmax())
                out["lang_pred"][i], out["score"][i] = model.value.langs[k], float(min(row[k], 1.0))
        return out

    return with_columns_from(docs, [text], label, "lang_pred string, score double", drop)
