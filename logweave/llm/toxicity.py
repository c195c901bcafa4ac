"""Toxicity scores from a bidirectional GRU with attention pooling, written and trained in numpy.

A word comes in by its characters (the label log-odds of its hashed 3- to 5-grams: largest and mean)
and as a whole (its own log-odds, and whether it was ever seen). These inputs are learnt from the
labelled sample; while the network is trained each document's inputs come from the half of the sample
that it isn't in, so that the network sees them as uncertain as they are on new texts.

A text is cut into overlapping windows (``window`` words every ``stride``, the last one flush with the
end), all of which are scored. The network is trained on the window of each document that it finds
worst at the time (multiple-instance learning). A text's score is a logistic function, fitted on the
sample, of its two largest window logits and the log of its number of windows.

The model is fitted on a bounded sample: at most about ``per_label`` labelled documents of each label,
those whose id hashes lowest. Scoring reads whole texts.

Defined results: a null or empty text has one empty window and so a score too; with labels of only one
kind (or none) every score is that share of label 1, or 0.5 without any; rows without a label are not
learnt from; repeated rows each get a row; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .words import U, mix

ORDERS = (3, 4, 5)
GRAM_BITS, WORD_BITS = 20, 18
EDGES = " .,;:!?\"'()[]{}<>#$%&*+-/=@\\^_`|~0123456789"
INPUTS = 5
HIDDEN = 8
ATTENTION = 8


def normal(token: str) -> str:
    return token.strip(EDGES) or token


def gram_ids(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(table place of each n-gram of each word, index of the word); word ends are marked."""
    text = "".join(f" {w} " for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(U)
    word = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    ids, whose = [], []
    for n in ORDERS:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        at = np.flatnonzero(word[:m] == word[n - 1 :])
        key = np.full(len(at), n, U)
        for k in range(n):
            key = mix(key + codes[at + k])
        ids.append((key >> U(64 - GRAM_BITS)).astype(np.int64))
        whose.append(word[at])
    return (np.concatenate(ids), np.concatenate(whose)) if ids else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def word_ids(words: list[str]) -> np.ndarray:
    """Table place of each whole word."""
    lengths = np.array([len(w) + 1 for w in words])
    codes = np.frombuffer("".join(w + " " for w in words).encode("utf-32-le", "replace"), np.uint32).astype(U)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return (mix(np.add.reduceat(mix(codes + mix(place.astype(U))), np.cumsum(lengths) - lengths)) >> U(64 - WORD_BITS)).astype(np.int64)


@dataclass
class Lexicon:
    """Log-odds of label 1 by document, of hashed n-grams and words; ``seen`` marks known words."""

    grams: np.ndarray
    words: np.ndarray
    seen: np.ndarray

    def inputs(self, words: list[str]) -> np.ndarray:
        """One row of network inputs for each word."""
        x = np.zeros((len(words), INPUTS), np.float32)
        if not words:
            return x
        ids, whose = gram_ids(words)
        if len(ids):
            order = np.argsort(whose, kind="stable")
            odds, whose = self.grams[ids[order]], whose[order]
            first = np.flatnonzero(np.diff(whose, prepend=-1))
            x[whose[first], 0] = np.maximum.reduceat(odds, first)
            x[whose[first], 1] = np.add.reduceat(odds, first) / np.diff(first, append=len(whose))
        at = word_ids(words)
        x[:, 2] = self.words[at]
        x[:, 3] = self.seen[at]
        x[:, 4] = 1
        return x


def log_odds(ones: np.ndarray, zeros: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Smoothed log-odds, shrunk where few documents tell; never-seen entries are 0."""
    n = ones + zeros
    return np.clip((np.log((ones + 0.5) / (n1 + 1)) - np.log((zeros + 0.5) / (n0 + 1))) * n / (n + 5), -2, 6).astype(np.float32)


def lexicon(counts: list[np.ndarray], words: list[np.ndarray], n: list[int]) -> Lexicon:
    """From document counts (of label 0, label 1) in the two tables."""
    return Lexicon(log_odds(counts[1], counts[0], n[1], n[0]), log_odds(words[1], words[0], n[1], n[0]), (words[0] + words[1] > 0).astype(np.float32))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Two GRUs, attention pooling, one logit. Columns of the gates: update, reset, candidate."""

    def __init__(self, rng: np.random.Generator):
        h, s = HIDDEN, lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float64)
        self.p = {"out": s(2 * h, 1), "out_b": np.zeros(1), "att": s(2 * h, ATTENTION), "att_b": np.zeros(ATTENTION), "att_v": s(ATTENTION, 1)}
        for d in "fb":
            self.p |= {f"w{d}": s(INPUTS, 3 * h), f"u{d}": s(h, 3 * h)}

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """States (B, W, H) of one direction, and what its backward pass needs."""
        w, u, h_n = self.p[f"w{d}"], self.p[f"u{d}"], HIDDEN
        b, steps, _ = x.shape
        proj, h = x @ w, np.zeros((b, h_n))
        states, kept = np.zeros((b, steps, h_n)), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            pre, a, m = h @ u, proj[:, t], mask[:, t, None]
            zr = sigmoid(a[:, : 2 * h_n] + pre[:, : 2 * h_n])
            z, r = zr[:, :h_n], zr[:, h_n:]
            c = np.tanh(a[:, 2 * h_n :] + r * pre[:, 2 * h_n :])
            kept.append((t, h, z, r, c, pre[:, 2 * h_n :]))
            h = np.where(m, (1 - z) * c + z * h, h)
            states[:, t] = h
        return states, kept

    def _back(self, x: np.ndarray, mask: np.ndarray, d: str, kept: list, d_states: np.ndarray, grad: dict) -> None:
        u, h_n = self.p[f"u{d}"], HIDDEN
        d_proj, dh, du = np.zeros((*x.shape[:2], 3 * h_n)), np.zeros((x.shape[0], h_n)), np.zeros_like(u)
        for t, h, z, r, c, pre_c in reversed(kept):
            dh = dh + d_states[:, t]
            m = mask[:, t, None]
            step = dh * m
            dc = step * (1 - z) * (1 - c * c)
            dz = step * (h - c) * z * (1 - z)
            dr = dc * pre_c * r * (1 - r)
            d_pre = np.concatenate([dz, dr, dc * r], axis=1)
            du += h.T @ d_pre
            d_proj[:, t] = np.concatenate([dz, dr, dc], axis=1)
            dh = dh * (1 - m) + step * z + d_pre @ u.T
        grad[f"u{d}"] = du
        grad[f"w{d}"] = np.tensordot(x, d_proj, ([0, 1], [0, 1]))

    def loss(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict, np.ndarray]:
        """(weighted log loss, gradients, logits) of a batch of windows."""
        p, mask = self.p, mask.astype(np.float64)
        (f, kept_f), (b, kept_b) = self._run(x, mask > 0, "f"), self._run(x, mask > 0, "b")
        o = np.concatenate([f, b], axis=2)
        a = np.tanh(o @ p["att"] + p["att_b"])
        e = (a @ p["att_v"])[..., 0] + np.where(mask > 0, 0, -1e9)
        alpha = np.exp(e - e.max(axis=1, keepdims=True)) * mask
        alpha /= np.maximum(alpha.sum(axis=1, keepdims=True), 1e-9)
        pooled = np.einsum("bw,bwh->bh", alpha, o)
        logit = (pooled @ p["out"] + p["out_b"])[:, 0]
        q = sigmoid(logit)
        loss = float(-(weight * (y * np.log(q + 1e-12) + (1 - y) * np.log(1 - q + 1e-12))).sum() / weight.sum())
        g: dict[str, np.ndarray] = {}
        dl = (weight * (q - y) / weight.sum())[:, None]
        g["out"], g["out_b"] = pooled.T @ dl, dl.sum(axis=0)
        d_pooled = dl @ p["out"].T
        d_alpha = np.einsum("bh,bwh->bw", d_pooled, o)
        d_o = alpha[..., None] * d_pooled[:, None]
        d_e = alpha * (d_alpha - (alpha * d_alpha).sum(axis=1, keepdims=True))
        g["att_v"] = np.tensordot(a, d_e, ([0, 1], [0, 1]))[:, None]
        d_a = d_e[..., None] * p["att_v"][:, 0] * (1 - a * a)
        g["att"], g["att_b"] = np.tensordot(o, d_a, ([0, 1], [0, 1])), d_a.sum(axis=(0, 1))
        d_o = d_o + d_a @ p["att"].T
        self._back(x, mask, "f", kept_f, d_o[..., :HIDDEN], g)
        self._back(x, mask, "b", kept_b, d_o[..., HIDDEN:], g)
        return loss, g, logit

    def adam(self, g: dict, state: dict, rate: float) -> None:
        state["t"] = t = state.get("t", 0) + 1
        for k, d in g.items():
            m, v = state.get(k, (np.zeros_like(d), np.zeros_like(d)))
            m, v = 0.9 * m + 0.1 * d, 0.999 * v + 0.001 * d * d
            state[k] = m, v
            self.p[k] -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)


class Runner:
    """Inference in float32 with both directions in one state; ``project`` turns word inputs into gate inputs once for each word."""

    def __init__(self, p: dict[str, np.ndarray]):
        h = HIDDEN
        self.p = {k: v.astype(np.float32) for k, v in p.items()}
        self.u = np.zeros((2 * h, 6 * h), np.float32)
        for i, d in enumerate("fb"):
            for gate in range(3):
                to = slice((2 * gate + i) * h, (2 * gate + i + 1) * h)
                self.u[i * h : (i + 1) * h, to] = self.p[f"u{d}"][:, gate * h : (gate + 1) * h]
        self.u[:, : 4 * h] *= 0.5  # sigmoid(x) = 0.5 + 0.5 tanh(x / 2)
        self.w = [self.p[f"w{d}"] * np.repeat(np.float32([0.5, 0.5, 1]), h) for d in "fb"]

    def project(self, inputs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return inputs @ self.w[0], inputs @ self.w[1]

    def logits(self, forward: np.ndarray, backward: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Logit of each window; ``rows`` (B, W) are places in the projected tables, all of them words."""
        b, steps = rows.shape
        n = 2 * HIDDEN
        if not steps:
            return np.full(b, float(self.p["out_b"][0]))
        h = np.zeros((b, n), np.float32)
        out = np.empty((steps, b, n), np.float32)
        columns = np.ascontiguousarray(rows.T)
        gates = np.empty((b, 3, 2, HIDDEN), np.float32)
        a = gates.reshape(b, 3 * n)
        for t in range(steps):
            gates[:, :, 0] = forward[columns[t]].reshape(b, 3, HIDDEN)
            gates[:, :, 1] = backward[columns[steps - 1 - t]].reshape(b, 3, HIDDEN)
            pre = h @ self.u
            zr = a[:, : 2 * n] + pre[:, : 2 * n]
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            c = zr[:, n:] * pre[:, 2 * n :]
            c += a[:, 2 * n :]
            np.tanh(c, out=c)
            h = h - c
            h *= zr[:, :n]
            h += c
            out[t, :, :HIDDEN] = h[:, :HIDDEN]
            out[steps - 1 - t, :, HIDDEN:] = h[:, HIDDEN:]
        e = (np.tanh(out.reshape(-1, n) @ self.p["att"] + self.p["att_b"]) @ self.p["att_v"]).reshape(steps, b)
        alpha = np.exp(e - e.max(axis=0))
        alpha /= alpha.sum(axis=0)
        return (np.einsum("wb,wbh->bh", alpha, out) @ self.p["out"] + self.p["out_b"])[:, 0].astype(np.float64)


def window_starts(n: int, window: int, stride: int) -> np.ndarray:
    """Starts of the overlapping windows of a text of n words; the last is flush with its end."""
    if n <= window:
        return np.zeros(1, np.int64)
    starts = np.arange(0, n - window, stride)
    return np.append(starts, n - window)


@dataclass
class Model:
    lexicon: Lexicon | None
    network: dict[str, np.ndarray] | None
    calibration: np.ndarray | None
    prior: float
    window: int = 64
    stride: int = 32


class Scorer:
    """Scores texts; keeps the gate inputs of up to ``limit`` tokens."""

    def __init__(self, model: Model, limit: int = 200_000):
        self.model, self.limit, self.at = model, limit, {}
        if model.network is not None:
            self.runner = Runner(model.network)
            self.f, self.b = (np.zeros((limit, 3 * HIDDEN), np.float32) for _ in range(2))

    def rows(self, tokens: list[str]) -> list[int]:
        rows = list(map(self.at.get, tokens))
        if None in rows:
            new = sorted({t for t, r in zip(tokens, rows, strict=True) if r is None})
            if len(self.at) + len(new) > self.limit:
                self.at = {}
                new = sorted(set(tokens))
            a = len(self.at)
            if a + len(new) > self.limit:  # one huge batch: room for it
                self.limit = len(new)
                self.f, self.b = (np.zeros((self.limit, 3 * HIDDEN), np.float32) for _ in range(2))
            self.f[a : a + len(new)], self.b[a : a + len(new)] = self.runner.project(self.model.lexicon.inputs([normal(t) for t in new]))
            self.at.update(zip(new, range(a, a + len(new)), strict=True))
            rows = list(map(self.at.__getitem__, tokens))
        return rows

    def window_logits(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [(t or "").lower().split() for t in texts]
        out: list[np.ndarray] = [np.zeros(0)] * len(texts)
        a = 0
        while a < len(split):  # about 100,000 words at a time
            b, n = a, 0
            while b < len(split) and (b == a or n + len(split[b]) <= 100_000):
                n += len(split[b])
                b += 1
            self._some(split[a:b], out, a)
            a = b
        return out

    def _some(self, split: list[list[str]], out: list[np.ndarray], base: int) -> None:
        rows = np.array(self.rows([w for s in split for w in s]), np.int64)
        first = np.cumsum([0] + [len(s) for s in split])
        w = self.model.window
        by_length: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i, s in enumerate(split):
            by_length.setdefault(min(len(s), w), []).append((i, first[i] + window_starts(len(s), w, self.model.stride)))
        for length, texts in by_length.items():
            starts = np.concatenate([s for _, s in texts])
            logits = np.concatenate([self.runner.logits(self.f, self.b, rows[starts[k : k + 1024, None] + np.arange(length)]) for k in range(0, len(starts), 1024)])
            at = 0
            for i, s in texts:
                out[base + i] = logits[at : at + len(s)]
                at += len(s)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.model.network is None:
            return np.full(len(texts), self.model.prior)
        return sigmoid(features(self.window_logits(texts)) @ self.model.calibration)


def features(logits: list[np.ndarray]) -> np.ndarray:
    """For each text: the largest and second largest window logit, the log of the number of windows, 1."""
    x = np.ones((len(logits), 4))
    for i, z in enumerate(logits):
        top = np.sort(z)[-2:]
        x[i, :3] = top[-1], top[0], np.log(len(z))
    return x


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps."""
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        q = sigmoid(x @ beta)
        g = x.T @ (weight * (q - y)) + ridge * beta
        hess = (x * (weight * q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(hess, g)
        beta -= step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
    return beta


def train(texts: list[str], labels: np.ndarray, weight: np.ndarray, epochs: int = 6, batch: int = 128, rate: float = 0.01, seed: int = 0, window: int = 64, stride: int = 32) -> Model:
    """Fit lexicon, network and calibration on a sample; ``weight`` gives each label its natural share."""
    labels = labels.astype(np.float64)
    prior = float((labels * weight).sum() / weight.sum()) if len(labels) else 0.5
    if len(labels) < 4 or labels.min() == labels.max():
        return Model(None, None, None, prior)
    rng = np.random.default_rng(seed)
    fold = np.zeros(len(texts), int)
    for y in (0, 1):
        mine = np.flatnonzero(labels == y)
        fold[rng.permutation(mine)[: len(mine) // 2]] = 1
    split = [t.lower().split() for t in texts]
    grams = np.zeros((2, 2, 1 << GRAM_BITS), np.float32)
    words = np.zeros((2, 2, 1 << WORD_BITS), np.float32)
    n = np.zeros((2, 2), int)
    for s, f, y in zip(split, fold, labels.astype(int), strict=True):
        kinds = sorted({normal(w) for w in s})
        n[f, y] += 1
        if kinds:
            grams[f, y, np.unique(gram_ids(kinds)[0])] += 1
            words[f, y, np.unique(word_ids(kinds))] += 1
    other = [lexicon(list(grams[1 - f]), list(words[1 - f]), list(n[1 - f])) for f in (0, 1)]
    whole = lexicon(list(grams.sum(0)), list(words.sum(0)), list(n.sum(0)))
    del grams, words
    net = Network(rng)
    inputs, starts = [], []
    for s, f in zip(split, fold, strict=True):
        kinds = sorted(set(s))
        at = {w: i for i, w in enumerate(kinds)}
        x = other[f].inputs([normal(w) for w in kinds])
        inputs.append(x[[at[w] for w in s]] if s else np.zeros((0, INPUTS), np.float32))
        starts.append(window_starts(len(s), window, stride))

    def worst(runner: Runner | None) -> tuple[np.ndarray, list[np.ndarray]]:
        """The start of the worst window of each text, and all logits; at first the window of largest inputs is worst."""
        pick, found = np.zeros(len(inputs), int), []
        for i, (x, s) in enumerate(zip(inputs, starts, strict=True)):
            if runner is None:
                z = np.array([x[a : a + window, 0].sum() + x[a : a + window, 2].sum() for a in s])
            else:
                f, b = runner.project(x)
                z = runner.logits(f, b, s[:, None] + np.arange(min(len(x), window)))
            found.append(z)
            pick[i] = s[int(z.argmax())]
        return pick, found

    state: dict = {}
    balance = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    for epoch in range(epochs):
        pick, _ = worst(Runner(net.p) if epoch > 1 else None)
        order = rng.permutation(len(inputs))
        for a in range(0, len(order), batch):
            mine = order[a : a + batch]
            x, mask = np.zeros((len(mine), window, INPUTS)), np.zeros((len(mine), window), bool)
            for row, i in enumerate(mine):
                part = inputs[i][pick[i] : pick[i] + window]
                x[row, : len(part)], mask[row, : len(part)] = part, True
            _, g, _ = net.loss(x, mask, labels[mine], balance[mine])
            net.adam(g, state, rate * (1 - epoch / (epochs + 1)))
    _, logits = worst(Runner(net.p))
    return Model(whole, net.p, logistic(features(logits), labels, weight), prior, window, stride)


def sample(labels: DataFrame, per_label: int) -> DataFrame:
    """doc_id, label and weight of about ``per_label`` rows of each label (0 or 1): those whose id hashes lowest."""
    counts = {r.label: r.n for r in labels.where("label in (0, 1)").groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = {y: min(1.0, per_label / counts[y]) if y in counts else 1.0 for y in (0, 1)}
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    mine = F.when(F.col("label") == 1, share[1]).when(F.col("label") == 0, share[0])
    return labels.where(place < mine).select("doc_id", "label", (F.lit(1.0) / mine).alias("weight"))


def fit(docs: DataFrame, labels: DataFrame, per_label: int = 1500, **options) -> Model:
    """Learn from the texts of ``docs`` (doc_id, text) that a bounded sample of ``labels`` (doc_id, label) names.

    The sample is drawn from the narrow label table and so small that it is sent to the texts, which stay where they lie.
    """
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample(labels, per_label)), "doc_id")
    rows = sorted(chosen.collect(), key=lambda r: (str(r.doc_id), r.text or ""))
    return train([r.text or "" for r in rows], np.array([r.label for r in rows]), np.array([r.weight for r in rows]), **options)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of ``docs``; only its text decides."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scorer.score(part.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, that score under ``threshold``; filtered where they lie."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for part in slices(batches):
            yield part.filter(pa.array(scorer.score(part.column(at).to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)
