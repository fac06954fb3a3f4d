"""Quality: a linear-chain conditional random field over lines, gathered into documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled_sample, per_batch

# Classes of bytes. 0 letters and all beyond ASCII, 1 upper case, 2 digits, 3 space, 4 plain marks, 5 bars, 6 shouts, 7 other signs.
CLASS = np.full(256, 7, np.uint8)
CLASS[128:] = 0
CLASS[ord("a") : ord("z") + 1] = 0
CLASS[ord("A") : ord("Z") + 1] = 1
CLASS[ord("0") : ord("9") + 1] = 2
CLASS[[9, 11, 12, 13, 32]] = 3
CLASS[[ord(c) for c in ".,;:'\"-()"]] = 4
CLASS[ord("|")] = 5
CLASS[ord("!")] = 6
OWN = 14
WIDTH = 3 * OWN + 3


def lines_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines, WIDTH), each line's bytes plus 1, and the first line of each document (and the end)."""
    split = [(t or "").encode().split(b"\n") for t in texts]
    first = np.cumsum([0, *map(len, split)])
    lines = [x for s in split for x in s]
    size = np.array([len(x) for x in lines])
    joined = np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)
    starts = np.append(0, np.cumsum(size + 1)[:-1])
    kinds = CLASS[joined]
    own = np.zeros((len(lines), OWN))
    for k in range(8):
        own[:, k] = np.add.reduceat((kinds == k).astype(np.int64), starts)
    own[:, 7] -= 1  # the line end
    own[:, :8] /= np.maximum(size, 1)[:, None]
    own[:, 8] = np.log1p(size) / 8
    for i, line in enumerate(lines):
        words = line.split()
        n = len(words)
        own[i, 9] = (len(line) - n) / n / 10 if n else 0
        own[i, 10] = len(set(words)) / n if n else 1
        own[i, 11] = n <= 2
        own[i, 12] = line[-1:] == b"."
        own[i, 13] = i > 0 and line == lines[i - 1]
    own[first[:-1], 13] = 0  # what lies before is another document
    x = np.zeros((len(lines), WIDTH))
    x[:, :OWN] = own
    heads = np.zeros(len(lines), bool)
    heads[first[:-1]] = True
    tails = np.append(heads[1:], True)
    x[1:, OWN : 2 * OWN] = own[:-1]
    x[heads, OWN : 2 * OWN] = 0
    x[:-1, 2 * OWN : 3 * OWN] = own[1:]
    x[tails, 2 * OWN : 3 * OWN] = 0
    x[:, 3 * OWN], x[:, 3 * OWN + 1], x[:, 3 * OWN + 2] = 1, heads, tails
    return x, size + 1, first


def marginals(e: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward of all chains side by side. e: what `good` adds over `bad`, per line; trans[from, to].

    Returns each line's probability of `good`, the expected transitions of each chain (chains, 2, 2) and its log
    normaliser.
    """
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    head, n = first[:-1][order], count[order]
    longest = int(n[0]) if len(n) else 0
    live = np.searchsorted(-n, -np.arange(longest), side="left")  # chains with more than t lines
    fwd, back = np.zeros((len(e), 2)), np.zeros((len(e), 2))
    for t in range(longest):
        at = head[: live[t]] + t
        if t:
            before = fwd[at - 1]
            fwd[at, 0] = np.logaddexp(before[:, 0] + trans[0, 0], before[:, 1] + trans[1, 0])
            fwd[at, 1] = np.logaddexp(before[:, 0] + trans[0, 1], before[:, 1] + trans[1, 1]) + e[at]
        else:
            fwd[at, 1] = e[at]
    for t in range(longest - 2, -1, -1):
        at = head[: live[t + 1]] + t
        bad, good = back[at + 1, 0], back[at + 1, 1] + e[at + 1]
        back[at, 0] = np.logaddexp(trans[0, 0] + bad, trans[0, 1] + good)
        back[at, 1] = np.logaddexp(trans[1, 0] + bad, trans[1, 1] + good)
    both = fwd + back
    p = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))
    z = np.logaddexp(*fwd[first[1:] - 1].T)
    chain = np.repeat(np.arange(len(count)), count)
    inner = np.ones(len(e), bool)
    inner[first[:-1]] = False
    at, expected = np.flatnonzero(inner), np.zeros((len(count), 2, 2))
    for i in (0, 1):
        for j in (0, 1):
            log = fwd[at - 1, i] + trans[i, j] + back[at, j] + (e[at] if j else 0) - z[chain[at]]
            expected[:, i, j] = np.bincount(chain[at], np.exp(np.minimum(log, 0)), len(count))
    return p, expected, z


def gathered(p: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Log-odds of the mean probability of each document's lines, weighted by length."""
    mean = np.clip(np.add.reduceat(p * size, first[:-1]) / np.add.reduceat(size, first[:-1]), 1e-6, 1 - 1e-6)
    return np.log(mean / (1 - mean))


def train(sample: list[tuple[str, int]], steps: int = 120, decay: float = 1e-3) -> dict:
    """The field's weights and transitions, fitted on documents whose lines all take the document's label, and the
    two numbers that turn the gathered log-odds into a probability. {} without two classes: all score 0.5.
    """
    y = np.array([label for _, label in sample], float)
    if not len(y) or y.min() == y.max():
        return {}
    x, size, first = lines_of([t for t, _ in sample])
    count, n = np.diff(first), len(y)
    mean, spread = x.mean(0), x.std(0) + 1e-6
    mean[3 * OWN], spread[3 * OWN] = 0, 1
    x = (x - mean) / spread
    weight = 1 / np.maximum(count, 1) / n  # every document counts alike
    target = np.repeat(y, count)
    w, trans = np.zeros(WIDTH), np.zeros((2, 2))
    m, v = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
    chains = np.maximum(count - 1, 0)
    for step in range(1, steps + 1):
        p, expected, _ = marginals(x @ w, first, trans)
        g = x.T @ ((p - target) * np.repeat(weight, count)) + decay * w
        seen = np.zeros((n, 2, 2))
        seen[:, 0, 0], seen[:, 1, 1] = chains * (1 - y), chains * y
        gt = ((expected - seen) * weight[:, None, None]).sum(0) + decay * trans
        both = np.append(g, gt.ravel())
        m, v = 0.9 * m + 0.1 * both, 0.999 * v + 0.001 * both * both
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, trans = w - move[:WIDTH], trans - move[WIDTH:].reshape(2, 2)
    odds = gathered(marginals(x @ w, first, trans)[0], size, first)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps with a small ridge
        q = 1 / (1 + np.exp(-(a * odds + b)))
        h = q * (1 - q) + 1e-6
        g = np.array([((q - y) * odds).sum() + 0.01 * (a - 1), (q - y).sum()])
        k = np.array([[(h * odds * odds).sum() + 0.01, (h * odds).sum()], [(h * odds).sum(), h.sum()]])
        a, b = np.array([a, b]) - np.linalg.solve(k, g)
    return {"w": w / spread, "shift": -float((mean / spread) @ w), "trans": trans, "a": float(a), "b": float(b)}


def score_texts(texts: list[str | None], model: dict) -> np.ndarray:
    if not model:
        return np.full(len(texts), 0.5)
    x, size, first = lines_of(texts)
    odds = gathered(marginals(x @ model["w"] + model["shift"], first, model["trans"])[0], size, first)
    return 1 / (1 + np.exp(-np.clip(model["a"] * odds + model["b"], -30, 30)))


def score(documents: DataFrame, model: dict, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row's whole text; a null or empty text is one empty line.

    Repeated rows score alike whatever lies beside them, columns of the result's names in documents do no harm, and
    no rows give no rows. Texts are scored in slices of about 2 MB; a longer one alone.
    """

    def run(batch: pa.RecordBatch) -> dict:
        s = score_texts(batch.column("text").to_pylist(), model)
        return {"doc_id": batch.column("doc_id"), "score": s, "predicted": (s >= threshold).astype(np.int32)}

    out = per_batch(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double, predicted int")
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")


def quality(documents: DataFrame, labels: DataFrame, rows: int = 3000, threshold: float = 0.3) -> DataFrame:
    """score() by a field fitted on at most `rows` labelled texts, of at most 64 KiB each, outside the held-out fifth.

    Of a document labelled twice the larger label counts. Without labels of both kinds all score 0.5.
    """
    return score(documents, train(labelled_sample(documents, labels, "quality", 5, 0, rows)), threshold)
