"""Toxicity: a word classifier kept even under swaps of identity terms."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled_rows, per_batch, stored

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")

# Words that name groups of people, in the corpus' languages; any may stand for any other of its row.
IDENTITY = (
    ("women", "men", "christians", "muslims", "jews", "hindus", "immigrants", "refugees", "gays", "lesbians", "blacks", "whites", "asians", "foreigners"),
    ("woman", "man", "christian", "muslim", "jew", "hindu", "immigrant", "refugee", "gay", "lesbian", "black", "white", "asian", "foreigner"),
    ("frauen", "männer", "christen", "muslime", "juden", "migranten", "flüchtlinge", "schwule", "schwarze", "weiße", "ausländer"),
    ("femmes", "hommes", "chrétiens", "musulmans", "juifs", "immigrés", "réfugiés", "noirs", "blancs", "étrangers"),
    ("mujeres", "hombres", "cristianos", "musulmanes", "judíos", "inmigrantes", "refugiados", "negros", "blancos", "extranjeros"),
)
GROUP = {w: row for row in IDENTITY for w in row}


def traits(text: str | None) -> set[str]:
    """The different words of a text, and their beginnings of 3 to 6 letters, marked ~."""
    words = set(WORD.findall((text or "").lower()))
    out = set(words)
    for k in (3, 4, 5, 6):
        out.update([w[:k] + "~" for w in words if len(w) >= k])
    return out


def swapped(text: str, turn: int) -> str | None:
    """The text with each identity term replaced by another of its row; None without such a term."""
    hit = False

    def other(m: re.Match) -> str:
        nonlocal hit
        row = GROUP.get(m[0])
        if not row:
            return m[0]
        hit = True
        return row[(row.index(m[0]) + 1 + turn % (len(row) - 1)) % len(row)]

    out = WORD.sub(other, text.lower())
    return out if hit else None


def flat(own: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(own)), [len(x) for x in own]), np.array([i for x in own for i in x], np.int64)


def chosen(sample: DataFrame, features: int, least: int, gain: float) -> list[str]:
    """The traits that tell most: at most `features`, in at least `least` texts, by their chi-square with the label."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[int]] = {}
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                for t in traits(text):
                    got = found.setdefault(t, [0, 0])
                    got[0] += 1
                    got[1] += y
        both = list(found.values())
        yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array([n for n, _ in both], pa.int64()), pa.array([k for _, k in both], pa.int64())], names=["trait", "n", "k"])

    size, base = sample.agg(F.count("*"), F.avg("y")).first()
    if not size or base in (0, 1):
        return []
    sums = sample.select("text", "y").mapInArrow(count, "trait string, n long, k long").groupBy("trait").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    told = sums.where(F.col("n") >= least).withColumn("gain", F.pow(F.col("k") - F.col("n") * base, 2) / (F.col("n") * base * (1 - base) + 1))
    return [r["trait"] for r in told.where(F.col("gain") >= gain).orderBy(F.desc("gain"), "trait").limit(features).collect()]


def numbered(sample: DataFrame, number: dict[str, int]) -> tuple[list, list, list]:
    """Each sampled text's label and trait numbers, and those of its sentences with identity terms before and after a swap."""
    terms = GROUP.keys()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(text: str) -> list[int]:
            return sorted(number[t] for t in traits(text) & number.keys())

        for batch in batches:
            rows = []
            for doc, text, y in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "y"))):
                rows.append((doc, y, of(text), None))
                for k, sentence in enumerate(SENTENCE.findall(text) if terms & set(WORD.findall(text.lower())) else ()):
                    if (other := swapped(sentence, k)) is not None:
                        rows.append((doc, None, of(sentence), of(other)))
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, kinds)], names=["doc", "y", "a", "b"])

    got = sample.select(F.col("doc").cast("long").alias("doc"), "text", "y").mapInArrow(run, "doc long, y int, a array<int>, b array<int>").collect()
    got.sort(key=lambda r: (r["doc"], r["a"], r["b"] or []))
    whole, pairs = [r for r in got if r["y"] is not None], [r for r in got if r["y"] is None]
    return [r["y"] for r in whole], [r["a"] for r in whole], [(r["a"], r["b"]) for r in pairs]


def fit(y: np.ndarray, own: list[list[int]], pairs: list[tuple[list[int], list[int]]], size: int, decay: float, even: float, steps: int) -> tuple[np.ndarray, float]:
    """Logistic regression; `even` weighs the mean squared change of a sentence's score when its identity terms are swapped."""
    r, c = flat(own)
    before, after = flat([a for a, _ in pairs]), flat([b for _, b in pairs])
    n, p, base = len(y), max(1, len(pairs)), y.mean()
    w, b = np.zeros(size), np.log(base / (1 - base))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        off = 1 / (1 + np.exp(-(np.bincount(r, w[c], n) + b))) - y
        change = np.bincount(before[0], w[before[1]], p) - np.bincount(after[0], w[after[1]], p)
        g = np.bincount(c, off[r], size) / n + decay * w / np.sqrt(n)
        g += even / p * (np.bincount(before[1], change[before[0]], size) - np.bincount(after[1], change[after[0]], size))
        g = np.append(g, off.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def train(documents: DataFrame, labels: DataFrame, rows: int = 6000, features: int = 8000, least: int = 3, gain: float = 5.0, decay: float = 0.0005, even: float = 1.0, steps: int = 400) -> dict:
    """A model from at most `rows` labelled texts outside the held-out third. {} without two classes: all score 0.5.

    Traits are counted where the texts are; the driver gets at most `features` traits and their numbers per text.
    """
    sample = stored(labelled_rows(documents, labels, "toxic", 3, 1, rows), "labelled")
    kept = chosen(sample, features, least, gain)
    y = np.zeros(0)
    if kept:
        number = {t: i for i, t in enumerate(dict.fromkeys([*kept, *sorted(GROUP)]))}
        y, own, pairs = numbered(sample, number)
        y = np.array(y, float)
    elif sample.isEmpty() or sample.select("y").distinct().count() < 2:
        return {}
    else:
        return {"bias": 0.0, "weights": {}}
    w, b = fit(y, own, pairs, len(number), decay, even, steps)
    return {"bias": b, "weights": {t: float(w[i]) for t, i in number.items() if w[i]}}


def score(documents: DataFrame, model: dict, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row's whole text; null as empty. No rows give no rows.

    Repeated rows score alike; other columns, also of the result's names, do no harm.
    """
    weights, bias = model.get("weights", {}), model.get("bias", 0.0)

    def run(batch: pa.RecordBatch) -> dict:
        get, known = weights.get, weights.keys()
        z = np.array([bias + sum(sorted(map(get, traits(t) & known))) for t in batch.column("text").to_pylist()])
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return {"doc_id": batch.column("doc_id"), "score": s, "predicted": (s >= threshold).astype(np.int32)}

    out = per_batch(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double, predicted int")
    return out.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")


def toxicity(documents: DataFrame, labels: DataFrame, rows: int = 6000, threshold: float = 0.7) -> DataFrame:
    """score() by a model fitted on at most `rows` labelled texts outside the held-out third."""
    return score(documents, train(documents, labels, rows), threshold)


def without_toxic(documents: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents that the classifier does not reject; rows with null ids and texts are scored too. Columns as given."""
    model = train(documents, labels)
    weights, bias = model.get("weights", {}), model.get("bias", 0.0)

    def toxic(texts):
        get, known = weights.get, weights.keys()
        z = np.array([bias + sum(sorted(map(get, traits(t) & known))) for t in texts])
        return texts.__class__(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return documents.where(F.pandas_udf(toxic, "double")(F.coalesce(documents["text"], F.lit(""))) < threshold)
