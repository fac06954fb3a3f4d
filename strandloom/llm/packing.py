"""Packing token sequences by linear grouping and best fit."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranked, stored


#: A word that ends in ASCII marks after an ASCII letter or digit: there the vocabulary's pattern always cuts.
MARKED = re.compile(rb"(.*[A-Za-z0-9])([!-/:-@\[-`{-~]+)", re.S)


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes; the ids of a run without ASCII white space are kept.

    The vocabulary drops white space, lower-cases, and never joins ids across white space or from letters or digits
    to marks, so a text's ids are those of its runs, and a run's those of its word and of the marks after it.
    Texts with <| may hold special tokens: their letters stay, and their runs stay whole.
    """

    def __init__(self, path: str, keep: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.keep, self.known, self.old = Tokenizer.from_file(path), keep, {}, {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def __call__(self, texts: list[str | None], end: int) -> list[bytes]:
        raw = [(t or "").encode() for t in texts]
        split = [(b if b"<|" in b else b.lower()).split() for b in raw]
        if len(self.known) > self.keep:  # what comes again is taken over from the old, the rest goes
            self.known, self.old = {}, self.known
        known, old, new, parts = self.known, self.old, set(), {}
        for w in set(chain.from_iterable(split)).difference(known):
            if w in old:
                known[w] = old[w]
                continue
            m = None if b"<|" in w else MARKED.fullmatch(w)
            parts[w] = m.groups() if m else (w,)
            for part in parts[w]:
                if part not in known:
                    if part in old:
                        known[part] = old[part]
                    else:
                        new.add(part)
        self.learn(new)
        for w, own in parts.items():
            if len(own) > 1:
                known[w] = known[own[0]] + known[own[1]]
        last = end.to_bytes(4, "little")
        return [b"".join([known[w] for w in words]) + last for words in split]

    def learn(self, new: set[bytes]) -> None:
        """Words of letters alone are encoded many at a time, and told apart by the tokens that end words."""
        known, alone = self.known, []
        letters = [w for w in new if w.isalpha() or (not w.isascii() and w.decode().isalpha())]
        for lo in range(0, len(letters), 2000):
            some = letters[lo : lo + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
            ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(ends) != len(some):
                alone += some
                continue
            raw, at = ids.tobytes(), 0
            for w, end in zip(some, ends.tolist()):
                known[w] = raw[at:end]
                at = end
        alone += new.difference(letters)
        for lo in range(0, len(alone), 5000):
            some = alone[lo : lo + 5000]
            for w, e in zip(some, self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)):
                known[w] = np.array(e.ids, "<u4").tobytes()


def pieces(documents: DataFrame, vocabulary: str, capacity: int = 4096, end: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the ids of each whole text and `end`, cut where longer than capacity."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = Encoder(vocabulary)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part, rows = batch.slice(lo, 1000), []
                for doc, ids in zip(part.column("doc_id").to_pylist(), encode(part.column("text").to_pylist(), end)):
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        rows.append((doc, k, at // 4, len(own) // 4, zlib.crc32(own)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=names)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def configuration(sizes: list[int], counts: list[int], room: int) -> list[int]:
    """How many of each size fill `room` best: a bounded knapsack on the filled length, larger sizes first on ties."""
    reach = np.zeros(room + 1, bool)
    reach[0] = True
    taken: list[tuple[int, int, np.ndarray]] = []
    for g, (size, count) in enumerate(zip(sizes, counts)):
        left, bit = min(count, room // size), 1
        while left > 0:
            k = min(bit, left)
            more = np.zeros(room + 1, bool)
            more[k * size :] = reach[: room + 1 - k * size]
            more &= ~reach
            taken.append((g, k, more))
            reach |= more
            left, bit = left - k, bit * 2
        if reach[room]:
            break
    at, out = int(np.flatnonzero(reach)[-1]), [0] * len(sizes)
    for g, k, more in reversed(taken):
        if more[at]:
            out[g] += k
            at -= k * sizes[g]
    return out


def plan(histogram: dict[int, int], capacity: int = 4096, groups: int = 256, small: int = 3) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, items, first sequence, items a sequence, offset): where each length's items go.

    The histogram has at most `capacity` lengths, and the plan is made of runs of equally filled sequences, so
    work and result do not grow with the items. Lengths over capacity/small are rounded up to the largest of
    their group, the groups being equally many items in falling order; configurations of the rounded sizes are
    chosen one after another, each around the largest size left and used as often as its counts allow; the
    items themselves, with their own lengths, take the places; shorter ones go by best fit, in falling order,
    into the room that is left.
    """
    placed: list[tuple[int, int, int, int, int, int]] = []
    next_rank = dict.fromkeys(histogram, 0)
    sequences = 0
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> runs (first sequence, sequences)

    def put(length: int, items: int, first: int, each: int, offset: int) -> None:
        placed.append((length, next_rank[length], items, first, each, offset))
        next_rank[length] += items

    large = sorted((s for s in histogram if s * small > capacity), reverse=True)
    total = sum(histogram[s] for s in large)
    grouped: list[list[list[int]]] = []  # runs [length, items], falling
    share, left = -(-total // groups) if total else 1, 0
    for s in large:
        n = histogram[s]
        while n:
            if not left:
                grouped.append([])
                left = share
            k = min(n, left)
            grouped[-1].append([s, k])
            n, left = n - k, left - k
    sizes, counts = [g[0][0] for g in grouped], [sum(n for _, n in g) for g in grouped]
    while any(counts):
        live = [g for g, n in enumerate(counts) if n]
        head = live[0]
        rest = configuration([sizes[g] for g in live], [counts[g] - (g == head) for g in live], capacity - sizes[head])
        use = {g: k + (g == head) for g, k in zip(live, rest) if k or g == head}
        times = min(counts[g] // k for g, k in use.items())
        for g, k in use.items():
            counts[g] -= k * times
        # each place of the configuration takes `times` items; sequences with equal lengths form a run
        slots = []
        for g, k in use.items():
            for _ in range(k):
                need, runs = times, []
                while need:
                    length, n = grouped[g][0]
                    k2 = min(n, need)
                    runs.append([length, k2])
                    need -= k2
                    if k2 == n:
                        grouped[g].pop(0)
                    else:
                        grouped[g][0][1] -= k2
                slots.append(runs)
        at = 0
        while at < times:
            step = min(runs[0][1] for runs in slots)
            offset = 0
            for runs in slots:
                put(runs[0][0], step, sequences + at, 1, offset)
                offset += runs[0][0]
                runs[0][1] -= step
                if not runs[0][1]:
                    runs.pop(0)
            room.setdefault(capacity - offset, []).append((sequences + at, step))
            at += step
        sequences += times
    for s in sorted((s for s in histogram if s * small <= capacity), reverse=True):
        need = histogram[s]
        while need:
            fits = min((r for r, runs in room.items() if r >= s and runs), default=None)
            if fits is None:
                each = capacity // s
                n = -(-need // each)
                room.setdefault(capacity, []).append((sequences, n))
                sequences += n
                continue
            first, n = room[fits].pop()
            each = min(fits // s, need)
            use = min(n, need // each)
            put(s, use * each, first, each, capacity - fits)
            room.setdefault(fits - each * s, []).append((first, use))
            if use < n:
                room[fits].append((first + use, n - use))
            need -= use * each
    return placed


def pack(documents: DataFrame, vocabulary: str, capacity: int = 4096, end: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row.

    A null or empty text is the end id alone. Equal lengths are interchangeable: only the lengths' counts, at
    most `capacity` numbers, reach the driver, and each item finds its place by its rank among its length. The
    plan that is broadcast is bounded by the capacity too. Repeated rows are packed as often as they come;
    no rows give no rows; other columns are left out.
    """
    cut = stored(pieces(documents, vocabulary, capacity, end), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    where = cut.sparkSession.createDataFrame(plan(histogram, capacity), "_l long, _r long, _n long, _s long, _e long, _o long")
    items = ranked(cut, ["length"], ["doc_id", "piece", "start", "ids_crc32"], "_rank", sum(histogram.values()))
    at = F.col("_rank") - F.col("_r")
    return items.join(F.broadcast(where), (F.col("length") == F.col("_l")) & (at >= 0) & (at < F.col("_n"))).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("_s") + F.floor(at / F.col("_e"))).cast("long").alias("sequence_id"), (F.col("_o") + at % F.col("_e") * F.col("length")).cast("long").alias("offset")
    )
