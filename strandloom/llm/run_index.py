"""Long repeats by a run-length index: run-compressed Burrows-Wheeler transforms and matching statistics."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch, runs, stored

LENGTH = 100  # of a repeated string
GRAM = 24  # of an anchor
PIECE = 500_000  # bytes hashed together; longer texts in pieces that share LENGTH - 1 bytes
PLACE = 21  # bits of a place among the bytes hashed together
KNOWN = 50_000  # anchors that a task remembers as repeated
SIDE = LENGTH - GRAM + 1  # how far a string reaches beyond its anchor: less than this
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
BYTES = np.random.default_rng(24).integers(0, 2**64, 256, np.uint64)


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, place, hash, first, end): of every LENGTH-byte string the leftmost GRAM of least hash, each place once.

    first and end bound the strings whose anchor lies there. Equal strings have their anchor at the same place
    within, whatever lies around them: hashes are compared by their leading bits, as many for every call.
    """
    joined = np.frombuffer(b"".join(texts), np.uint8)
    n, window = len(joined), LENGTH - GRAM + 1
    if n < LENGTH:
        return (np.zeros(0, np.int64),) * 5
    h = BYTES[joined]
    kept = None
    with np.errstate(over="ignore"):
        for step, odd in zip((1, 2, 4, 8), ODD):
            h = h[:-step] * np.uint64(odd) + h[step:]
            kept = h if step == 4 else kept  # of 8 bytes
        h = h[: n - GRAM + 1] * np.uint64(ODD[4]) + kept[16 : 16 + n - GRAM + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(ODD[5])
        h ^= h >> np.uint64(32)
    mask = np.uint64((1 << PLACE) - 1)
    least = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while width < window:
        step = min(width, window - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    starts = np.cumsum([0, *map(len, texts)])
    inside = np.zeros(n + 1, np.int64)
    long = np.diff(starts) >= LENGTH
    np.add.at(inside, starts[:-1][long], 1)
    np.add.at(inside, starts[1:][long] - LENGTH + 1, -1)
    window = np.flatnonzero(np.cumsum(inside[: len(least)]))
    at = (least[window] & mask).astype(np.int64)
    new = np.flatnonzero(np.append(True, at[1:] != at[:-1])[: len(at)])
    at, first, end = at[new], window[new], window[np.append(new[1:], len(at))[: len(new)] - 1] + LENGTH
    text = np.searchsorted(starts, at, side="right") - 1
    return text, at - starts[text], h[at].view(np.int64), first - starts[text], end - starts[text]


class RunIndex:
    """The run-compressed BWT of a few texts, with the place of each run's ends in the texts."""

    def __init__(self, texts: list[bytes]):
        self.size = np.array([len(t) for t in texts])
        self.starts = np.cumsum(np.append(0, self.size[:-1] + 1))
        self.text = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8) + np.uint8(1)  # UTF-8 has no byte 255: it ends texts, as 0
        n, width = len(self.text), 5
        body, key = np.append(self.text, np.zeros(width, np.uint8)).astype(np.uint64), np.zeros(n, np.uint64)
        for k in range(width):  # suffixes by their first 5, 10, 20, 40, 80, then LENGTH characters; ends are least
            key = key << np.uint64(8) | body[k : k + n]
        rank, order = self.numbered(key)
        while 2 * width <= LENGTH:
            rank, order = self.joined(rank, width)
            width *= 2
        rank, order = self.joined(rank, LENGTH - width)
        self.groups = rank.astype(np.int64)  # equal for equal LENGTH bytes
        self.group = self.groups[order]
        bwt = self.text[order - 1]
        new = np.append(True, bwt[1:] != bwt[:-1])
        self.run = np.flatnonzero(new)  # first row of each run
        self.head = bwt[self.run].astype(np.int64)
        last = np.append(self.run[1:], n) - 1
        self.sample = np.stack([order[self.run], order[last]])  # where the runs' first and last rows lie
        self.row = np.stack([self.run, last])
        length = last - self.run + 1
        by = np.argsort(self.head, kind="stable")
        base = np.empty(len(by), np.int64)
        base[by] = np.cumsum(length[by]) - length[by]
        self.lf = base - self.run  # what a step to the left adds to a row
        self.by, self.key = by, self.head[by] * len(by) + by

    @staticmethod
    def numbered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Dense ranks of the keys, and the places in their order; equal keys by place. Keys that leave room take the place along."""
        bits = len(key).bit_length()
        if int(key.max()).bit_length() + bits <= 64:
            packed = np.sort(key << np.uint64(bits) | np.arange(len(key), dtype=np.uint64))
            order, key = (packed & np.uint64((1 << bits) - 1)).astype(np.int64), packed >> np.uint64(bits)
        else:
            order = np.argsort(key, kind="stable")
            key = key[order]
        out = np.empty(len(key), np.uint64)
        out[order] = np.cumsum(np.append(False, key[1:] != key[:-1]))
        return out, order

    @classmethod
    def joined(cls, rank: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the pairs of the rank here and the one `step` on, and their order."""
        later = np.zeros(len(rank), np.uint64)
        later[: max(0, len(rank) - step)] = rank[step:] + np.uint64(1)
        return cls.numbered(rank * (rank.max() + np.uint64(2)) + later)

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many characters agree from the places a and b on, up to `most` or 128."""
        out, live = np.zeros(len(a), np.int64), np.arange(len(a))
        for lo in range(0, 128, 16):
            span = np.arange(lo, lo + 16)
            x, y = self.text[np.minimum(a[live, None] + span, len(self.text) - 1)], self.text[np.minimum(b[live, None] + span, len(self.text) - 1)]
            equal = (x == y) & (x > 0)
            k = np.where(equal.all(1), 16, equal.argmin(1))
            out[live] += k
            live = live[(k == 16) & (out[live] < most[live])]
            if not len(live):
                break
        return np.minimum(out, most)

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """Of every place of the texts: the length of the longest match found to its right, and the row of it.

        The texts stream through the index together, from their ends to their starts. Where the row's run has the
        next character to the left, the step is the run's; else the nearer end of the runs of that character
        before and after, the one that agrees longer, takes its place.
        """
        n, R = len(self.text), len(self.run)
        lengths, rows = np.zeros(n, np.int64), np.zeros(n, np.int64)
        order = np.argsort(-self.size, kind="stable")
        size, start = self.size[order], self.starts[order]
        row, length, place = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        for t in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -t, side="left"))
            at = start[:live] + size[:live] - 1 - t
            c = self.text[at].astype(np.int64)
            run = np.searchsorted(self.run, row[:live], side="right") - 1
            off = np.flatnonzero(self.head[run] != c)
            if len(off):
                after = np.searchsorted(self.key, c[off] * R + run[off])
                pick, known = np.zeros((2, len(off)), np.int64), np.zeros((2, len(off)), bool)
                for side, k in ((1, after - 1), (0, after)):  # the last row of the run before, the first of the one after
                    fine = (k >= 0) & (k < R)
                    j = self.by[np.clip(k, 0, R - 1)]
                    known[side], pick[side] = fine & (self.head[j] == c[off]), j
                agree = np.stack([np.where(known[s], self.common(at[off] + 1, self.sample[s, pick[s]], length[off]), -1) for s in (0, 1)])
                side = agree.argmax(0)
                run[off] = pick[side, np.arange(len(off))]
                row[off] = self.row[side, run[off]]
                length[off] = agree.max(0)
            row[:live] += self.lf[run]
            length[:live] += 1
            lengths[at], rows[at] = length[:live], row[:live]
        return lengths, rows


def repeats(segments: list[bytes], order: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(segment, start, end) of runs covered by LENGTH-byte strings that start earlier elsewhere in the segments.

    order: (rank of the document, place of the segment's start in it), one row a segment.
    """
    index = RunIndex(segments)
    lengths, rows = index.statistics()
    owner = np.repeat(np.arange(len(segments)), index.size + 1)
    inner = np.arange(len(owner)) - index.starts[owner]
    when = (order[owner, 0] << 36) + order[owner, 1] + inner
    whole = inner + LENGTH <= index.size[owner]
    first = np.full(int(index.groups.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, index.groups[whole], when[whole])
    hit = whole & (lengths >= LENGTH) & (first[index.group[rows]] < when)
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
        yield int(owner[a]), int(inner[a]), int(inner[b - 1]) + LENGTH


def text_id(b: bytes) -> int:
    """The leading 64 bits of the text's SHA-256. Texts that agree in them are still told apart by their least doc_id."""
    return int.from_bytes(hashlib.sha256(b).digest()[:8], "big", signed=True)


def table_of(columns: dict[str, tuple]) -> pa.RecordBatch:
    """From name -> (type, values)."""
    return pa.RecordBatch.from_arrays([pa.array(v, t) for t, v in columns.values()], names=list(columns))


SEGMENT = {"key": pa.int64(), "core": pa.int32(), "size": pa.int32(), "sid": pa.int64(), "segment": pa.binary(), "long": pa.int32(), "doc": pa.int64(), "tid": pa.int64(), "at": pa.int32(), "kinds": pa.int32()}
SCHEMA = "key long, core int, size int, sid long, segment binary, long int, doc long, tid long, at int, kinds int"


def pieces(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (text, start, bytes) of about PIECE bytes in all."""
    held: list[tuple[int, int, bytes]] = []
    total = 0
    for k, b in enumerate(texts):
        for lo in range(0, max(1, len(b) - LENGTH + 1), PIECE):
            part = b[lo : lo + PIECE + LENGTH - 1]
            if held and total + len(part) > PIECE:
                yield held
                held, total = [], 0
            held.append((k, lo, part))
            total += len(part)
    if held:
        yield held


def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, tid, spot): the anchors of the texts; spot is the place, how far its strings reach to the left and to the
    right, and whether it is sure that the anchor occurs twice.

    Of an anchor that the texts read together repeat, only the first place is sent to be matched with the rest; all
    its places are sure already. Anchors that this task has seen repeated lately aren't sent again.
    """
    known = np.zeros(0, np.int64)
    for batch in batches:
        texts = [t.encode() for t in batch.column("text").to_pylist()]
        ids = np.array([text_id(b) for b in texts], np.int64)
        for held in pieces(texts):
            text, at, h, first, end = anchors([b for _, _, b in held])
            if not len(h):
                continue
            which, start = np.array([k for k, _, _ in held])[text], np.array([lo for _, lo, _ in held])[text]
            tid = ids[which]
            spot = (at + start) << 14 | ((at - first) * SIDE + end - at - GRAM) << 1
            order = np.lexsort((spot, tid, h))
            h, tid, spot = h[order], tid[order], spot[order]
            new = np.append(True, (h[1:] != h[:-1]) | (tid[1:] != tid[:-1]) | (spot[1:] != spot[:-1]))
            h, tid, spot = h[new], tid[new], spot[new]
            head = np.append(True, h[1:] != h[:-1])
            heads = np.flatnonzero(head)
            count = np.diff(np.append(heads, len(h)))
            near = np.minimum(np.searchsorted(known, h[heads]), max(0, len(known) - 1))
            old = known[near] == h[heads] if len(known) else np.zeros(len(heads), bool)
            sure = np.repeat((count > 1) | old, count)
            to_match = heads[~old]
            yield table_of({"gram": (pa.int64(), np.append(h[to_match], tid[sure])), "tid": (pa.int64(), np.append(tid[to_match], tid[sure])), "spot": (pa.int64(), np.append(spot[to_match], spot[sure] | 1))})
            fresh = h[heads[(count > 1) & ~old]]
            known = np.union1d(known if len(known) < KNOWN else known[:0], fresh)


def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tid, spot) of sure anchors and of those that two places share; sorted by gram, tid, spot. Holds one row."""
    held: tuple[np.ndarray, ...] | None = None  # the last row, and whether its anchor has been shared
    shared = False
    for batch in batches:
        g, t, p = (batch.column(c).to_numpy() for c in ("gram", "tid", "spot"))
        sure = p & 1 > 0
        out = [(t[sure], p[sure])]
        g, t, p = g[~sure], t[~sure], p[~sure]
        told = 0
        if held is not None:
            g, t, p = np.append(held[0], g), np.append(held[1], t), np.append(held[2], p)
        if len(g):
            new = np.append(True, (g[1:] != g[:-1]) | (t[1:] != t[:-1]) | (p[1:] != p[:-1]))
            g, t, p = g[new], t[new], p[new]
            head = np.append(True, g[1:] != g[:-1])
            count = np.diff(np.append(np.flatnonzero(head), len(g)))
            many = count > 1
            if held is not None and shared:
                many[0] = True
                told = 1  # the held row has been given
            hit = np.repeat(many, count)
            hit[:told] = False
            out.append((t[hit], p[hit]))
            held, shared = (g[-1:], t[-1:], p[-1:]), bool(many[-1])
        yield table_of({"tid": (pa.int64(), np.concatenate([x for x, _ in out])), "spot": (pa.int64(), np.concatenate([x for _, x in out]) | 1)})


def settled(rows: list[tuple]) -> pa.RecordBatch:
    """Of rows (key, core, size, sid, long, doc, tid, at, segment), each an array: the earliest of each (key, sid), kinds 0;
    the others repeat it throughout and become marks, kinds -1, spread by their text."""
    *numbers, segment = zip(*rows)
    key, core, size, sid, long, doc, tid, at = (np.concatenate(x) for x in numbers)
    order = np.lexsort((at, tid, doc, sid, key))
    key, core, size, sid, long, doc, tid, at = (x[order] for x in (key, core, size, sid, long, doc, tid, at))
    same = np.append(False, (key[1:] == key[:-1]) & (sid[1:] == sid[:-1]))
    twin = same & np.append(False, (doc[1:] == doc[:-1]) & (tid[1:] == tid[:-1]) & (at[1:] == at[:-1]))
    keep = ~same | (~twin & (long >= LENGTH))
    values = [b for part in segment if part is not None for b in part]
    bodies = [None if s else values[k] for k, s in zip(order[keep].tolist(), same[keep].tolist())] if values else pa.nulls(int(keep.sum()), pa.binary())
    columns = (np.where(same, tid, key)[keep], core[keep], size[keep], sid[keep], bodies, long[keep], doc[keep], tid[keep], at[keep], np.where(same, -1, 0)[keep])
    return table_of({n: (t, c) for (n, t), c in zip(SEGMENT.items(), columns)})


def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The surroundings of each anchor, without their bytes: what the strings that have it reach."""
    import xxhash
    import zstandard

    unpack, h = zstandard.ZstdDecompressor(), xxhash.xxh64_intdigest
    rows, n = [], 0
    for batch in batches:
        for lo in range(0, batch.num_rows, 100):
            part = batch.slice(lo, 100)
            texts = [unpack.decompress(z) for z in part.column("z").to_pylist()]
            own = np.repeat(np.arange(len(texts)), pa.compute.list_value_length(part.column("spots")).to_numpy(zero_copy_only=False))
            spot = part.column("spots").flatten().to_numpy()
            place, reach = spot >> 14, spot >> 1 & 8191
            at, end = place - reach // SIDE, place + GRAM + reach % SIDE
            fits = end <= np.array([len(b) for b in texts])[own]  # not so only if texts agree in their tid
            own, place, at, end = own[fits], place[fits], at[fits], end[fits]
            key, sid = [], []
            for k, p, a, e in zip(own.tolist(), place.tolist(), at.tolist(), end.tolist()):
                b = texts[k]
                key.append(h(b[p : p + GRAM]))
                sid.append(h(b[a:e], p - a))
            doc, tid = (part.column(c).to_numpy()[own] for c in ("doc", "tid"))
            rows.append((np.array(key, np.uint64).view(np.int64), place - at, np.full(len(own), GRAM), np.array(sid, np.uint64).view(np.int64), end - at, doc, tid, at, None))
            n += len(own)
            if n > 50_000:
                yield settled(rows)
                rows, n = [], 0
    if n:
        yield settled(rows)


def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Longer anchors, to the left and to the right, of rows with bytes."""
    import xxhash

    h = xxhash.xxh64_intdigest
    for batch in batches:
        rows, bodies = [], []
        for key, core, size, s, doc, tid, at in zip(*(batch.column(c).to_pylist() for c in ("key", "core", "size", "segment", "doc", "tid", "at"))):
            more = (LENGTH - size + 1) // 2
            for side, a, b in ((0, core - more, core + size), (1, core, core + size + more)):
                lo, hi = max(0, b - LENGTH), min(len(s), a + LENGTH)
                if a >= 0 and b <= len(s) and hi - lo >= LENGTH:
                    bodies.append(s[lo:hi])
                    rows.append((h(s[a:b], (key + 2**63) ^ side) - 2**63, a - lo, b - a, h(bodies[-1], a - lo) - 2**63, hi - lo, doc, tid, at + lo))
        if rows:
            yield settled([(*(np.array(x, np.int64) for x in zip(*rows)), bodies)])


def told_apart(limit: int):
    """Over rows sorted by key, sid, doc, tid, at: the first of each (key, sid) with the number of kinds of its key,
    limit + 1 where there are more, and all others as marks. Lone kinds and short ones go. Holds limit rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the first rows of the last key, not given yet
        last: tuple | None = None  # the last row's key, sid, doc, tid, at
        over = False  # whether that key has been found to have more than limit kinds
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = batch.filter(pa.compute.equal(batch.column("kinds"), -1))
            own = batch.filter(pa.compute.equal(batch.column("kinds"), 0))
            if marks.num_rows:
                yield marks
            if not own.num_rows:
                continue
            key, sid, doc, tid, at, long = (own.column(c).to_numpy() for c in ("key", "sid", "doc", "tid", "at", "long"))
            first = np.append(last is None or (key[0], sid[0]) != last[:2], (key[1:] != key[:-1]) | (sid[1:] != sid[:-1]))
            twin = np.append(last is not None and (key[0], sid[0], doc[0], tid[0], at[0]) == last, (key[1:] == key[:-1]) & (sid[1:] == sid[:-1]) & (doc[1:] == doc[:-1]) & (tid[1:] == tid[:-1]) & (at[1:] == at[:-1]))
            later = own.filter(pa.array(~first & ~twin & (long >= LENGTH)))
            if later.num_rows:
                yield later.set_column(own.schema.get_field_index("kinds"), "kinds", pa.array(np.full(later.num_rows, -1, np.int32)))
            open_key, last = last and last[0], (key[-1], sid[-1], doc[-1], tid[-1], at[-1])
            fresh = pa.Table.from_batches([own.filter(pa.array(first))])
            if over:  # more kinds of the open key
                more = fresh.column("key").to_numpy() == open_key
                yield from counted(fresh.filter(pa.array(more)), limit, limit + 1)
                fresh = fresh.filter(pa.array(~more))
            elif held is not None:
                fresh = pa.concat_tables([held, fresh])
            closed = fresh.column("key").to_numpy() != last[0]
            yield from counted(fresh.filter(pa.array(closed)), limit)
            held = fresh.filter(pa.array(~closed))
            over = over and open_key == last[0]
            if held.num_rows > limit:
                yield from counted(held, limit, limit + 1)
                held, over = None, True
        if held is not None:
            yield from counted(held, limit)

    return run


def counted(table: pa.Table, limit: int, kinds: int | None = None) -> Iterator[pa.RecordBatch]:
    """The rows with the number of rows of their key, unless it is 1."""
    if not table.num_rows:
        return
    key = table.column("key").to_numpy()
    head = np.append(True, key[1:] != key[:-1])
    count = np.diff(np.append(np.flatnonzero(head), len(key)))
    n = np.full(len(key), kinds, np.int32) if kinds else np.minimum(np.repeat(count, count), limit + 1).astype(np.int32)
    table = table.set_column(table.schema.get_field_index("kinds"), "kinds", pa.array(n)).filter(pa.array((n > 1) & (table.column("long").to_numpy() >= LENGTH)))
    yield from table.combine_chunks().to_batches()


def with_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            some = part.column("some")
            own = np.repeat(np.arange(len(some)), pa.compute.list_value_length(some).to_numpy(zero_copy_only=False))
            flat = some.flatten()
            texts = [unpack.decompress(z) for z in part.column("z").to_pylist()]
            cut = [texts[k][a : a + n] for k, a, n in zip(own.tolist(), flat.field("at").to_pylist(), flat.field("long").to_pylist())]
            given = {"segment": pa.array(cut, pa.binary()), "doc": part.column("doc").take(pa.array(own)), "tid": part.column("tid").take(pa.array(own))}
            yield pa.RecordBatch.from_arrays([given[n] if n in given else flat.field(n).cast(t) for n, t in SEGMENT.items()], names=list(SEGMENT))


def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tid, doc, a, b): marks from run-length indexes over the segments of whole keys, some 3000 segments each."""
    for table in runs(batches, ["key"], 3000):
        key = table.column("key").to_numpy()
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        cuts = [0]
        for end in np.append(heads[1:], len(key)).tolist():
            if end - cuts[-1] >= 3000 or end == len(key):
                cuts.append(end)
        for lo, hi in zip(cuts, cuts[1:]):
            part = table.slice(lo, hi - lo)
            docs, tids, at = (part.column(c).to_numpy().astype(np.int64) for c in ("doc", "tid", "at"))
            by = np.lexsort((tids, docs))
            rank = np.empty(len(by), np.int64)
            rank[by] = np.cumsum(np.append(False, (docs[by][1:] != docs[by][:-1]) | (tids[by][1:] != tids[by][:-1])))
            marks = [(tids[k], docs[k], at[k] + a, at[k] + b) for k, a, b in repeats(part.column("segment").to_pylist(), np.stack([rank, at], 1))]
            if marks:
                yield table_of({n: (pa.int64(), c) for n, c in zip(("tid", "doc", "a", "b"), zip(*marks))})


def shrunk(batch: pa.RecordBatch) -> dict:
    import zstandard

    pack = zstandard.ZstdCompressor(level=1)
    texts = [t.encode() for t in batch.column("text").to_pylist()]
    return {"tid": [text_id(b) for b in texts], "sha": [hashlib.sha256(b).digest() for b in texts], "doc": batch.column("doc"), "z": [pack.compress(b) for b in texts]}


def kept(batch: pa.RecordBatch) -> dict:
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    out: dict[str, list] = {"n_removed": [], "n_spans": [], "kept": []}
    for z, a, b in zip(*(batch.column(c).to_pylist() for c in ("z", "a", "b"))):
        text, end, left, spans = unpack.decompress(z), 0, [], 0
        for lo, hi in sorted(zip(a, b)):
            if lo > end or not spans:
                left.append(text[end:lo])
                spans += 1
            end = max(end, hi)
        own = b"".join(left) + text[end:]
        for name, v in zip(out, (len(text) - len(own), spans, hashlib.sha256(own).hexdigest())):
            out[name].append(v)
    return {"tid": batch.column("tid"), "doc": batch.column("doc")} | out


def removed(documents: DataFrame, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of documents(doc_id, text).

    A byte is removed if a LENGTH-byte string that covers it also starts earlier: in a smaller doc_id, or earlier
    in the same document. Anchors that occur twice bring together the places around them; equal surroundings are
    one segment with its first place, and the different ones of an anchor go into run-length indexes, whose
    matching statistics mark what an earlier one has. An anchor with more than `limit` different segments is
    lengthened to the left and to the right, which every LENGTH-byte string survives on one side, until few are
    left or the anchor is the whole string. What repeats within a batch is gathered there, before any shuffle.
    Equal texts are one, with the smallest doc_id; they are told apart by their whole SHA-256.
    Null text: empty. A missing doc_id counts as the smallest; equal rows get equal results; other columns do no
    harm; no rows give no rows. Texts of any length are read in pieces.
    """
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc")
    whole = documents.select(doc, F.coalesce(F.col("text"), F.lit("")).alias("text"))
    spots = whole.select("text").mapInArrow(grams, "gram long, tid long, spot long")
    spots = spots.repartition("gram").sortWithinPartitions("gram", "tid", "spot").mapInArrow(repeated, "tid long, spot long")
    spots = spots.groupBy("tid").agg(F.collect_set("spot").alias("spots"))
    texts = per_batch(whole, shrunk, "tid long, sha binary, doc long, z binary").groupBy("tid", "sha").agg(F.min("doc").alias("doc"), F.first("z").alias("z"))
    found = stored(texts.drop("sha").join(spots, "tid"), "found")
    level, marks, size = found.mapInArrow(cut_out, SCHEMA), None, GRAM
    while True:
        order = ("key", "sid", "doc", "tid", "at")
        apart = stored(level.repartition("key").sortWithinPartitions(*order).mapInArrow(told_apart(limit), SCHEMA), "apart")
        again = apart.where("kinds = -1").select("tid", "doc", F.col("at").cast("long").alias("a"), (F.col("at") + F.col("long")).cast("long").alias("b"))
        apart = apart.where("kinds > 1")
        if size == GRAM:
            some = apart.groupBy("tid", "doc").agg(F.collect_list(F.struct("key", "core", "size", "sid", "long", "at", "kinds")).alias("some"))
            apart = stored(found.select("tid", "doc", "z").join(some, ["tid", "doc"]).mapInArrow(with_bytes, SCHEMA), "segments")
        few = apart.where(F.col("kinds") <= limit).select("key", "segment", "doc", "tid", "at")
        marked = again.union(few.repartition("key").sortWithinPartitions("key").mapInArrow(indexed, "tid long, doc long, a long, b long"))
        marks = marked if marks is None else marks.union(marked)
        hot = apart.where(F.col("kinds") > limit)
        if size >= LENGTH or hot.isEmpty():
            break
        level = hot.mapInArrow(extend, SCHEMA)
        size += (LENGTH - size + 1) // 2
    per_text = marks.groupBy("tid", "doc").agg(F.collect_set(F.struct("a", "b")).alias("m")).select("tid", "doc", "m.a", "m.b")
    result = per_batch(found.select("tid", "doc", "z").join(per_text, ["tid", "doc"]), kept, "tid long, doc long, n_removed long, n_spans long, kept string")
    sha = F.sha2(F.col("text").cast("binary"), 256)
    rows = whole.select("doc", F.octet_length("text").cast("long").alias("n_bytes"), sha.alias("sha"))
    first = rows.groupBy("sha").agg(F.min("doc").alias("first")).withColumn("tid", F.conv(F.substring("sha", 1, 16), 16, -10).cast("long"))
    result = result.withColumnsRenamed({"tid": "_t", "doc": "_d"})
    first = first.join(result, (F.col("tid") == F.col("_t")) & (F.col("first") == F.col("_d")), "left").withColumnRenamed("sha", "_s")
    out = rows.join(first, F.col("sha") == F.col("_s"))
    copy = (F.col("doc") != F.col("first")) & (F.col("n_bytes") >= LENGTH)
    return out.select(
        F.when(F.col("doc") != -(2**63), F.col("doc")).alias("doc_id"),
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, hashlib.sha256(b"").hexdigest()).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )
