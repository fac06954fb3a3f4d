"""Variants near genes as tiles: blocks of both that lie near each other meet as matrices, so rows move, not pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType, _parse_datatype_string

#: Pairs that leave a task at once.
STEP = 1 << 18


def classes(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows of a matrix, and which of them each row is."""
    m = np.ascontiguousarray(m + 0.0)
    _, first, which = np.unique(m.view(f"V{m.shape[1] * m.itemsize}").ravel(), return_index=True, return_inverse=True)
    return m[first], which.ravel()


def summed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products of each row of x with each of y, added one sample after another as over arrays: equal rows give equal bits."""
    out = np.zeros((len(x), len(y)))
    for a, b in zip(x.T, y.T):
        out += a[:, None] * b
    return out


def squares(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    for a in x.T:
        out += a * a
    return out


def centred(x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for a in x.T:
        total += a
    return x - (total / x.shape[1])[:, None]


def half_up(m: np.ndarray, digits: int) -> np.ndarray:
    """Rounded as Spark rounds: the shortest decimal, halves away from zero; only what is close to a half is done in decimals."""
    scaled = np.abs(m) * 10.0**digits
    with np.errstate(invalid="ignore"):
        whole = np.floor(scaled)
        out = np.copysign((whole + (scaled - whole >= 0.5)) / 10.0**digits, m)
        close = np.isfinite(m) & ((np.abs(scaled - whole - 0.5) < 1e-6) | (scaled > 1e9))
    step = Decimal(1).scaleb(-digits)
    out[close] = [float(Decimal(repr(v)).quantize(step, ROUND_HALF_UP)) for v in m[close].tolist()]
    return np.where(np.isfinite(m), out + 0.0, m)


def matrix(t: pa.Table, name: str) -> np.ndarray:
    return t[name].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(t.num_rows, -1)


def first_of(keys: list[np.ndarray], order: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(places, n): each key's first row by the order, and how many rows it has."""
    by = np.lexsort((*order[::-1], *keys))
    new = np.ones(len(by), bool)
    if len(by):
        new[1:] = np.any([np.diff(k[by]) != 0 for k in keys], axis=0)
    at = np.flatnonzero(new)
    return by[at], np.diff(np.append(at, len(by)))


def near(variants: DataFrame, genes: DataFrame, window: int, stats: Callable[[np.ndarray, np.ndarray], tuple[dict[str, np.ndarray], np.ndarray]], types: str, best: tuple[list[str], str, str] | None = None, block: int = 2048) -> DataFrame:
    """(phenotype_id, variant_id, tss_distance, what `types` declares, further columns of both sides) of the variants within a window of a gene's start.

    variants has variant_id, chrom, pos and x, genes has phenotype_id, chrom, tss and y; x and y are packed values, and
    further columns go with a pair. stats gives matrices, a row per different y and a column per different x, nan for
    null, and which entries are pairs. best (keys, strength, tie) leaves each key's pair of largest strength, ties to the
    smaller id, with n, how many it had.

    A tile is as wide as the window. A gene goes to the tiles that its window touches, a variant to its own; sides of over
    `block` rows are dealt into chunks, and each chunk of the one side meets each of the other in a task that holds two
    chunks and hands on the pairs bit by bit.
    """
    size = max(1, window)
    v = variants.withColumn("_b", F.floor(F.col("pos") / size).cast("long"))
    g = genes.withColumn("_b", F.explode(F.sequence(F.floor((F.col("tss") - window) / size), F.floor((F.col("tss") + window) / size)).cast("array<long>")))
    tile = ["chrom", "_b"]

    def chunks(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(*tile).agg(F.ceil(F.count("*") / F.lit(block)).cast("long").alias(name))

    sizes = chunks(v, "_m").join(chunks(g, "_n"), tile)

    def dealt(rows: DataFrame, key: str, own: str, parts: str, other: str, others: str) -> DataFrame:
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.col(others) - 1))
        return rows.join(sizes, tile).withColumn(own, F.pmod(F.xxhash64(key), F.col(parts))).withColumn(other, each).drop("_m", "_n")

    v_more = [c for c in variants.columns if c not in ("variant_id", "chrom", "pos", "x")]
    g_more = [c for c in genes.columns if c not in ("phenotype_id", "chrom", "tss", "y")]
    left = dealt(v, "variant_id", "_i", "_m", "_j", "_n").withColumnsRenamed({"variant_id": "id", "pos": "at", "x": "v"}).withColumn("_gene", F.lit(False))
    right = dealt(g, "phenotype_id", "_j", "_n", "_i", "_m").withColumnsRenamed({"phenotype_id": "id", "tss": "at", "y": "v"}).withColumn("_gene", F.lit(True))
    both = left.withColumn("at", F.col("at").cast("long")).unionByName(right.withColumn("at", F.col("at").cast("long")), allowMissingColumns=True)

    names = [f.name for f in _parse_datatype_string(types).fields]
    more = StructType([StructField(c, d[c].dataType) for cols, d in ((g_more, genes.schema), (v_more, variants.schema)) for c in cols])
    schema = StructType([StructField("phenotype_id", StringType()), StructField("variant_id", StringType()), StructField("tss_distance", LongType()), *_parse_datatype_string(types).fields, *more.fields])
    if best:
        schema = schema.add("n", LongType())
    arrow = to_arrow_schema(schema)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        a, b = t.filter(pc.invert(t["_gene"])).sort_by("at").combine_chunks(), t.filter(t["_gene"]).combine_chunks()
        if not a.num_rows or not b.num_rows:
            return
        (x, xs), (y, ys) = classes(matrix(a, "v")), classes(matrix(b, "v"))
        found, known = stats(x, y)
        pos, tss = a["at"].to_numpy(), b["at"].to_numpy()
        lo, hi = np.searchsorted(pos, tss - window), np.searchsorted(pos, tss + window, "right")
        until = np.cumsum(hi - lo)
        ranks = {}
        if best:
            for c in {*best[0], best[2]}:
                side = a["id"] if c == "variant_id" else b["id"] if c == "phenotype_id" else b[c] if c in g_more else a[c]
                ranks[c] = np.unique(np.array(side.to_pylist(), dtype=object).astype(str), return_inverse=True)[1].ravel()
        start = 0
        while start < len(tss):
            end = max(start + 1, int(np.searchsorted(until, (until[start - 1] if start else 0) + STEP, "right")))
            n = (hi - lo)[start:end]
            rows = np.repeat(np.arange(start, end), n)
            columns = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - lo[start:end], n)
            i, j = ys[rows], xs[columns]
            keep = known[i, j]
            if not keep.all():
                rows, columns, i, j = rows[keep], columns[keep], i[keep], j[keep]
            start = end
            if not len(rows):
                continue
            count = []
            if best:
                of = {c: r[columns] if c == "variant_id" or c in v_more else r[rows] for c, r in ranks.items()}
                at, held = first_of([of[c] for c in best[0]], [-found[best[1]][i, j], of[best[2]]])
                rows, columns, i, j, count = rows[at], columns[at], i[at], j[at], [pa.array(held)]
            own = [b["id"].take(pa.array(rows)), a["id"].take(pa.array(columns)), pa.array(pos[columns] - tss[rows])]
            own += [pa.array(found[k][i, j], from_pandas=True) for k in names] + [b[c].take(pa.array(rows)) for c in g_more] + [a[c].take(pa.array(columns)) for c in v_more] + count
            yield from pa.Table.from_arrays([(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c).cast(f.type) for c, f in zip(own, arrow)], schema=arrow).combine_chunks().to_batches()

    # both annotations by name: the future import would hide them from Spark
    meet.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    got = both.groupBy(*tile, "_i", "_j").applyInArrow(meet, schema)
    if not best:
        return got
    keys, strength, tie = best
    rest = [c for c in got.columns if c not in (*keys, tie, "n")]
    first = got.groupBy(*keys).agg(F.min(F.struct((-F.col(strength)).alias("_o"), tie, *rest)).alias("_f"), F.sum("n").alias("n"))
    return first.select(*(F.col(c) if c in (*keys, "n") else F.col(f"_f.{c}") for c in got.columns))


def pieces(n: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows that together stand for at most STEP pairs, or hold one row."""
    until, start = np.cumsum(n), 0
    while start < len(n):
        end = max(start + 1, int(np.searchsorted(until, (until[start - 1] if start else 0) + STEP, "right")))
        yield start, end
        start = end


def spread(n: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place): n[row] places from first[row] on, of each row."""
    return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first, n)


def parts_of(sizes: tuple[int, int], width: int, step: int, tasks: int) -> tuple[int, int]:
    """Into how many parts each side goes: as few as give that many tasks, of at most 64 MB of values and 262,144 rows."""
    most = max(1, min(1 << 18, (1 << 26) // (8 * max(1, width))))
    part = min(most, max(step, int((max(1, sizes[0]) * max(1, sizes[1]) / tasks) ** 0.5)))
    return tuple(max(1, -(-s // part)) for s in sizes)


def everywhere(variants: DataFrame, phenotypes: DataFrame, stats: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]], types: str, sizes: tuple[int, int], width: int, step: int = 2000, tasks: int = 64) -> DataFrame:
    """(variant_id, phenotype_id, what `types` declares, further columns of both sides) of what stats finds among all pairs.

    variants has variant_id and x, phenotypes has phenotype_id and y, packed values of `width` samples; sizes are about
    their rows. stats gets up to `step` different x and y and gives the places and values of the pairs that it leaves.

    A row goes once to each part of the other side. Parts are as large as `tasks` tasks allow, up to 64 MB of values, so
    that up to there the copies of a row don't grow with the tables; a task goes over its two parts step by step, and
    equal rows are compared once.
    """
    m, n = parts_of(sizes, width, step, tasks)

    def dealt(rows: DataFrame, key: str, own: str, parts: int, other: str, others: int) -> DataFrame:
        return rows.withColumn(own, F.pmod(F.xxhash64(key), F.lit(parts)).cast("long")).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))))

    v_more = [c for c in variants.columns if c not in ("variant_id", "x")]
    p_more = [c for c in phenotypes.columns if c not in ("phenotype_id", "y")]
    left = dealt(variants, "variant_id", "_i", m, "_j", n).withColumnsRenamed({"variant_id": "id", "x": "v"}).withColumn("_second", F.lit(False))
    right = dealt(phenotypes, "phenotype_id", "_j", n, "_i", m).withColumnsRenamed({"phenotype_id": "id", "y": "v"}).withColumn("_second", F.lit(True))
    declared = _parse_datatype_string(types).fields
    more = [StructField(c, d[c].dataType) for cols, d in ((v_more, variants.schema), (p_more, phenotypes.schema)) for c in cols]
    schema = StructType([StructField("variant_id", StringType()), StructField("phenotype_id", StringType()), *declared, *more])
    arrow = to_arrow_schema(schema)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        a, b = t.filter(pc.invert(t["_second"])).combine_chunks(), t.filter(t["_second"]).combine_chunks()
        if not a.num_rows or not b.num_rows:
            return
        (x, xs), (y, ys) = classes(matrix(a, "v")), classes(matrix(b, "v"))
        a, b = a.take(pa.array(np.argsort(xs, kind="stable"))), b.take(pa.array(np.argsort(ys, kind="stable")))
        na, nb = np.bincount(xs, minlength=len(x)), np.bincount(ys, minlength=len(y))
        fa, fb = np.cumsum(na) - na, np.cumsum(nb) - nb
        for k in range(0, len(x), step):
            for c in range(0, len(y), step):
                i, j, found = stats(x[k : k + step], y[c : c + step])
                i, j = i + k, j + c
                for s, e in pieces(na[i]):
                    hit, row = spread(na[i[s:e]], fa[i[s:e]])
                    for u, w in pieces(nb[j[s:e]][hit]):
                        of = j[s:e][hit[u:w]]
                        which, other = spread(nb[of], fb[of])
                        at, value = pa.array(row[u:w][which]), s + hit[u:w][which]
                        own = [a["id"].take(at), b["id"].take(pa.array(other)), *(pa.array(np.asarray(found[f.name])[value], from_pandas=True) for f in declared)]
                        own += [a[q].take(at) for q in v_more] + [b[q].take(pa.array(other)) for q in p_more]
                        yield from pa.Table.from_arrays([q.combine_chunks().cast(f.type) if isinstance(q, pa.ChunkedArray) else q.cast(f.type) for q, f in zip(own, arrow)], schema=arrow).combine_chunks().to_batches()

    meet.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return left.unionByName(right, allowMissingColumns=True).groupBy("_i", "_j").applyInArrow(meet, schema)


def by_distance(variants: DataFrame, genes: DataFrame, window: int = 50_000, most: int = 1 << 24, chunk: int = 1 << 15) -> DataFrame:
    """(phenotype_id, variant_id, tss_distance) of the variants within a window of a gene's start, nearest pairs first.

    A band is a range of distances that holds about `most` pairs by the tiles' counts, or one distance, and is one task;
    the tasks follow each other. Chunks of tiles, not pairs, are sent to the bands: a task takes its band's pairs from
    one pair of chunks after another and puts them in order by their distance, a small number.
    """
    size, tile = max(1, window), ["chrom", "_b"]
    v = variants.select("chrom", F.col("pos").cast("long").alias("at"), F.col("variant_id").alias("id")).withColumn("_b", F.floor(F.col("at") / size).cast("long"))
    g = genes.select("chrom", F.col("start_pos").cast("long").alias("at"), F.col("gene_id").alias("id"))
    g = g.withColumn("_b", F.explode(F.sequence(F.floor((F.col("at") - window) / size), F.floor((F.col("at") + window) / size)).cast("array<long>")))
    m, n = v.groupBy(*tile).agg(F.count("*").alias("_m")), g.groupBy(*tile).agg(F.count("*").alias("_n"))
    pairs, most_v, most_g = m.join(n, tile).agg(F.sum(F.col("_m").cast("double") * F.col("_n")), F.max("_m"), F.max("_n")).first()
    width = max(1, int((window + 1) / max(1.0, (pairs or 0.0) * 2 / 3 / most)))
    bands = -(-(window + 1) // width)

    def packed(rows: DataFrame, name: str, largest: int | None) -> DataFrame:
        parts = -(-(largest or 1) // chunk)
        own = F.pmod(F.xxhash64("id", "at"), F.lit(parts)) if parts > 1 else F.lit(0)
        return rows.groupBy(*tile, own.alias("_i")).agg(F.array_sort(F.collect_list(F.struct("at", "id"))).alias(name)).drop("_i")

    both = packed(v, "_v", most_v).join(packed(g, "_g", most_g), tile).select(F.col("_v.at").alias("va"), F.col("_v.id").alias("vi"), F.col("_g.at").alias("ga"), F.col("_g.id").alias("gi"))
    both = both.withColumn("_band", F.explode(F.sequence(F.lit(0), F.lit(bands - 1)))).repartitionById(bands, F.col("_band"))
    schema = StructType([StructField("phenotype_id", StringType()), StructField("variant_id", StringType()), StructField("tss_distance", LongType())])
    arrow = to_arrow_schema(schema)

    def found(lo: int, hi: int, pos: np.ndarray, tss: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the genes and of the variants, in order of position, at a distance from lo up to hi."""
        right = np.searchsorted(pos, tss + lo), np.searchsorted(pos, tss + hi)
        left = np.searchsorted(pos, tss - hi, "right"), np.searchsorted(pos, tss - max(lo, 1), "right")
        ends = [spread(b - a, a) for a, b in (left, right)]
        return np.concatenate([e[0] for e in ends]), np.concatenate([e[1] for e in ends])

    def of_used(places: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The different places, and which of them each is."""
        used = np.zeros(n, bool)
        used[places] = True
        return np.flatnonzero(used), (np.cumsum(used, dtype=np.int32) - np.int32(1))[places]

    def near_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {k: [] for k in ("gene", "variant", "far", "genes", "variants")}
        count = [0, 0]

        def leave() -> Iterator[pa.RecordBatch]:
            if not held["far"]:
                return
            gene, variant, far = (np.concatenate(held[k]) for k in ("gene", "variant", "far"))
            one, two = (pa.concat_arrays(held[k]) for k in ("genes", "variants"))
            by = np.argsort(np.abs(far).astype(np.uint16 if window < 1 << 16 else np.int64), kind="stable")
            for s in range(0, len(by), STEP):
                own = by[s : s + STEP]
                yield pa.RecordBatch.from_arrays([one.take(pa.array(gene[own])), two.take(pa.array(variant[own])), pa.array(far[own].astype(np.int64))], schema=arrow)
            count[:] = [0, 0]
            for k in held.values():
                k.clear()

        for batch in batches:
            for k in range(batch.num_rows):
                lo = batch["_band"][k].as_py() * width
                (pos, tss), (vi, gi) = (np.asarray(batch[c][k].values) for c in ("va", "ga")), (batch[c][k].values for c in ("vi", "gi"))
                by = np.argsort(pos, kind="stable")
                gene, place = found(lo, min(lo + width, window + 1), pos[by], tss)
                if len(gene):
                    place = by[place]
                    held["far"].append((pos[place] - tss[gene]).astype(np.int32 if window < 1 << 31 else np.int64))
                    (rows, gene), (cols, place) = of_used(gene, len(tss)), of_used(place, len(pos))
                    held["gene"].append(gene + np.int32(count[0]))
                    held["variant"].append(place + np.int32(count[1]))
                    held["genes"].append(gi.take(pa.array(rows)))
                    held["variants"].append(vi.take(pa.array(cols)))
                    count[0], count[1] = count[0] + len(rows), count[1] + len(cols)
                if width == 1 and sum(map(len, held["far"])) >= STEP:  # equal distances need no order
                    yield from leave()
        yield from leave()

    near_first.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return both.mapInArrow(near_first, schema)
