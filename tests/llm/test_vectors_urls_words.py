"""Whitening, url verdicts and divergences of sources against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from strandloom.llm import divergence, feast, url_filter, whitening

VECTORS = "vec_id long, embedding array<float>, label int, x int, n int, component int"


@pytest.mark.parametrize("spread", [np.ones(40), np.logspace(0, -6, 40), np.r_[np.ones(9), np.full(31, 0.5)], np.r_[1, np.zeros(39)]])
def test_leading_pairs(spread):
    q, _ = np.linalg.qr(np.random.default_rng(4).standard_normal((40, 40)))
    a = (q * spread) @ q.T
    a = (a + a.T) / 2
    e, v = feast.leading(a, 16)
    want = np.linalg.eigvalsh(a)[::-1][: len(e)]
    assert len(e) == min(16, (spread > 0).sum())
    assert np.abs(e - want).max() < 1e-14 * 10 and np.abs(a @ v - v * e).max() < 1e-13
    assert np.abs(v.T @ v - np.eye(len(e))).max() < 1e-13


def test_inertia_counts():
    a = np.random.default_rng(5).standard_normal((30, 30))
    a = a + a.T
    shifts = np.linspace(-12, 12, 50)
    assert (feast.above(*feast.tridiagonal(a), shifts) == (np.linalg.eigvalsh(a)[None] > shifts[:, None]).sum(1)).all()


def test_whitening(spark):
    rng = np.random.default_rng(6)
    m = (rng.standard_normal((80, 20)) * np.linspace(1, 0.2, 20)).astype(np.float32)
    rows = [(i, [float(x) for x in v], 1, 1, 1, 1) for i, v in enumerate(m)]
    bad = [(100, None, 1, 1, 1, 1), (101, [1.0, None] + [0.0] * 18, 1, 1, 1, 1), (102, [math.nan] * 20, 1, 1, 1, 1), (103, [math.inf] + [0.0] * 19, 1, 1, 1, 1), (104, [], 1, 1, 1, 1)]
    short = [(200 + i, [float(i), float(i * i)], 1, 1, 1, 1) for i in range(5)]
    alone = [(300, [1.0, 2.0, 3.0], 1, 1, 1, 1), (301, [1.0, 2.0, 3.0], 1, 1, 1, 1)]
    given = rows + rows[:7] + [(None, rows[3][1], None, None, None, None)] + bad + short + alone
    got = whitening.whitened(spark.createDataFrame(given, VECTORS)).toPandas()
    assert list(got.columns) == [c.split()[0] for c in whitening.SCHEMA.split(", ")]
    assert len(got) == (80 + 7 + 1) * 16 + 5 * 2
    x = np.floor(64 * m.astype(float)).astype(np.int64) + 1_000_000
    x = np.unique(x, axis=0)
    n, s = len(x), x.sum(0)
    e, v = np.linalg.eigh(((x - s / n).T @ (x - s / n)) / n)
    e, v = e[::-1][:16], v[:, ::-1][:, :16]
    for i in (0, 3, 79):
        own = got[got.vec_id == i].drop_duplicates("component").sort_values("component")
        y = np.floor(64 * m[i].astype(float)).astype(np.int64) + 1_000_000
        want = (y - s / n) @ v / np.sqrt(e)
        assert np.allclose(np.abs(own.whitened), np.abs(want), atol=1e-6) and (own.n == n).all()
        assert (own.deviation == ((n * y - s) ** 2).sum()).all()
        assert np.allclose(own.explained, e / np.trace(((x - s / n).T @ (x - s / n)) / n), rtol=1e-9)
    assert got.identity_error.max() < 1e-9 and got.vec_id.isna().sum() == 16
    assert whitening.whitened(spark.createDataFrame([], VECTORS)).count() == 0
    with pytest.raises(Exception, match="too large"):
        whitening.whitened(spark.createDataFrame([(1, [1e30], 1, 1, 1, 1)], VECTORS))


URLS = [
    None, "", "no scheme/casino", "://", "HTTP://WWW.Example.COM/en/x?y#z", "https://example.com/en/1", "https://example.com/de/1", "https://example.com", "https://notexample.com/en/1",
    "https://a.b.net/es/casino", "https://net/fr/", "https://b.net/it/casino", "https://b.net/it/casinos", "https://ads-track.org/", "https://ads-ads.org/", "https://bads-track.org/", "https://x.org/éads-track",
    "https://x.org/?u=http://c.com/win/free", "https://x.com?casino", "https://x.com#free/win", "ftp://u@host.com:21/a", "https://x.org/XXX", "https://x.org/" + "a" * 5000 + "-porn", "https://x.org/a b\nads\twin",
]


def judge(url):
    url = url or ""
    low = "".join(c.lower() if c.isascii() else c for c in url)
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]

    def found(terms):
        return sorted(t for t in terms if any((m.start() == 0 or not low[m.start() - 1].isalnum()) and (m.end() == len(low) or not low[m.end()].isalnum()) for m in re.finditer(f"(?=({t}))", low) for m in [re.compile(t).match(low, m.start())]))

    strict, soft = found(url_filter.STRICT), found(url_filter.SOFT)
    said = max(fits)[1:] if fits else (None, "block" if strict or len(soft) >= 2 else "allow")
    return (host, path, *said, ",".join(strict), ",".join(soft))


def test_urls(spark):
    rows = [(i, u, "html", "a", "b") for i, u in enumerate(URLS)] + [(0, URLS[4], None, None, None), (None, URLS[4], None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, rule string")
    got = sorted(tuple(map(str, r)) for r in url_filter.judged(pages).collect())
    assert got == sorted(tuple(map(str, (r[0], *judge(r[1])))) for r in rows)
    assert {judge(u)[3] for u in URLS} == {"allow", "block"}
    assert url_filter.judged(pages.where("false")).count() == 0
    con = duckdb.connect()
    con.register("pages", pages.toPandas().astype({"page_id": "Int64"}))
    assert sorted(tuple(map(str, r)) for r in con.execute(url_filter.oracle()).fetchall()) == got


def test_urls_of_other_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.b.c/x/y"), (2, "http://b.c/x/"), (3, "http://q/zz")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judged(pages, rules=(("b.c", "/x/y", "block"), ("a.b.c", "/x/", "allow"), ("c", "/", "block")), strict=("zz",)).collect()}
    assert got == {1: ("a.b.c/x/", "allow"), 2: ("c/", "block"), 3: (None, "block")}


def texts():
    rng = random.Random(8)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(16) for j in range(16)] + ["Éa", "straße", "x'y", "Q", "9", "tail"]
    rows = []
    for i in range(500):
        lang = rng.choice(["en", "en", "de", None])
        source = rng.choice(["a", "b", "c", "", None, "Z"])
        own = words if source != "b" else words[40:]
        rows.append((i, " ".join(rng.choice(own) for _ in range(min(int(rng.paretovariate(0.8) * 8), 300))), lang, source, 1, 2))
    return rows + [(900, None, "en", "silent", 1, 2), (901, "lone words here", "xx", "a", 1, 2), (902, "lone words here", "xx", "b", 1, 2), (903, "alone", "yy", "a", 1, 2)] + rows[:9]


def brute(rows, least=30, top=50):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))) for _, text, lang, source, *_ in rows]
    held, counts = Counter(), defaultdict(Counter)
    for lang, source, words in docs:
        held.update((lang, w) for w in set(words))
        counts[lang, source].update(words)
        counts[lang, None].update(words)
    out = []
    for lang in {d[0] for d in docs}:
        kept = [w for (la, w), n in held.items() if la == lang and n >= least]
        p = {s: {w: 1 + 10**9 * (c[w] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for w in kept} for (la, s), c in counts.items() if la == lang}
        for s in p.keys() - {None}:
            pairs = [(sum(abs(p[s][w] - p[t][w]) for w in kept), t) for t in p if t not in (s, None)]
            terms = [(p[s][w] - p[None][w], w) for w in kept if counts[lang, s][w] and p[s][w] > p[None][w]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.append((lang, s, part, item, v, rank))
    return sorted(out)


@pytest.mark.parametrize("block, sources", [(4096, 32), (40, 2)])
def test_divergence(spark, block, sources):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, p int").repartition(5)
    got = sorted(tuple(r) for r in divergence.divergences(docs, block=block, sources=sources).collect())
    want = brute(rows)
    assert got == want and sum(r[2] == "term" for r in want) > 100
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert sorted(con.execute(divergence.oracle()).fetchall()) == want
    assert divergence.divergences(docs.where("false"), block=block).count() == 0


def test_terms_in_pieces(monkeypatch):
    text = ("alpha Beta9gamma é " * 50).encode()
    whole, cut = Counter(), Counter()
    divergence.terms_in(text, whole)
    monkeypatch.setattr(divergence, "PIECE", 7)
    divergence.terms_in(text, cut)
    assert whole == cut == Counter({b"alpha": 50, b"beta": 50, b"gamma": 50, "é".encode(): 50})


def test_counts_of_full_tasks(spark):
    docs = spark.createDataFrame([(i, f"a{chr(97 + i % 26)} b", "en", "s") for i in range(60)], "doc_id long, text string, lang string, source string").coalesce(1)
    rows = divergence.counted(docs, held=5).where("term <> ''").groupBy("term").sum("n", "docs").collect()
    assert {bytes(r[0]): (r[1], r[2]) for r in rows}[b"b"] == (60, 60) and len(rows) == 27
