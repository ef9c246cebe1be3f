"""Clustering, mixing and phrases against plain versions and SQL, on the small tables and on awkward rows."""

import hashlib
import itertools
import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.llm import centroids, mixing, phrases, queries

SF = "/root/testdata/sf0.001"


def duck(sql, tables=("documents", "embeddings"), folder=SF):
    c = duckdb.connect()
    for t in tables:
        c.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet{'' if folder == SF else '/*.parquet'}')")
    got = c.execute(sql)
    names = [d[0] for d in got.description]
    return sorted([dict(zip(names, r, strict=True)) for r in got.fetchall()], key=str)


def same(df, want):
    got = [r.asDict() for r in df.collect()]
    key = lambda r: sorted((k, str(v)) for k, v in r.items())
    assert sorted(got, key=key) == sorted(want, key=key)


# Clustering


def plain_clusters(rows, clusters, rounds, size):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    hashed = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    c = [v for _, v in hashed[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        c = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else old for j, old in enumerate(c)]
    return [(i, near(v)[1], near(v)[0], hashlib.sha256(",".join(map(str, c[near(v)[1]])).encode()).hexdigest()) for i, v in kept]


ODD_VECTORS = [
    (1, [0.5, -0.5, 1.0, 2.0]),
    (1, [0.5, -0.5, 1.0, 2.0]),
    (2, None),
    (3, [0.5, None, 1.0, 2.0]),
    (4, [float("nan"), 0.0, 1.0, 2.0]),
    (5, [float("inf"), 0.0, 1.0, 2.0]),
    (6, [1.0, 2.0]),
    (None, [0.001, -0.001, 0.0, -2.5]),
    *[(i, [math.sin(i), math.cos(i * i), (i % 7) / 3, -(i % 5) / 2]) for i in range(7, 120)],
]


def test_clusters_of_awkward_vectors(spark):
    df = spark.createDataFrame([(i, v, "x") for i, v in ODD_VECTORS], "vec_id long, vec array<float>, distance string")
    assigned, final = centroids.cluster(df, 9, 4, vector="vec", size=4, block=3)
    want = plain_clusters([(r["vec_id"], r["vec"]) for r in df.collect()], 9, 4, 4)
    got = sorted(((r["vec_id"], r["cluster"], r["distance"], r["centroid_sha256"]) for r in assigned.collect()), key=str)
    assert got == sorted(want, key=str) and final.shape == (9, 4)
    sums = centroids.with_inertia(assigned).collect()
    by = defaultdict(int)
    for _, j, d, _ in want:
        by[j] += d
    assert all(r["cluster_inertia"] == by[r["cluster"]] and r["inertia"] == sum(by.values()) for r in sums)


def test_fewer_vectors_than_clusters_and_none(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "vec_id int, embedding array<float>")
    assigned, final = centroids.cluster(df, 5, 2, size=2)
    assert len(final) == 2 and sorted(r["distance"] for r in assigned.collect()) == [0, 0]
    empty, _ = centroids.cluster(df.limit(0), 5, 2, size=2)
    assert centroids.with_inertia(empty).collect() == [] and empty.columns == ["vec_id", "cluster", "distance", "centroid_sha256", "distances"]


def test_huge_components_are_held(spark):
    df = spark.createDataFrame([(1, [3e38] * 64), (2, [-3e38] * 64), (3, [0.0] * 64)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r["distance"] for r in centroids.cluster(df, 1, 0)[0].collect()}
    assert max(got.values()) in (64 * centroids.LARGEST**2, 64 * (2 * centroids.LARGEST) ** 2) and min(got.values()) == 0


def test_screening_loses_no_nearest_centroid():
    draw = np.random.default_rng(4)
    x, c = draw.integers(-900, 900, (500, 64)), draw.integers(-900, 900, (40, 64))
    c[7] = c[3]
    x[:40] = c
    best, distance, asked = centroids.nearest(x, centroids.norms(x, 8), c, 8)
    every = ((x[:, None, :] - c[None]) ** 2).sum(2)
    assert (best == every.argmin(1)).all() and (distance == every.min(1)).all() and asked <= every.size
    near = c[draw.integers(0, 40, 500)] * 5 + draw.integers(-9, 9, (500, 64))
    _, _, asked = centroids.nearest(near, centroids.norms(near, 8), c * np.arange(1, 41)[:, None], 8)
    assert asked < 0.7 * every.size


def test_op11(spark):
    same(queries.op11_centroids(spark, SF), duck(queries.ORACLES["op11_centroids"]))


# Mixing


def test_fit_meets_what_can_be_met():
    draw = np.random.default_rng(5)
    for _ in range(60):
        lengths = np.unique(draw.integers(1, 40, 6))
        counts = draw.integers(1, 4, len(lengths))
        budget = int(draw.integers(0, (lengths * counts).sum() + 1))
        sums = {int(np.dot(pick, lengths)) for pick in itertools.product(*[range(n + 1) for n in counts])}
        got = mixing.fit(lengths, counts, budget)
        assert (got >= 0).all() and (got <= counts).all()
        assert abs(int(np.dot(got, lengths)) - budget) == min(abs(s - budget) for s in sums)


def test_fit_of_large_budgets_is_exact_and_spreads():
    draw = np.random.default_rng(6)
    lengths = np.unique(draw.integers(1, 20_000, 3000))
    counts = draw.integers(1, 400, len(lengths))
    whole = int((lengths * counts).sum())
    for budget in (whole // 3, whole - int(lengths[0]), whole, 12_345, int(lengths[0])):
        got = mixing.fit(lengths, counts, budget)
        assert int(np.dot(got, lengths)) == budget and (got <= counts).all()
    third = mixing.fit(lengths, counts, whole // 3) / counts
    assert 0.31 < np.average(third[lengths > 10_000], weights=counts[lengths > 10_000]) < 0.36
    assert int(np.dot(mixing.fit(np.array([1_000_000, 7]), np.array([2, 5]), 999_990), [1_000_000, 7])) in range(1_000_000, 1_000_036)


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full: set = set()
    while True:
        rest = [s for s in names if s not in full]
        level = (sum(sizes.values()) - sum(3 * sizes[s] for s in full)) / max(1, sum(weight[s] for s in rest))
        more = {s for s in rest if weight[s] * level > 3 * sizes[s]}
        if not more:
            return {s: 3.0 * sizes[s] if s in full else weight[s] * level for s in names}
        full |= more


def check_mix(rows, docs):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(r["doc_id"]), r["size"]) for r in rows) == sorted((str(d), words(t)) for d, t, _ in docs)
    sizes = defaultdict(int)
    for _, t, s in docs:
        sizes[s] += words(t)
    aims, taken = plain_targets(sizes), defaultdict(int)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], aims[r["source"]], rel_tol=1e-12, abs_tol=1e-9)
        assert 0 <= r["times"] <= 3
        taken[r["source"]] += r["times"] * r["size"]
    return {s: (aims[s], taken[s]) for s in sizes}


def test_mix(spark):
    given = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    odd = [(None, None, None), (None, None, None), (1001, "", None), (1002, "one two\x0bthree", None), (1002, "one two\x0bthree", None), (1003, "x", "\U0001f600"), (1004, "a b", "￮"), (1005, "y " * 50_000, "src0")]
    df = spark.createDataFrame([(*r, 7, "t") for r in given + odd], "doc_id long, text string, source string, size int, target string")
    rows = mixing.mix(df).collect()
    near = defaultdict(lambda: 1)  # sums of up to three copies of each document, as bits
    for r in rows:
        for _ in range(3):
            near[r["source"]] |= near[r["source"]] << r["size"]
    missed = 0
    for name, (aim, taken) in check_mix(rows, given + odd).items():
        best = min(abs(s - aim) for s, bit in enumerate(bin(near[name])[:1:-1]) if bit == "1")
        assert abs(aim - taken) <= best + 1
        missed += best > 1
    assert missed < 4
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_mix_of_one_hot_length_in_shares(spark):
    rows = [(i, "one two three", "a") for i in range(900)] + [(i, "one", "b") for i in range(900, 1000)] + [(i, "one two", "c") for i in range(1000, 1010)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    old, mixing.SHARE_ROWS = mixing.SHARE_ROWS, 50
    try:
        got = mixing.mix(df).collect()
    finally:
        mixing.SHARE_ROWS = old
    done = check_mix(got, rows)
    assert done["b"] == (300.0, 300) and done["c"] == (60.0, 60) and abs(done["a"][0] - done["a"][1]) <= 1.5
    assert 2460 / 3 - 800 <= sum(r["times"] == 1 for r in got if r["source"] == "a") <= 900
    mixture = mixing.repeated(df.withColumn("mix", F.lit(1)), spark.createDataFrame(got))
    assert mixture.count() == sum(r["times"] for r in got) and mixture.columns == ["doc_id", "text", "source", "mix"]


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(df).collect() == []
    rows = mixing.mix(spark.createDataFrame([(1, None, None), (2, " ", "a")], df.schema)).collect()
    assert [(r["times"], r["target"]) for r in rows] == [(0, 0.0), (0, 0.0)]


# Phrases


def plain_phrases(rows, least, longest, top=2000, covered=100):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inner = defaultdict(int)
        for p, a in often.items():
            for i, j in itertools.combinations(range(len(p) + 1), 2):
                if j - i < len(p):
                    inner[p[i:j]] = max(inner[p[i:j]], a)
        found = []
        for p, a in often.items():
            if 100 * inner[p] < covered * a or not inner[p]:
                score, _, left, right = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [{"lang": lang, "rank": i + 1, "phrase": p.decode(), "a": -a, "l": left, "r": right, "n": n[lang], "score": -s} for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return out


ODD_TEXTS = [
    (None, "a a a a a. a a", 1),
    ("und", "A A\ta  a,a", 1),
    ("en", None, 1),
    ("en", "", 1),
    ("en", " \t.,;", 1),
    ("en", "Straße ÄÖ straße ÄÖ; x\x0by\x0cz", 1),
    ("fr", "of the one. of the one! of the two of the one\nof the three " * 40, 1),
    ("fr", "of the one. of the one! of the two of the one\nof the three " * 40, 1),
    ("de", "no piece ends here " * 3000, 1),
    ("de", "\x00 odd \x85 and   odd \x85 and " * 9, 1),
]


@pytest.mark.parametrize("block_words, part_counts", [(1 << 20, 1 << 21), (50, 40)])
def test_phrases_of_awkward_texts(spark, block_words, part_counts):
    df = spark.createDataFrame(ODD_TEXTS, "lang string, text string, a int").repartition(3)
    for least, longest, top, covered in ((2, 5, 2000, 100), (3, 3, 4, 60)):
        got = phrases.mine(df, least, longest, top, covered, block_words=block_words, part_counts=part_counts)
        same(got, plain_phrases([(x, t) for x, t, _ in ODD_TEXTS], least, longest, top, covered))


def test_phrases_of_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    same(phrases.mine(df, 12, block_words=4000, part_counts=3000), plain_phrases([(r["lang"], r["text"]) for r in df.collect()], 12, 5))


def test_phrases_of_nothing(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert phrases.mine(df).collect() == []
    assert phrases.mine(spark.createDataFrame([("en", "once only")], df.schema)).collect() == []


def test_packing():
    draw = np.random.default_rng(7)
    for values in (np.zeros(0, np.int64), np.array([-1, 5, 1 << 62, -(1 << 62), 0]), draw.integers(-9, 9, 1000)):
        assert (phrases.unpack(phrases.pack(values)) == values).all()


def test_scores_beyond_64_bits(spark):
    row = [(2, 9 * 10**9, 4 * 10**12, [5 * 10**11, 9 * 10**9], [9 * 10**9, 7 * 10**11])]
    df = spark.createDataFrame(row, "level int, a long, n long, heads array<long>, tails array<long>")
    assert df.select(F.expr(phrases._CUT).alias("c")).first()["c"]["score"] == 1000 * row[0][1] * row[0][2] // (row[0][3][0] * row[0][4][1])


def test_op13(spark):
    same(queries.op13_phrases(spark, SF), duck(queries.ORACLES["op13_phrases"]))
