"""Toxicity, whitening and clustering against plain versions and on rows at the edge."""

import hashlib
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strophe.llm import centroids, toxicity, whitening
from strophe.llm.exact_sums import joined, schema, split, summed

from .test_operators import EDGE, table

TEST = "/root/testdata/sf0.1"

# op11


def words_of(text):
    """Terms as they are defined: words in lower case, and how they begin."""
    import re

    out = set()
    for w in re.findall(r"[a-z0-9\x80-\xff]+", (text or "").lower().encode().decode("latin1")):
        out |= {w, *((w[:h], h) for h in toxicity.HEADS if len(w) > h)}
    return out


def test_terms_are_the_words_and_their_beginnings(monkeypatch):
    texts = ["Das, DAS das! wortlaut x1 ÉÀé", None, "", "...", "a b" * 400, " ".join(f"wort{i}" for i in range(300))]
    want = [len(words_of(t)) for t in texts]
    found = list(toxicity.buckets(pa.array(texts), 40))
    assert [len(b) for b in found] == want
    monkeypatch.setattr(toxicity, "SLICE", 100)
    assert [b.tolist() for b in toxicity.buckets(pa.array(texts), 40)] == [b.tolist() for b in found]


def test_held_out_documents_are_told_apart(spark):
    docs, labels = (spark.read.parquet(f"{TEST}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.judged(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out]
    caught, blamed = (np.mean([r.predicted for r in held if r.toxic == k]) for k in (1, 0))
    toxic, clean = (np.array([r.score for r in held if r.toxic == k]) for k in (1, 0))
    assert caught > 0.75 and blamed < 0.01 and np.mean(toxic[:, None] > clean[None, :]) > 0.97


def test_held_out_labels_are_not_learnt_from(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    other = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = [{r.doc_id: r.score for r in toxicity.judged(docs, x).collect()} for x in (labels, other)]
    assert scores[0] == scores[1]
    hidden = docs.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("x")})
    assert scores[0] == {r.doc_id: r.score for r in toxicity.judged(hidden, labels).collect()}


@pytest.mark.parametrize("factors", [0, toxicity.FACTORS])
def test_pairs_say_what_single_terms_do_not(spark, factors):
    """An insult with a group, or a jest with a friend, is toxic; the other two pairs are not: no sum of four weights says so."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(1600):
        insult, group = rng.integers(0, 2, 2)
        text = [("clown", "jests")[insult], ("folk", "mate")[group], *(f"w{x}" for x in rng.integers(0, 40, 6))]
        rng.shuffle(text)
        rows.append((i, " ".join(text), int(insult == group)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    machine = toxicity.fit(df, df.select("doc_id", "toxic"), factors=factors)
    got = toxicity.score(df, machine).join(df, "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    right = np.mean([(r.score >= 0.5) == r.toxic for r in got])
    assert len(got) > 400 and (right > 0.95 if factors else right < 0.65)


def test_toxicity_edges(spark, edge_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.judged(edge_docs, none).collect()
    assert len(rows) == len(EDGE) and {r.score for r in rows} == {0.5} and {r.held_out for r in rows if r.doc_id is None} == {False}
    odd = spark.createDataFrame([(1, 1), (2, 0), (2, None), (4, 0), (4, 1), (7, 1), (9, 0), (None, 1), (77, 1)], "doc_id long, toxic int")
    rows = toxicity.judged(edge_docs, odd).collect()
    assert len(rows) == len(EDGE) and all(0 <= r.score <= 1 for r in rows) and len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1
    assert toxicity.judged(edge_docs.limit(0), odd).collect() == []
    one = toxicity.judged(edge_docs, odd.where("toxic = 1")).collect()
    assert len({r.score for r in one}) == 1 and one[0].score > 0.5


@pytest.fixture(scope="module")
def edge_docs(spark):
    return table(spark, EDGE)


# op12


def brute(vectors):
    """n, S, V as exact fractions of the distinct integer vectors."""
    x = [[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, d = len(fit), len(fit[0])
    s = [sum(v[i] for v in fit) for i in range(d)]
    cov = np.array([[float(Fraction(sum((n * v[i] - s[i]) * (n * v[j] - s[j]) for v in fit), n**3)) for j in range(d)] for i in range(d)])
    return x, n, s, cov


def check_whitened(rows, ids, vectors, k):
    x, n, s, cov = brute(vectors)
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(rows) == len(vectors) * k == len(got)
    for i, vec in zip(ids, x, strict=True):
        off = np.array([float(Fraction(n * c - t, n)) for c, t in zip(vec, s, strict=True)])
        deviation = sum((n * c - t) ** 2 for c, t in zip(vec, s, strict=True))
        for c in range(k):
            r = got[i, c + 1]
            assert r.n == n and r.deviation == deviation and r.identity_error < 1e-9
            assert abs(abs(r.whitened) - abs(off @ v[:, c] / np.sqrt(e[c]))) < 1e-8 and abs(r.explained - e[c] / cov.trace()) < 1e-12


def test_whitening_equals_exact_covariances(spark, small, monkeypatch):
    emb = spark.read.parquet(f"{small}/embeddings.parquet").limit(60)
    rows = [(r.vec_id, list(r.embedding)[:7]) for r in emb.collect()]
    rows += [(1000 + i, rows[0][1]) for i in range(40)]  # copies weigh nothing in the fit
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    check_whitened(whitening.whiten(df, 5).collect(), [r[0] for r in rows], [r[1] for r in rows], 5)
    monkeypatch.setattr(whitening, "FITS", 3)  # sums that no 64 bits hold
    monkeypatch.setattr(whitening, "ENTRIES", 100)
    check_whitened(whitening.whiten(df, 5).collect(), [r[0] for r in rows], [r[1] for r in rows], 5)


def test_whitening_edges(spark):
    shape = "vec_id long, embedding array<float>, component int, x int, n long"
    nan, inf = float("nan"), float("inf")
    bad = [(1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [])]
    good = [(6, [0.5, 1.0]), (7, [0.25, -3.0]), (None, [2.0, 2.0]), (7, [0.25, -3.0]), (8, [1.0, 1.0, 1.0]), (9, [1.0, 1.0, 1.0])]
    rows = whitening.whiten(spark.createDataFrame([(*r, 1, 2, 3) for r in bad + good], shape)).collect()
    assert sorted((r.vec_id or 0, r.component) for r in rows) == sorted([(i or 0, c) for i, v in good for c in range(1, len(v) + 1)])
    assert {r.n for r in rows if r.vec_id in (6, 7, None)} == {3} and all(r.whitened is None and r.explained is None and r.deviation == 0 for r in rows if r.vec_id in (8, 9))
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9
    assert whitening.whiten(spark.createDataFrame([], shape)).collect() == []
    huge = whitening.whiten(spark.createDataFrame([(1, [3e38, 0.0], 0, 0, 0), (2, [-3e38, 1.0], 0, 0, 0), (3, [1.0, 5.0], 0, 0, 0)], shape)).collect()
    assert len(huge) == 6 and {r.deviation for r in huge if r.vec_id == 1} == {None} and all(np.isfinite(r.whitened) for r in huge if r.component == 1)


def test_exact_sums(spark):
    numbers = [2**100, -(2**120), 5, -7, 2**62, -1] * 50
    df = spark.createDataFrame([(i % 3, *limbs) for i, limbs in enumerate(zip(*split(numbers), strict=True))], schema("k int"))
    assert {r.k: joined(r) for r in summed(df, "k").collect()} == {k: sum(numbers[k::3]) for k in range(3)}


# op13


def plain_clusters(rows, k, rounds, d):
    rows = [(i, [int(np.floor(64 * float(np.float32(c)))) for c in v]) for i, v in rows]
    start = sorted(rows, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "~", r[1]))[:k]
    centres = [v for _, v in start]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min(range(len(centres)), key=lambda c: (far(v, centres[c]), c))
    for _ in range(rounds):
        of = [near(v) for _, v in rows]
        centres = [[sum(col) // len(own) for col in zip(*own, strict=True)] if (own := [v for (_, v), o in zip(rows, of, strict=True) if o == c]) else old for c, old in enumerate(centres)]
    out = [(i, near(v), far(v, centres[near(v)])) for i, v in rows]
    inertia = {c: sum(x[2] for x in out if x[1] == c) for c in range(k)}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(i, c, x, inertia[c], sum(inertia.values()), digest[c]) for i, c, x in out]


def by_key(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("fits", [centroids.FITS, 10])
def test_clusters_equal_an_exhaustive_search(spark, small, monkeypatch, fits):
    monkeypatch.setattr(centroids, "FITS", fits)
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(0, 1, 4) + 8 * (i % 3) if i % 2 else np.full(4, 0.5 * (i % 5))).astype(np.float32).tolist()) for i in range(120)] + [(3, [0.0, 0.0, 0.0, 0.0]), (None, [1.0, 2.0, 3.0, 4.0])] * 2
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert by_key(centroids.clustered(df, 6, 3, 4).collect()) == by_key(plain_clusters(rows, 6, 3, 4))


def test_clusters_equal_their_sql(spark, small):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{small}/embeddings.parquet'")
    df = centroids.op13_equal_average_clusters(spark, small)
    assert by_key(df.select(sorted(df.columns)).collect()) == by_key(con.sql(centroids.OP13_SQL).select(*sorted(df.columns)).fetchall())


def test_most_centroids_are_not_measured():
    rng = np.random.default_rng(0)
    centres = (rng.normal(0, 20, (64, 16)) + rng.normal(0, 200, (64, 1))).astype(np.int64).tolist()
    x = (rng.normal(0, 20, (2000, 16)) + rng.normal(0, 200, (2000, 1))).astype(np.int64)
    search = centroids.Search(centres)
    number, best = search.nearest(x)
    every = ((x[:, None, :] - np.array(centres)[None]) ** 2).sum(2)
    assert (number == every.argmin(1)).all() and (best == every.min(1)).all() and search.measured < 0.4 * every.size


def test_ties_go_to_the_smaller_number():
    search = centroids.Search([[4, 0], [0, 4], [4, 0], [2, 2], [-9, -9]])
    number, best = search.nearest(np.array([[4, 0], [2, 2], [1, 3], [3, 1], [-9, -8]]))
    assert number.tolist() == [0, 3, 1, 0, 4] and best.tolist() == [0, 0, 2, 2, 1]


def test_cluster_edges(spark):
    shape = "vec_id long, embedding array<float>, cluster int, x int"
    nan = float("nan")
    bad = [(1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [1.0]), (5, [1.0, 2.0, 3.0])]
    good = [(6, [0.5, 1.0]), (7, [0.25, -3.0]), (None, [2.0, 2.0]), (7, [0.25, -3.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in bad + good], shape)
    assert by_key(centroids.clustered(df, 16, 3, 2).collect()) == by_key(plain_clusters(good, 16, 3, 2))
    assert centroids.clustered(df.where("vec_id < 6"), 16, 3, 2).collect() == []
    huge = centroids.clustered(spark.createDataFrame([(1, [3e38, 0.0], 0, 0), (2, [-3e38, 1.0], 0, 0), (3, [1.0, 5.0], 0, 0)], shape), 2, 3, 2).collect()
    assert len(huge) == 3 and {r.cluster for r in huge} <= {0, 1}
