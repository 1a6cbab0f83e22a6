"""The ring key by key, language evidence row by row, the SQL of the operators, and the pipeline on rows at the edge."""

import math
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strophe.llm import common, langid, media, near_dedup, sharding, suffix_dedup
from strophe.llm.queries import ORACLES, QUERIES

from .test_operators import EDGE, check_pack, table

# op5


def placed_one_by_one(keys, shards):
    """Keys (arc, rank) dealt to shards one after another: at home while there is room, then on clockwise."""
    points, owner = sharding.ring(shards)
    room = [len(keys) // shards + (s < len(keys) % shards) for s in range(shards)]
    out, over = {}, []
    for arc, rank in sorted(keys):
        s = int(owner[arc])
        if room[s]:
            out[arc, rank] = s
            room[s] -= 1
        else:
            over.append((arc, rank))
    for arc, rank in over:
        at = arc
        while True:
            at = (at + 1) % len(owner)
            if room[owner[at]]:
                out[arc, rank] = int(owner[at])
                room[owner[at]] -= 1
                break
    return out


@pytest.mark.parametrize("shards", [3, 8])
def test_ring_places_keys_as_one_by_one(spark, shards):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 5).cast("int")).alias("text"))
    hashes = {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    points, _ = sharding.ring(shards)
    rows = sharding.shard(df, shards).collect()
    arcs = defaultdict(list)
    for r in rows:
        assert r.arc == np.searchsorted(points, np.array([hashes[r.doc_id]], np.int64).view(np.uint64))[0] % len(points)
        arcs[r.arc].append(r)
    want = placed_one_by_one([(a, k) for a, m in arcs.items() for k in range(len(m))], shards)
    for a, members in arcs.items():  # which of an arc's keys go on is a matter of their order, how many go where is not
        assert Counter(r.shard for r in members) == Counter(want[a, k] for k in range(len(members)))


# op10


def judged(rows, model, languages=langid.LANGUAGES):
    """(lang, posterior) of each of rows (text, declared, suffix, levels), by the formulas, one by one."""
    size, told = len(languages), []
    for text, *_ in rows:
        codes = langid.grams(np.frombuffer(f" {text or ''}  ".encode(), np.uint8))
        codes = codes[codes > 0]
        w = min(1.0, langid.WEIGHT / max(len(codes), 1))
        t = np.array([float(np.sum(m[codes].astype(np.float64))) * w for m in model])
        p = np.exp(t - t.max()) / np.exp(t - t.max()).sum() if len(codes) else np.zeros(size)
        told.append((len(codes), t, p, -len(codes) * w * math.log(langid.GRAMS)))
    sums = defaultdict(lambda: np.zeros(size))
    for (*_, levels), (_, _, p, _) in zip(rows, told, strict=True):
        for d in range(len(levels) + 1):
            sums[tuple(x or "" for x in levels[:d])] += p
    out = []
    for (_, declared, suffix, levels), (n, t, p, u) in zip(rows, told, strict=True):
        if not n:
            out.append(("und", 1.0))
            continue
        prior = (sums[()] + 1) / (sums[()].sum() + size)
        names = [x or "" for x in levels]
        for d in range(1, len(names)):
            s = sums[tuple(names[:d])]
            prior = (s + langid.STRENGTH * prior) / (s.sum() + langid.STRENGTH)
        own = np.maximum(sums[tuple(names)] - p, 0)
        score = t + np.log((own + langid.STRENGTH * prior) / (own.sum() + langid.STRENGTH))
        for said, wrong in ((declared and declared.lower(), langid.DECLARED_WRONG), (langid.SUFFIXES.get((suffix or "").lower()), langid.SUFFIX_WRONG)):
            if said in languages:
                score = score + np.log([1 - wrong if x == said else wrong / (size - 1) for x in languages])
        every = np.append(score, u + math.log(langid.UNKNOWN))
        share = np.exp(every - every.max()) / np.exp(every - every.max()).sum()
        out.append(max((float(s), x) for s, x in zip(share, (*languages, "und"), strict=True))[::-1])
    return out


def test_language_evidence_is_fused_as_by_hand(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = langid.fit(docs)
    rows = [(r.text[: 30 + 40 * (i % 7)], [None, "EN", "de", "xx"][i % 4], [None, "de", "mx", "com"][i % 3], (["com", "de", None][i % 3], f"d{i % 5}", f"h{i % 11}")) for i, r in enumerate(docs.orderBy("doc_id").limit(120).collect())]
    rows += [(None, "fr", None, (None, None, None)), ("", "fr", "fr", ("fr", "d", "h")), ("12 34", "fr", None, ("fr", "d", "h")), ("a", None, None, ("fr", "d", "h"))]
    df = spark.createDataFrame([(i, t, d, s, *levels) for i, (t, d, s, levels) in enumerate(rows)], "id long, text string, declared string, suffix string, a string, b string, c string")
    for levels, given in ((["a", "b", "c"], rows), (["b"], [(t, d, s, (x[1],)) for t, d, s, x in rows])):
        got = {r.id: r for r in langid.identify(df, model, levels, ["id"]).collect()}
        for i, (lang, p) in enumerate(judged(given, model)):
            assert (got[i].lang, got[i].accepted) == (lang, lang != "und") and abs(got[i].posterior - p) < 2e-6


def test_documents_have_suffixes_and_families(spark, small):
    """The query's own evidence: declared language, the first address in the text, and priors of families of sources."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    end = ["", " see http://www.zeitung.DE/x or a@b.fr", " mail x.y@correo.mx", " at https://example.com/en"]
    own = [(r.text[: 20 + 30 * (i % 9)] + end[i % 4], r.lang if i % 3 else None, f"{['web', 'news'][i % 2]}{i % 7}" if i % 10 else None) for i, r in enumerate(docs.orderBy("doc_id").limit(150).collect())]
    df = spark.createDataFrame([(i, t, lang, s, "x", "y") for i, (t, lang, s) in enumerate(own)], "doc_id long, text string, lang string, source string, family string, suffix string")
    suffix = [None, "de", "mx", "com"]
    rows = [(t, lang, suffix[i % 4], (s and s.rstrip("0123456789"), s)) for i, (t, lang, s) in enumerate(own)]
    got = {r.doc_id: r for r in langid.identify_documents(df, ["doc_id"]).collect()}
    for i, (lang, p) in enumerate(judged(rows, langid.fit(df))):
        assert (got[i].lang, got[i].accepted) == (lang, lang != "und") and abs(got[i].posterior - p) < 2e-6


def test_pages_have_priors_of_suffix_domain_and_host(spark, small):
    pages = spark.createDataFrame([(1, "http://www.zeitung.de/a", '<html lang="de"><p>der und die das Haus ist nicht mehr da</p>'), (2, None, None), (3, "no url", "<b></b>"), (4, "http://www.zeitung.de/b", "<script>x</script><p>zu</p>")], "page_id long, url string, html string")
    got = {r.page_id: r for r in langid.identify_pages(pages.withColumn("text", F.lit("z")), spark.read.parquet(f"{small}/documents.parquet")).collect()}
    assert len(got) == 4 and got[2].lang == got[3].lang == "und" and not got[2].accepted and got[1].n_grams > 10
    assert langid.identify_pages(pages.where("page_id < 0"), spark.read.parquet(f"{small}/documents.parquet")).collect() == []


# SQL


@pytest.mark.parametrize("name", list(ORACLES))
def test_sql_gives_the_same_rows(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    cur = con.execute(ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert Counter(tuple(r[c] for c in columns) for r in QUERIES[name](spark, small).collect()) == Counter(cur.fetchall())


# edges


def test_long_urls_and_clashing_columns(spark):
    from strophe.llm import url_filter

    long = "http://" + "a." * 2000 + "com/en/" + "x" * 100_000
    pages = spark.createDataFrame([(1, long), (None, "http://x.org/es/?q")], "page_id long, url string")
    assert {(r.page_id, r.rule, r.verdict) for r in url_filter.judge(pages).collect()} == {(1, "com/en/", "block"), (None, "org/es/", "block")}
    recordings = spark.createDataFrame([(1, b"x" * 3000, 1, "a", b"c"), (5, b"x" * 3000, 2, "b", None)], "k long, pcm binary, node long, s1 string, prints binary")
    assert [(r.query_id, r.match_id, r.query_copies) for r in media.search(recordings, "k", F.col("k") == 5).collect()] == [(1, 1, 2)]


@pytest.mark.parametrize("rows", [EDGE, []])
def test_pipeline_on_edges(spark, tmp_path, rows):
    docs = table(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = common.materialize(stage(spark, kept, str(tmp_path)), name)
        assert kept.columns == docs.columns
    texts = [(r.doc_id, r.text) for r in kept.collect()]
    check_pack(corpus_pipeline.run(spark, str(tmp_path)).collect(), texts)
    assert not Counter(texts) - Counter((r.doc_id, r.text) for r in docs.collect())


def test_scratch_steps_are_deleted(spark, tmp_path):
    from pathlib import Path

    folder = Path(common.shared_dir(spark).removeprefix("file://")) / "strophe"
    with common.scratch(spark) as keep:
        common.materialize(spark.range(3), "gone")
        df = keep(common.materialize(spark.range(5), "stays"))
    assert df.count() == 5 and not list(folder.glob("*/gone-*")) and len(list(folder.glob("*/stays-*"))) == 1


def test_no_step_is_left_after_a_job(spark, tmp_path, small):
    from pathlib import Path

    folder = Path(common.shared_dir(spark).removeprefix("file://")) / "strophe"
    before = set(folder.glob("*/*"))
    with common.scratch(spark):
        corpus_pipeline.run(spark, small).write.parquet(str(tmp_path / "out"))
    assert set(folder.glob("*/*")) <= before and spark.read.parquet(str(tmp_path / "out")).count() > 100


def test_two_threads_keep_their_own_steps(spark, small):
    """An operator in one thread deletes no step of another's."""
    from concurrent.futures import ThreadPoolExecutor

    docs = spark.read.parquet(f"{small}/documents.parquet")

    def job(k):
        with common.scratch(spark):
            return sorted((r.doc_id, r.component_id) for r in near_dedup.grouped(docs, k=k).collect())

    alone = [job(k) for k in (4, 5)]
    with ThreadPoolExecutor(2) as pool:
        assert list(pool.map(job, (4, 5))) == alone


def test_numbers_within_keys(spark):
    """Gapless, whatever the share of a key; the buckets follow each key's own rows."""
    rows = [(0 if i % 3 else i % 50, i) for i in range(6000)]
    df = common.materialize(spark.createDataFrame(rows, "k long, v long"), "rows")
    out = common.numbered(df, "k", ["v"], "at", per_bucket=32)
    assert out.columns == ["k", "v", "at"]
    by = defaultdict(list)
    for r in out.collect():
        by[r.k].append(r.at)
    assert {k: sorted(v) for k, v in by.items()} == {k: list(range(n)) for k, n in Counter(k for k, _ in rows).items()}
    sizes = [f for f in common._rest(spark).written if "/offsets-" in f[1]][-1][0].groupBy("_k").count().collect()
    assert all(r["count"] <= max(1, 2 * len(by[r["_k"]]) / 32) for r in sizes)


def test_large_tables_are_not_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(i, [i] * 10) for i in range(100)], "a long, b array<long>")
    shown = lambda x, e=None: "hint" in common.few(x, e)._jdf.queryExecution().logical().toString().lower()
    assert shown(df, "b")
    monkeypatch.setattr(common, "BROADCAST_BYTES", 100 * common.ROW_BYTES + 500)
    assert shown(df.select("a")) and not shown(df, "b")


def test_crowded_keys_shrink_by_longer_grams(spark):
    """op9: of 60 strings around one 250-byte passage only the two that share 420 bytes are left after a round, not a row for each window."""
    rng = np.random.default_rng(8)
    noise = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8))
    passage, tail = noise(250), noise(170)
    texts = [noise(300) + passage + (tail if i < 2 else noise(170)) + noise(200) for i in range(60)]
    assert suffix_dedup.longer_grams(400, 200) == [300, 350, 375, 400]
    strings = spark.createDataFrame([((1, i), 0, bytearray(t)) for i, t in enumerate(texts)], "_row struct<file:bigint,at:bigint>, first long, string binary")
    for gram in (300, 400):
        pieces = suffix_dedup.rekeyed(strings, 400, gram)
        assert pieces.agg(F.sum("windows")).first()[0] == sum(len(t) - 399 for t in texts)
        whole, rest = suffix_dedup.sorted_out(pieces, 400, ("string",))
        covered = {(r._row.at, r.a, r.b) for r in whole.collect()} | {(r._row.at, r.first, r.first + len(r.string)) for r in rest.collect()}
        assert {at for at, _, _ in covered} == {0, 1} and len(covered) <= 42


def test_matches_have_places_with_neighbours():
    """op2: of any places that are as many as a match's votes, so many have another one or two further on."""
    rng = np.random.default_rng(9)
    for n in range(1, 40):
        need, near = media.enough(n)
        votes = -(-n // 2)
        assert near or need == votes
        for trial in range(200):
            s = {(2 * i + trial) % n for i in range(votes)} if trial < 2 else set(rng.choice(n, votes, replace=False).tolist())
            assert len(s) < votes or not near or sum(any(i + d in s for d in (-2, -1, 1, 2)) for i in s) >= need


def test_links_are_the_matches_of_a_search(spark):
    """op2: one row a document, with as many links as the pairs between classes say."""
    rng = np.random.default_rng(10)
    base = rng.integers(0, 256, 3000, dtype=np.uint8)
    rows = [(k, bytes(np.concatenate((base[: 2000 + 64 * k], rng.integers(0, 256, 200, dtype=np.uint8))))) for k in range(12)]
    rows += [(20, rows[3][1]), (21, bytes(rng.integers(0, 256, 3000, dtype=np.uint8))), (22, None), (23, b""), (24, b"short"), (25, b"short")]
    df = spark.createDataFrame(rows, "k long, pcm binary")
    asks = F.col("k") % 5 == 0
    pairs = {(r.query_id, r.match_id): r.match_copies for r in media.search(df, "k", asks).collect() if r.query_id != r.match_id}
    got = {r.k: r for r in media.linked(df, "k", asks).collect()}
    assert sorted(got) == sorted(k for k, _ in rows) and len(pairs) > 10
    both = {p for a, b in pairs for p in ((a, b), (b, a))}
    for k, r in got.items():
        assert r.class_id == {20: 3, 22: None, 23: None, 25: 24}.get(k, k) and r.copies == (2 if k in (3, 20, 24, 25) else 1)
        assert r.links == sum(a == r.class_id for a, _ in both) and (r.links == 0) == (r.closest_id is None)
        assert r.closest_id is None or (r.class_id, r.closest_id) in both


def test_all_integers_are_counted(spark):
    """op2: what tells rare integers from common ones are all classes, also beyond two million integers."""
    rng = np.random.default_rng(13)
    prints = [rng.integers(0, 1 << 32, 500_000, dtype=np.uint32) for _ in range(5)] + [np.zeros(0, np.uint32)]
    classes = spark.createDataFrame([(s1, len(p), p.tobytes()) for s1, p in enumerate(prints)], "s1 long, n long, prints binary")
    want = np.bincount(media.rank_of(np.concatenate(prints)), minlength=media.RANKS)
    assert want.sum() == 2_500_000 and np.array_equal(media.commonness(classes), want)


def test_recordings_that_repeat_a_sound_are_met_once(spark, monkeypatch):
    """op2: pairs of recordings that repeat one sound are met about once, not at each of its integers, and no match is left out."""
    rng = np.random.default_rng(11)
    noise = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8))
    rows = [(k, noise(int(rng.integers(50, 200))) + b"Is onhe. " * int(rng.integers(200, 300))) for k in range(60)] + [(k, noise(2000)) for k in range(60, 70)]
    _, classes, pairs = media.aligned(spark.createDataFrame(rows, "k long, pcm binary"), "k", F.col("k") % 5 == 0)
    prints = {r.node: (r.asks, np.frombuffer(r.prints, np.uint32)) for r in classes.collect()}
    want = set()
    for a, (asks, x) in prints.items():
        for b, (_, y) in prints.items():
            _, votes, _, errors = media.align(x, y) if asks and a != b else (0, 0, 0, 1.0)
            if votes >= media.VOTES * min(len(x), len(y)) and errors <= media.ERRORS:
                want.add((a, b))
    assert len(want) > 500 and {(r.a, r.b) for r in pairs.collect()} == want
    rows_met = {}
    for often in (10**9, 4):
        monkeypatch.setattr(media, "OFTEN", often)
        monkeypatch.setattr(media, "TIMES", 0)
        met = media.meetings(media.postings(classes, media.commonness(classes)))
        rows_met[often] = met.count()
        got = [(r.a, r.b) for r in media.candidates(classes).collect()]
        assert len(got) == len(set(got)) and want <= set(got)
    assert rows_met[4] < 1.5 * len(want) and rows_met[10**9] > 5 * len(want)
