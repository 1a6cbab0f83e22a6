"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from strophe.llm import exact_dedup, langid, media, mixing, near_dedup, packing, rans, sharding, suffix_dedup, url_filter
from strophe.llm.queries import ORACLES, QUERIES
from strophe.llm.shingles import sets
from strophe.llm.tokens import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, name string, key long, rank int, class int, block int"
LONG = " ".join(f"wort{i % 977} und{i % 13}" for i in range(30_000))
EDGE = [
    (1, None), (2, ""), (3, " \t\n"), (4, "A b\tc"), (5, "ab c"), (5, "ab c"), (None, "abc"), (6, "  a\n\nb  c   "), (7, LONG), (8, LONG + " "), (9, "éß中 x " * 90), (10, "x" * 401), (11, "the cat sat on the mat and the dog sat on the log"),
]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", None if i == 3 else f"s{(i or 0) % 2}", None, "r", "n", 1, 2, 3, 4) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def edge(spark):
    return table(spark, EDGE).cache()


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


def ids_of(name, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(name))
    return [[*t.encode(x or "", add_special_tokens=False).ids, 0] for x in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def tally(rows):
    return Counter(tuple(r) for r in rows)


# op1


def one_by_one(weights, full):
    """Slot by slot, by the definition: of the blocks that may run the one with the earliest deadline, then the first source."""
    whole, ran, out = sum(map(Fraction, weights)), [0] * len(weights), []
    w = [Fraction(x) / whole for x in weights]
    while True:
        may = [i for i in range(len(w)) if w[i] and math.floor(ran[i] / w[i]) <= len(out)]
        i = min(may, key=lambda i: (math.ceil((ran[i] + 1) / w[i]), i), default=None)
        if i is None or ran[i] == full[i]:
            return out
        ran[i] += 1
        out.append(i)


def check_mix(rows, n, weights=None):
    """Windows, and less than one block off the weights (those asked for, if given) at each slot."""
    assert len(rows) == n and len({r.position for r in rows}) == n
    slots = {r.slot: r for r in rows}
    whole = sum(map(Fraction, weights.values())) if weights else 1
    share = {k: Fraction(w) / whole for k, w in weights.items()} if weights else {r.source: r.weight for r in rows}
    until, count = 1 + max((r.slot for r in rows if r.on_target), default=-1), Counter()
    for s in range(until):
        r = slots[s]
        assert r.release <= s < r.deadline
        count[r.source] += 1
        assert all(abs(count[k] - w * (s + 1)) < 1 for k, w in share.items())
    return until


def test_mixing_stays_within_a_block(spark, docs, edge, none):
    assert check_mix(mixing.mix(docs, block_rows=2).collect(), 200) > 50
    assert check_mix(mixing.mix(docs, {f"src{i}": 1 + i for i in range(20)}, block_rows=1).collect(), 200, {f"src{i}": 1 + i for i in range(20)}) > 20
    check_mix(mixing.mix(edge, block_rows=2).collect(), len(EDGE))
    assert mixing.mix(none).collect() == []
    listed = mixing.mix(docs, {"src0": 3.0, "src1": 1.0, "src2": 0}, block_rows=1).collect()
    assert len(listed) == 200 and {r.release for r in listed if r.source == "src2"} == {None}
    assert max(r.slot for r in listed if r.source != "src2") < min(r.slot for r in listed if r.source == "src2")


def test_one_source_with_most_rows(spark):
    df = spark.createDataFrame([(i, str(i), "hot" if i % 3 else f"s{i % 7}") for i in range(3000)], "doc_id long, text string, source string")
    rows = mixing.mix(df, block_rows=4).collect()
    check_mix(rows, 3000)
    again = mixing.mix(df.repartition(7, "text"), block_rows=4).collect()
    assert sorted((r.position, r.doc_id) for r in rows) == sorted((r.position, r.doc_id) for r in again)


def test_each_of_many_sources_has_its_own_weight(spark):
    df = spark.createDataFrame([(i, str(i), f"s{i % 400}" if i < 3600 else None) for i in range(4000)], "doc_id long, text string, source string")
    rows = mixing.mix(df, block_rows=2).collect()
    assert check_mix(rows, 4000) > 400
    weight = {r.source: r.weight for r in rows}
    assert len(weight) == 401 and weight[None] > weight["s1"]


def test_weights_are_exact():
    assert mixing.integers([0.5, 0.25, Fraction(1, 3), 2]) == [6, 3, 4, 24] and mixing.integers([0, 0.0]) == [0, 0] and mixing.integers([]) == []
    a, b = mixing.integers([1 / 3, 2 / 3])
    assert Fraction(a, b) == Fraction(1 / 3) / Fraction(2 / 3)


@pytest.mark.parametrize("seed", range(12))
def test_schedule_equals_earliest_deadline_slot_by_slot(seed):
    rng = np.random.default_rng(seed)
    weights = [float(x) for x in rng.random(int(rng.integers(1, 9))) ** 3] + [0.0] * (seed % 2)
    full = rng.integers(20, 90, len(weights)).tolist()
    assert list(mixing.schedule(mixing.integers(weights), full)) == one_by_one(weights, full)


def test_mixture_keeps_to_the_given_weights(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"), F.when(F.col("id") < 5400, "a").otherwise("b").alias("source"))
    for weights in ({"a": 0.9, "b": 0.1}, {"a": 2**0.5, "b": 0.1}, {"a": 100_000, "b": 11_113}):
        assert check_mix(mixing.mix(df, weights, block_rows=1).collect(), 6000, weights) > 5000
    thirds = df.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "a").otherwise("b"))
    assert check_mix(mixing.mix(thirds, {"a": 1 / 3, "b": 2 / 3}, block_rows=1).collect(), 6000, {"a": 1 / 3, "b": 2 / 3}) > 5990


def test_schedule_is_written_in_pieces(spark):
    parts, sizes = mixing.integers([5, 3, 1, 0]), [100, 333, 70, 9]
    whole = list(mixing.places(parts, sizes, 2))
    got = mixing.written(spark, mixing.places(parts, sizes, 2), piece=17).collect()
    assert sorted(map(tuple, got)) == sorted(whole) and [r[4] for r in whole] == list(range(len(whole)))


def test_blocks_of_a_hundred_million_rows_stay_within_one(spark):
    """The schedule alone: 3 million blocks of 32 rows, in pieces, each source within one block of its weight at each slot."""
    weights, sizes = [0.5, 0.3, 0.15, 0.05], [50_000_000, 30_000_000, 15_000_000, 5_000_000]
    ran, n, parts = [0] * 4, 0, mixing.integers(weights)
    share = [p / sum(parts) for p in parts]
    for i, k, _, _, slot, on_target in mixing.places(parts, sizes, mixing.BLOCK_ROWS):
        assert k == ran[i] and slot == n
        ran[i] += 1
        n += 1
        assert not on_target or abs(ran[i] - share[i] * n) < 1 + 1e-6
    assert n == sum(-(-s // mixing.BLOCK_ROWS) for s in sizes)


def test_interleaved_rows_are_in_order(spark, docs):
    placed = {r.doc_id: r.position for r in mixing.mix(docs).collect()}
    out = mixing.interleaved(docs)
    assert out.columns == docs.columns
    order = [placed[r.doc_id] for r in out.select("doc_id").collect()]
    assert order == sorted(order) and len(order) == 200


# op3


def test_token_files_give_back_all_ids(spark, edge, none, tmp_path):
    rans.write_tokens(edge, str(tmp_path / "a"))
    got = rans.read_tokens(spark, str(tmp_path / "a")).collect()
    rows = sorted(EDGE, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode())))
    want, at = Counter(), 0
    for (doc, _), ids in zip(rows, ids_of("byte_bpe_50k.json", [t for _, t in rows]), strict=True):
        want[(doc, at, len(ids), crc(ids))] += 1
        at += len(ids)
    assert Counter((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == want
    rans.write_tokens(none, str(tmp_path / "b"))
    assert rans.read_tokens(spark, str(tmp_path / "b")).collect() == []


# op4


def test_rules_by_array_and_by_join(spark):
    urls = [None, "", "no scheme", "http://", "https://Sub.EXAMPLE.com/en/7x?a", "http://example.com/en/8", "http://example.com#/en/7", "http://notexample.net/de/8", "http://a.example.net/de/81", "http://b.example.net/de/7", "ftp://x.org/es/", "http://org/es/q", "http://x.org/ES/", "http://a..com/en/", "x://y?://example.com/en/7"]
    pages = spark.createDataFrame(list(enumerate([*urls, urls[4]])), "page_id long, url string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages).collect()}
    assert got == {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, max_bytes=0).collect()}
    table = spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string").withColumn("_row", F.lit(1))
    clashing = pages.withColumns({"_row": F.lit("x"), "rule": F.lit("y"), "host": F.lit("z"), "_id": F.lit(0), "verdict": F.lit(1)})
    for limit in (url_filter.MAX_BYTES, 0):
        assert got == {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(clashing, table, max_bytes=limit).collect()}
    by = {r[0]: r[1:] for r in got}
    assert by[0] == by[2] == ("", "", None, "allow") and by[4] == by[15] == ("sub.example.com", "/en/7x", "example.com/en/7", "allow")
    assert by[5][2:] == ("com/en/", "block") and by[6] == ("example.com", "", None, "allow") and by[8][2:] == ("example.net/de/8", "block") and by[9][2:] == ("net/de/", "allow")
    assert by[7][2:] == ("net/de/", "allow") and by[11][2:] == ("org/es/", "block") and by[12][2] is None and by[14][0] == "y"
    assert url_filter.judge(pages.where("page_id < 0")).collect() == []


def test_digests_that_collide_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda s: len(s))
    rules = [("block", "ab", "/"), ("allow", "cd", "/"), ("block", "efg", "/x")]
    url_filter.DigestArray.write(rules, str(tmp_path), "r")
    array = url_filter.DigestArray(str(tmp_path), "r")
    found = array.find([b"ab/", b"cd/", b"zz/", b"efg/x", b"q"])
    assert [bool(array.verdicts[k]) if k >= 0 else None for k in found] == [False, True, None, False, None]


# op5


def check_shards(rows, n, shards=8):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert sum(map(len, by.values())) == n and all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1


def test_shards_are_even_and_gapless(spark, docs, edge, none, texts):
    rows = sharding.shard(docs).collect()
    check_shards(rows, 200)
    assert all((r.size, r.text_crc32, r.law) == (len(texts[r.doc_id].encode()) + 1, zlib.crc32(texts[r.doc_id].encode()), "rows") for r in rows)
    check_shards(sharding.shard(edge).collect(), len(EDGE))
    assert sharding.shard(none).collect() == []
    same = spark.createDataFrame([(None, "x")] * 60 + [(7, "y")] * 40, "doc_id long, text string")
    check_shards(sharding.shard(same).collect(), 100)


def test_a_further_shard_moves_few_rows(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    before = {r.doc_id: r.shard for r in sharding.shard(df, 8).collect()}
    after = {r.doc_id: r.shard for r in sharding.shard(df, 9).collect()}
    moved = sum(before[k] != after[k] for k in before) / len(before)
    assert moved < 0.45  # 1/9 must move, 8/9 would if keys were dealt anew


# op6


def components_of(shingled, percent=80):
    parent = list(range(len(shingled)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(shingled):
        for j in range(i):
            b = shingled[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(shingled))]


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def check_near(rows, docs, k):
    """docs: (doc_id, text) with distinct ids."""
    docs = sorted(docs)
    s = [shingles(t, k) for _, t in docs]
    want = {docs[i][0]: (len(s[i]), docs[c][0]) for i, c in enumerate(components_of(s))}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert Counter(r.component_id for r in rows if r.stays) == Counter(c for _, c in set(want.values()) for _ in [0]) or {r.doc_id for r in rows if r.stays} == {c for _, c in want.values()}


def test_components_equal_brute_force(spark, docs, texts):
    check_near(near_dedup.grouped(docs, k=4).collect(), list(texts.items()), 4)


def test_a_family_of_near_copies(spark):
    rng = np.random.default_rng(5)
    base = [f"w{rng.integers(0, 5000)}" for _ in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 90):  # some reach the similarity with the base, some with others alone, some with none
        words = list(base) if i % 3 else rows[max(1, i - 3)][1].split()
        for j in rng.choice(len(words), int(rng.integers(1, 7)), replace=False):
            words[j] = f"v{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_near(near_dedup.grouped(df, k=4).collect(), rows, 4)


def test_families_below_the_limit_with_links_inside(spark):
    """Texts that share a template, most of them 0.75 alike, with a few pairs of them at 0.8 and above."""
    rng = np.random.default_rng(5)
    own = lambda n: [f"w{rng.integers(10**9)}" for _ in range(n)]
    template, rows = own(150), []
    for i in range(60):
        words = template + own(22 + i % 3)
        rows.append((2 * i, " ".join(words)))
        if i % 5 == 0:
            rows.append((2 * i + 1, " ".join(words[: -(1 + i % 7)] + own(2))))
    found = near_dedup.grouped(table(spark, rows), k=4).collect()
    check_near(found, rows, 4)
    assert len({r.component_id for r in found}) == 60


def thue_morse(letters, n=1024):
    out = letters[0]
    while len(out) < n:
        out += out.translate(str.maketrans(letters, letters[::-1]))
    return out


def test_words_made_to_collide_are_told_apart(spark):
    """Texts whose sums of letters times powers of any odd base agree modulo 2**64."""
    a, b = thue_morse("ab"), thue_morse("ba")
    rows = [(1, f"{a} x y z"), (2, f"{b} x y z"), (3, f"{a} x y z"), (4, a), (5, b)]
    assert [r.component_id for r in near_dedup.grouped(table(spark, rows), k=4).orderBy("doc_id").collect()] == [1, 2, 1, 4, 5]
    check_repeats(suffix_dedup.removed(table(spark, rows)).collect(), [(d, t.encode()) for d, t in rows], 400)


INVERTED = ("mornings nineteen we left", "hosaolpf 2=l(z092 we left")


def colliding_words(key):
    """Two words of eight letters with one hash under a known key: a chain of births on the form's sums."""
    from strophe.llm import shingles as m

    f, rng, found = m.factors(key, "words", 2 + m.LONGEST // 4), np.random.default_rng(5), {}
    assert f.shape[0] == 2
    # x = first half, y = second half of a word: f x + g y over all pairs of halves; half of the hash is matched by search.
    x, y = (rng.integers(97, 123, (1 << 17, 4)).astype(np.uint8) for _ in range(2))
    data = np.concatenate((np.concatenate((x, y), 1).reshape(-1), np.zeros(8, np.uint8)))
    at = np.arange(len(x)) * 8
    half = m.word_hashes(data[:-8], at, at + 8, key) >> np.uint64(32)
    for i, h in enumerate(half.tolist()):
        if h in found and (data[at[i] : at[i] + 8] != data[found[h] : found[h] + 8]).any():
            return bytes(data[found[h] : found[h] + 8]).decode(), bytes(data[at[i] : at[i] + 8]).decode()
        found[h] = at[i]
    raise AssertionError


def test_texts_written_to_share_a_hash_are_apart(spark, monkeypatch):
    from strophe.llm import shingles as m

    rows = [(1, INVERTED[0]), (2, INVERTED[1]), (3, INVERTED[0])]
    assert [r.component_id for r in near_dedup.grouped(table(spark, rows), k=4).orderBy("doc_id").collect()] == [1, 2, 1]
    key = bytes(range(32))
    a, b = colliding_words(key)
    top = lambda w, k: int(m.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([8]), k)[0]) >> 32
    assert a != b and top(a, key) == top(b, key)  # half of the hash agrees under this key, and under no other
    assert all(top(a, k) != top(b, k) for k in (near_dedup.secret() for _ in range(20)))
    rows = [(1, f"{a} we have left"), (2, f"{b} we have left")]
    assert [r.component_id for r in near_dedup.grouped(table(spark, rows), k=4).orderBy("doc_id").collect()] == [1, 2]


def test_shingles_do_not_depend_on_what_is_beside_them():
    import pyarrow as pa

    key, rng = near_dedup.secret(), np.random.default_rng(2)
    texts = [" ".join("".join(rng.choice(list("abé-"), int(rng.integers(1, 300)))) for _ in range(int(rng.integers(0, 9)))) for _ in range(60)]
    together = [s.tolist() for s in sets(pa.array(texts), 3, key)]
    assert together == [next(sets(pa.array([t]), 3, key)).tolist() for t in texts]
    assert together != [s.tolist() for s in sets(pa.array(texts), 3, near_dedup.secret())]
    words = [t for t in {w for t in texts for w in t.split()}]
    assert len({int(next(sets(pa.array([w]), 3, key))[0]) for w in words}) == len(words)


def test_near_edges(spark, edge, none):
    rows = near_dedup.grouped(edge, k=5).collect()
    assert len(rows) == len(EDGE)
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert all(by[i][0].n_shingles == 0 and by[i][0].stays and by[i][0].component_id == i for i in (1, 2, 3))
    assert [r.stays for r in sorted(by[5], key=lambda r: r.stays)] == [False, True] and by[8][0].component_id == 7
    assert by[6][0].component_id == 4
    assert near_dedup.grouped(none).collect() == []


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000, np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[200:2200])
    regs = near_dedup.sketches([a, b, np.union1d(a, b), a[:1], np.zeros(0, np.uint64)])
    assert (np.maximum(regs[0], regs[1]) == regs[2]).all() and (regs[4] == 0).all() and (regs[3] > 0).all()
    found = near_dedup.similarity(regs[:1], regs[1:2], np.array([len(a)]), np.array([len(b)]))[0]
    assert abs(found - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.12


def test_shingle_sets_count_distinct_ones():
    import pyarrow as pa

    texts = ["a b c a b c a b", "A\tB\x0bC d", "a", None, "", "É é x y", "a  b", "b a"]
    assert [len(s) for s in sets(pa.array(texts), 3, bytes(32))] == [len(shingles(t, 3)) for t in texts]
    one, two = list(sets(pa.array(["a b", "b a"]), 3, bytes(32)))
    assert one[0] != two[0]


# op7


def check_pack(rows, texts, size=2048):
    ids = ids_of("word_bpe_49k.json", [t for _, t in texts])
    want = Counter((d, k, a, len(x[a : a + size]), crc(x[a : a + size])) for (d, _), x in zip(texts, ids, strict=True) for k, a in enumerate(range(0, len(x), size)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for v in by.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= size
    return len(by), -(-sum(map(len, ids)) // size)


def test_packing_is_whole_and_tight(spark, docs, texts, edge, none):
    used, least = check_pack(packing.pack(docs).collect(), list(texts.items()))
    assert used <= least + 1
    check_pack(packing.pack(edge).collect(), EDGE)
    assert packing.pack(none).collect() == []


def best_fit(lengths, size):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        room = min(fits, default=size)
        if fits:
            rooms.remove(room)
        rooms.append(room - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(20))
def test_plan_equals_best_fit_one_by_one(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.integers(5, 60))
    lengths = rng.integers(1, size + 1, int(rng.integers(1, 400))).tolist()
    counts, used = Counter(lengths), {}
    for length, rank, n, each, first, at in packing.plan(dict(counts), size):
        for i in range(n):
            used.setdefault(first + i // each, []).append((at + i % each * length, length))
    for v in used.values():
        end = 0
        for o, n in sorted(v):
            assert o == end
            end += n
        assert end <= size
    assert Counter(n for v in used.values() for _, n in v) == counts and len(used) == best_fit(lengths, size)


# op8


def test_exact_groups(spark, docs, edge, none):
    for df, block in ((docs, 64), (docs, 2048), (edge, 2), (edge, 2048)):
        rows = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
        groups = defaultdict(list)
        for d, t in rows:
            groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), d is None, d or 0, d))
        want = Counter()
        for bare, members in groups.items():
            keep = min(members)[3]
            for m in sorted(members):
                want[(m[3], keep, len(members), hashlib.sha256(bare.encode()).hexdigest())] += 1
        got = exact_dedup.exact_dedup(df, block).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
        assert sum(r.kept for r in got) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup.exact_dedup(none).collect() == []


def test_texts_that_differ_late_or_in_length_alone(spark):
    texts = ["a" * 8, "a" * 9, "a" * 8 + "b", "ab" * 4, "a" * 16, "a" * 17, "b" + "a" * 16]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert all(r.kept and r.group_size == 1 for r in exact_dedup.exact_dedup(df, 4).collect())


@pytest.mark.parametrize("keys", [lambda b: (F.lit(1), F.lit(2)), lambda b: (F.length(b), F.lit(0))])
def test_contents_that_share_a_key_are_told_apart(spark, monkeypatch, docs, keys):
    want = tally(exact_dedup.exact_dedup(docs).drop("_row").collect())
    monkeypatch.setattr(exact_dedup, "keys_of", lambda b: tuple(k.cast("long") for k in keys(b)))
    assert tally(exact_dedup.exact_dedup(docs).drop("_row").collect()) == want


def test_counts_of_long_texts_are_exact(spark):
    n = next(n for n in range(671_089, 671_200) if float(np.float32(100 * n)) < 100 * n)
    same = np.arange(n, dtype=np.uint64).tobytes()
    full = spark.createDataFrame([(1, bytearray(same)), (2, bytearray(same))], "node long, elements binary")
    outside = spark.createDataFrame([(1, 1, 1, False, 2, 1), (1, 2, 2, True, 2, 1)], "head long, node long, component long, out boolean, all long, outside long")
    assert [tuple(sorted(r)) for r in near_dedup.crossed(outside, full, 100).collect()] == [(1, 2)]


# op9


def check_repeats(rows, docs, window):
    seen = Counter(t[p : p + window] for _, t in docs for p in range(len(t) - window + 1))
    want = Counter()
    for d, t in docs:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - window + 1):
            if seen[t[p : p + window]] > 1:
                gone[p : p + window] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate(([0], gone.view(np.int8)))) == 1).sum())
        want[(d, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == want


def passages(seed):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdeé"), int(rng.integers(1, 8))))
    shared = [" ".join(word() for _ in range(int(rng.integers(60, 160)))) for _ in range(4)]
    rows = []
    for i in range(40):
        parts = [" ".join(word() for _ in range(int(rng.integers(0, 120)))) for _ in range(3)]
        rows.append((i, parts[0] + shared[i % 4][int(rng.integers(0, 60)) :] + parts[1] + (shared[(i + 1) % 4] if i % 3 == 0 else "") + parts[2]))
    rows += [(100, "ab" * 700), (101, "x" * 399), (102, "y" * 400), (103, "z" * 401), (104, rows[0][1]), (104, rows[0][1]), (105, None), (106, "abcdefghij" * 45 + "!")]
    return rows


@pytest.mark.parametrize("kinds", [suffix_dedup.KINDS, 2, 1])
def test_repeats_equal_brute_force(spark, monkeypatch, kinds):
    monkeypatch.setattr(suffix_dedup, "KINDS", kinds)
    rows = passages(3)
    df = table(spark, rows)
    check_repeats(suffix_dedup.removed(df).collect(), [(d, (t or "").encode()) for d, t in rows], 400)


def test_repeats_in_an_empty_table_and_in_slices(spark, none, monkeypatch):
    assert suffix_dedup.removed(none).collect() == []
    rows = [(1, "".join(chr(97 + (i * i) % 23) for i in range(3000))), (2, "q" + "".join(chr(97 + (i * i) % 23) for i in range(500, 1500)))]
    monkeypatch.setattr(suffix_dedup, "SLICE", 700)
    check_repeats(suffix_dedup.removed(table(spark, rows)).collect(), [(d, t.encode()) for d, t in rows], 400)


@pytest.mark.parametrize("window", [16, 20, 50])
def test_suffix_arrays_find_repeated_windows(window):
    rng = np.random.default_rng(window)
    strings = [bytes(rng.integers(97, 99, int(rng.integers(0, 80))).astype(np.uint8)) for _ in range(12)]
    seen = Counter(s[p : p + window] for s in strings for p in range(len(s) - window + 1))
    want = [[seen[s[p : p + window]] > 1 for p in range(len(s) - window + 1)] for s in strings]
    assert [f.tolist() for f in suffix_dedup.repeated_windows(strings, window)] == want


# op10


def test_languages_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.where("doc_id < 300"))
    rows = docs.where("doc_id >= 300").select("doc_id", "text", F.lit(None).cast("string").alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col("source").alias("host"))
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = langid.identify(rows, model, ["host"], ["doc_id"]).collect()
    assert sum(r.lang == truth[r.doc_id] for r in got) / len(got) > 0.97 and sum(r.accepted for r in got) / len(got) > 0.99


def test_evidence_decides_where_the_text_is_short(spark, docs):
    rows = [(1, "e", "de", "de", "x.de"), (2, "e", "fr", None, "y.fr"), (3, None, "fr", "fr", "y.fr"), (4, "12 34", "en", None, "z"), (5, "zqxj kvwq xzzq jqqx wkkv qqzx zzzq xjxj vkqz " * 9, "en", None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, declared string, suffix string, host string")
    got = {r.doc_id: r for r in langid.identify(df, langid.fit(docs), ["suffix", "host"], ["doc_id"]).collect()}
    assert (got[1].lang, got[2].lang) == ("de", "fr") and not any(got[i].accepted for i in (3, 4, 5)) and got[3].lang == "und"


def test_rare_and_absent_languages(spark, docs):
    rows = [(i, f"the cat sat on the mat and the dog {i} was there with them", "en") for i in range(300)] + [(999, "der hund und die katze sind nicht in dem garten " * 3, "de")]
    rare = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=8)
    assert np.ptp(rare[langid.LANGUAGES.index("de")]) > 0  # its only row counts
    junk = "zqxj kvwq xzzq jqqx wkkv qqzx zzzq xjxj vkqz " * 9
    asked = spark.createDataFrame([(1, junk, None, None, "a"), (2, junk, "fr", None, "a"), (3, rows[0][1], None, None, "a")], "doc_id long, text string, declared string, suffix string, host string")
    got = {r.doc_id: (r.lang, r.accepted) for r in langid.identify(asked, langid.fit(docs.where("lang = 'en'")), ["host"], ["doc_id"]).collect()}
    assert got == {1: ("und", False), 2: ("und", False), 3: ("en", True)}


def test_language_edges(spark, edge, none, docs):
    assert len(langid.identify_documents(edge, ["doc_id"]).collect()) == len(EDGE)
    assert langid.identify_documents(none, ["doc_id"]).collect() == []


def test_trigram_sums_do_not_depend_on_slices(monkeypatch):
    import pyarrow as pa

    texts = pa.array(["abc def", None, "", "x", "Grüße aus dem Süden " * 30, "y" * 50])
    count = np.ones(langid.GRAMS)
    whole = langid.sums(*langid.spans(texts), [count, np.arange(langid.GRAMS, dtype=float)])
    monkeypatch.setattr(langid, "SLICE", 17)
    assert np.allclose(whole, langid.sums(*langid.spans(texts), [count, np.arange(langid.GRAMS, dtype=float)]))


# all


@pytest.mark.parametrize("stage", [langid.accepted, exact_dedup.deduplicated, near_dedup.deduplicated, mixing.interleaved])
def test_stages_keep_columns_and_values(edge, none, stage):
    out = stage(edge)
    assert out.columns == edge.columns
    rows, given = tally(out.collect()), tally(edge.collect())
    # The only language with labelled rows is fitted on the long texts: short ones are in none.
    assert rows <= given and sum(rows.values()) == {langid.accepted: 4, exact_dedup.deduplicated: 7, near_dedup.deduplicated: 10, mixing.interleaved: 13}[stage]
    assert stage(none).collect() == [] and stage(none).columns == edge.columns


def test_queries_run_on_whole_tables(spark, small):
    for name in ORACLES:
        assert name in QUERIES
    n = spark.read.parquet(f"{small}/documents.parquet").count()
    for name in ("op1_pfair_mixing", "op5_bounded_ring", "op8_exact_dedup", "op10_language_fusion"):
        assert QUERIES[name](spark, small).count() == n
    assert QUERIES["pages_language_fusion"](spark, small).count() == QUERIES["op4_digest_array"](spark, small).count()


# op2


def tune(seed, seconds=2.0):
    rng = np.random.default_rng(seed)
    t = np.arange(int(seconds * media.RATE)) / media.RATE
    notes = rng.integers(0, 24, int(seconds * 8) + 1)
    x = np.sin(2 * np.pi * 220 * 2 ** (notes[(t * 8).astype(int)] / 12) * t)
    return x + 0.3 * np.sin(2 * np.pi * 110 * 2 ** (notes[(t * 4).astype(int)] / 12) * t)


def pcm(x):
    return np.clip(np.round(x / 1.5 * 127 + 128), 0, 255).astype(np.uint8).tobytes()


def test_recordings_align_at_their_offset():
    a = tune(1)
    rng = np.random.default_rng(0)
    later = a[40 * media.HOP :] + rng.normal(0, 0.004, len(a) - 40 * media.HOP)
    off, votes, n, errors = media.align(media.fingerprint(a), media.fingerprint(later))
    assert off == 40 and errors < 0.05 and votes > n / 2
    assert media.align(media.fingerprint(a), media.fingerprint(tune(2)))[3] > 0.2


def test_integral_image_filters_equal_sums_of_boxes(monkeypatch):
    monkeypatch.setattr(media, "FILTERS", [(0, 2, 4, 8)])
    monkeypatch.setattr(media, "LEVELS", (0.0,))
    x = tune(5, 0.5)
    image = media.chroma(x)
    want = [int(np.log((image[i : i + 4, 2:6].sum() + 1e-3) / (image[i + 4 : i + 8, 2:6].sum() + 1e-3)) > 0) for i in range(len(image) - 15)]
    assert [int(v) for v in media.fingerprint(x)] == [w ^ (w >> 1) for w in want]


def test_search_finds_what_brute_force_does(spark, docs, none):
    rows = [(i, pcm(tune(i % 30, 1.5)[(i // 30) * 640 :] * (1 - 0.02 * (i // 30)))) for i in range(120)] + [(200, None), (201, b""), (202, b"short"), (203, pcm(tune(0, 1.5)))]
    df = spark.createDataFrame(rows, "k long, pcm binary")
    got = {(r.query_id, r.match_id): r for r in media.search(df, "k", F.col("k") % 5 == 0).collect()}
    prints = {i: media.fingerprint((np.frombuffer(p or b"", np.uint8).astype(np.float32) - 128) / 128) for i, p in rows}
    want = set()
    for q in (i for i in prints if i % 5 == 0 and len(prints[i]) and i < 200):
        for d in (i for i in prints if i != q and i < 200 and len(prints[i])):
            _, votes, _, errors = media.align(prints[q], prints[d])
            if votes >= media.VOTES * min(len(prints[q]), len(prints[d])) and errors <= media.ERRORS:
                want.add((q, d))
    assert len(want) > 20 and {k for k in got if k[0] != k[1]} <= want and len(want & set(got)) / len(want) >= 0.9
    assert (0, 0) in got and got[(0, 0)].query_copies == 2
    assert media.search(none.select("doc_id", F.col("text").cast("binary").alias("pcm")), "doc_id", F.lit(True)).collect() == []


def test_search_finds_clips_in_recordings_of_any_length(spark):
    rows = []
    for i, ratio in enumerate((1, 2, 5, 10, 20, 40) * 2):
        whole = tune(300 + i, 0.5 * ratio + 0.1)
        begin = media.HOP * (3 * ratio)
        clip = whole[begin : begin + media.RATE // 2] if ratio > 1 else whole[: media.RATE // 2]
        rows += [(10 * i, pcm(clip if i % 2 else whole)), (10 * i + 1, pcm(whole if i % 2 else clip))]
    prints = {k: media.fingerprint((np.frombuffer(p, np.uint8).astype(np.float32) - 128) / 128) for k, p in rows}
    want = set()
    for q in (k for k in prints if k % 10 == 0):
        for d in (k for k in prints if k != q):
            _, votes, _, errors = media.align(prints[q], prints[d])
            if votes >= media.VOTES * min(len(prints[q]), len(prints[d])) and errors <= media.ERRORS:
                want.add((q, d))
    assert {(10 * i, 10 * i + 1) for i in range(12)} <= want
    got = media.search(spark.createDataFrame(rows, "k long, pcm binary"), "k", F.col("k") % 10 == 0).collect()
    assert {(r.query_id, r.match_id) for r in got} == want


def test_short_recordings_match_their_copies(spark):
    rows = [(0, b"short"), (1, b"short"), (2, b"shore"), (10, b"x" * 1215), (11, b"x" * 1215), (12, b"x" * 1216), (20, b"alone"), (30, None), (40, b"")]
    df = spark.createDataFrame(rows, "k long, pcm binary")
    got = {(r.query_id, r.match_id, r.query_copies) for r in media.search(df, "k", F.col("k") % 10 == 0).collect()}
    assert got == {(0, 0, 2), (10, 10, 2)}
    told = {(r.query_id, r.match_id, r.query_copies) for r in media.search(df, "k", F.col("k") % 10 == 0, report=True).collect()}
    assert told - got == {(0, None, 2), (10, None, 2), (20, None, 1), (30, None, 1), (40, None, 1)}


def test_a_match_at_another_offset_than_the_most_voted():
    """A recording with the clip twice: once more of its integers and the rest far off, once fewer and the rest almost right."""
    rng = np.random.default_rng(7)
    clip, noise = rng.integers(0, 2**32, 100, np.uint32), rng.integers(0, 2**32, 50, np.uint32)
    one, two = clip.copy(), clip.copy()
    one[60:] ^= np.uint32(0xFFFFFFFF)
    two[55:] ^= np.uint32(1)
    whole = np.concatenate((noise, one, noise, two, noise))
    off, votes, n, errors = media.align(whole, clip)
    assert (off, votes, n) == (200, 55, 100) and errors <= media.ERRORS
    assert media.align(clip, whole)[:3] == (-200, 55, 100)
    assert media.align(np.concatenate((noise, one)), clip)[:2] == (50, 60)
