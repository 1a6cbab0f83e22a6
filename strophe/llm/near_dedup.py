"""Near-duplicates by SetSketch registers.

Each text's set of word shingles becomes a sketch of ``REGISTERS`` registers: register values are exponentially
spaced (base ``BASE``) and truncated levels of the smallest of one exponential variable for each element, so
sketches merge by a maximum and agree in a register about as often as the sets' Jaccard similarity says.

Equal sets are collapsed first, so thousands of copies are one node. Groups of ``BAND`` registers are hashed to
buckets; pairs of a bucket that can reach the similarity by their sizes are estimated by the likelihood of how many
registers are larger, smaller and equal in one of the two, and what may reach it is confirmed on the full sets.

Only connections count, so no bucket is spread into all its pairs. Up to ``SMALL`` members are paired; in larger
buckets all are compared with the most central member, and those that do not end up in its component with all others
by an exact join on the rarest shingles of the full sets. A pair whose ends are connected already isn't looked at again. Components are found
by rounds of sums and joins.

The chance that two texts at the limit of 0.8 share no bucket is (1 - 0.8**5)**32, about 3 in a million.

Sets hold 64-bit hashes of shingles under a secret drawn for each job, so texts can't be written to collide.

Defined cases: null, empty and blank texts have no shingles, are linked with nothing and stay; a text with fewer
words than a shingle is one shingle; null ids come after all others when the smallest is sought; repeated rows are
copies; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few, materialize, read, released, scratch, small_batches, with_row_id, without_rows
from .components import components
from .shingles import mixed, secret, sets

REGISTERS, BAND = 160, 5
BASE = 1.001
#: Rate of the exponential variables: so high that a single element's hardly ever exceed 1, where levels end.
RATE = 20.0
#: Members of a bucket that are paired with each other.
SMALL = 12
#: Counters of shingles, as a power of two, that put them in order: what they hold decides the cost, never the result.
COUNTERS = 18
#: What an estimate may fall short of the similarity: five standard errors.
MARGIN = 0.16
_TOP = 65535
_STEP = np.uint64(0x9E3779B97F4A7C15)


def sketches(elements: list[np.ndarray], registers: int = REGISTERS) -> np.ndarray:
    """A row of registers for each set of 64-bit hashes.

    An element's exponential variables, one for each register, are the points of one Poisson process dealt to
    registers at random: taken in ascending order, all beyond the largest register's minimum can be left out. The
    process is followed up to a bound that fills all registers of most sets; those it leaves empty get a larger one.
    """
    out = np.zeros((len(elements), registers), np.uint16)
    todo, reach = np.array([i for i, e in enumerate(elements) if len(e)], np.int64), np.log(registers) + 5
    while todo.size:
        sizes = np.array([len(elements[i]) for i in todo])
        bound = reach / sizes
        h = np.concatenate([elements[i] for i in todo])
        doc = np.repeat(np.arange(len(todo)), sizes)
        best = np.full(len(todo) * registers, np.inf)
        at = np.zeros(len(h))
        j = 0
        # The first gap is within the bound when the random number is above a limit: most elements end here.
        limit = np.exp(-np.minimum(bound * registers, 700.0))
        while h.size:
            j += 1
            r = mixed(h + np.uint64(int(_STEP) * j % 2**64))
            u = ((r >> np.uint64(16)).astype(np.float64) + 1.0) * 2.0**-48
            if j == 1:
                some = np.flatnonzero(u >= limit[doc])
                h, doc, at, r, u = h[some], doc[some], at[some], r[some], u[some]
            at = at - np.log(u) / registers
            keep = np.flatnonzero(at <= bound[doc])
            h, doc, at = h[keep], doc[keep], at[keep]
            place = doc * registers + (((r[keep] & np.uint64(0xFFFF)) * np.uint64(registers)) >> np.uint64(16)).astype(np.int64)
            np.minimum.at(best, place, at)
        best = best.reshape(len(todo), registers)
        full = np.isfinite(best).all(1)
        level = np.floor(1.0 - np.log(best[full] / RATE) / np.log(BASE))
        out[todo[full]] = np.clip(level, 0, _TOP).astype(np.uint16)
        todo, reach = todo[~full], reach * 3
    return out


def similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Likeliest Jaccard similarity of pairs of sketches (rows) of sets of known sizes, to a hundredth."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    u = (n_a / (n_a + n_b))[:, None]
    grid = np.linspace(0.0, 1.0, 101)[None, :]
    chance = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)
    p_more, p_less = chance(u - (1 - u) * grid), chance((1 - u) - u * grid)
    same = a.shape[1] - more - less
    fits = more * np.log(p_more) + less * np.log(p_less) + same * np.log(np.maximum(1 - p_more - p_less, 1e-12))
    return grid[0, np.argmax(fits, 1)]


def scan(docs: DataFrame, keep: list[str], k: int, key: bytes) -> DataFrame:
    """keep, n_shingles, the set's digest (s1, s2) and its sketch for each row of docs(text)."""
    told = docs.select(*keep, F.col("text").cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: list[np.ndarray] = []
            n, digests, regs = [], [], []

            def flush() -> None:
                regs.extend(r.tobytes() for r in sketches(held))
                held.clear()

            size = 0
            for s in sets(b["text"], k, key):
                n.append(len(s))
                digests.append(xxhash.xxh3_128_intdigest(s.tobytes()) if len(s) else 0)
                held.append(s)
                size += len(s)
                if size > 1 << 18:
                    flush()
                    size = 0
            flush()
            signed = lambda xs: pa.array(np.array(xs, np.uint64).view(np.int64))
            columns = [pa.array(n, pa.int64()), signed([d >> 64 for d in digests]), signed([d & (2**64 - 1) for d in digests]), pa.array(regs, pa.binary())]
            rest = [x for x in b.schema.names if x != "text"]
            yield pa.RecordBatch.from_arrays([*(b[x] for x in rest), *columns], names=[*rest, "n_shingles", "s1", "s2", "regs"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in told.schema if f.name != "text")
    return told.mapInArrow(released(work), f"{schema}, n_shingles long, s1 long, s2 long, regs binary")


def bands(nodes: DataFrame) -> DataFrame:
    """(key, node, n) for each band of each node's registers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            regs = np.frombuffer(b"".join(b["regs"].to_pylist()), np.uint16).reshape(b.num_rows, -1, BAND)
            key = np.arange(regs.shape[1], dtype=np.uint64)[None, :] * _STEP
            for i in range(BAND):
                key = mixed(key * np.uint64(31) + regs[:, :, i].astype(np.uint64))
            repeat = lambda name: pa.array(np.repeat(b[name].to_numpy(), regs.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), repeat("node"), repeat("n")], names=["key", "node", "n"])

    return nodes.select("node", "n", "regs").mapInArrow(released(work), "key long, node long, n long")


def may_reach(n_a: Column, n_b: Column, percent: int) -> Column:
    return F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent


def estimated(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b, estimate) of the pairs that may reach the similarity."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"r_{x}"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            regs = [np.frombuffer(b"".join(b[x].to_pylist()), np.uint16).reshape(b.num_rows, -1) for x in ("r_a", "r_b")]
            found = similarity(*regs, b["n_a"].to_numpy(), b["n_b"].to_numpy()) if b.num_rows else np.zeros(0)
            keep = np.flatnonzero(found >= percent / 100 - MARGIN)
            yield pa.RecordBatch.from_arrays([b["a"].take(pa.array(keep)), b["b"].take(pa.array(keep)), pa.array(found[keep])], names=["a", "b", "estimate"])

    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").mapInArrow(released(work), "a long, b long, estimate double")


def confirmed(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    side = lambda x: full.select(F.col("node").alias(x), F.col("elements").alias(f"e_{x}"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for i, (x, y) in enumerate(zip(b["e_a"], b["e_b"], strict=True)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    keep.append(i)
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b["a"].take(rows), b["b"].take(rows)], names=["a", "b"])

    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").mapInArrow(released(work), "a long, b long")


def full_sets(docs: DataFrame, wanted: DataFrame, k: int, key: bytes) -> DataFrame:
    """(node, elements) for wanted(node, row): the sets of one text each, from docs(_row, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["node"], pa.array([s.tobytes() for s in sets(b["text"], k, key)], pa.binary())], names=["node", "elements"])

    wanted = few(wanted)
    return docs.join(wanted, docs["_row"] == wanted["row"]).select("node", F.col("text").cast("string").alias("text")).mapInArrow(released(work), "node long, elements binary")


def grouped(docs: DataFrame, k: int = 5, percent: int = 80, key: bytes | None = None) -> DataFrame:
    """For each row of docs(doc_id, text): _row, doc_id, n_shingles, component_id and stays (one row of a component)."""
    return grouped_rows(with_row_id(docs), k, percent, key)


def grouped_rows(docs: DataFrame, k: int = 5, percent: int = 80, key: bytes | None = None) -> DataFrame:
    """The same for rows that have ``_row``. key: the secret that sets are hashed under; a new one by default."""
    key = key or secret()
    with small_batches(docs.sparkSession):
        rows = materialize(scan(docs, ["_row", "doc_id"], k, key), "sketches")
    first = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_row"))
    nodes = rows.where("n_shingles > 0").groupBy("s1", "s2").agg(F.min(first).alias("first"), F.first("n_shingles").alias("n"), F.first("regs").alias("regs"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    with scratch(docs.sparkSession) as keep:
        labels = keep(materialize(linked(docs, nodes, k, percent, key), "labels"))
    of_set = nodes.select("s1", "s2", "node", "first").join(labels, "node", "left").select("s1", "s2", "first", F.coalesce("component", "node").alias("component"))
    least = of_set.groupBy("component").agg(F.min("first").alias("least"))
    least = materialize(least, "components")
    of_set = of_set.join(few(least), "component").select(F.col("s1").alias("_s1"), F.col("s2").alias("_s2"), "least")
    joined = rows.drop("regs").join(of_set, (F.col("s1") == F.col("_s1")) & (F.col("s2") == F.col("_s2")) & (F.col("n_shingles") > 0), "left")
    alone = F.col("n_shingles") == 0
    return joined.select("_row", "doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"), (alone | (F.col("_row") == F.col("least._row"))).alias("stays"))


def families(inside: DataFrame) -> DataFrame:
    """(head, n_head, node, n) of large buckets: the head is the member that meets most nodes in all its buckets.

    Around a text with many variants that is the text itself or one close to it, the same for all of its buckets, so
    each family is compared once and not once a band. Two nodes of one bucket are always in one family.
    """
    large = inside.where(F.col("members") > SMALL)
    met = materialize(large.groupBy(F.col("node").alias("_n")).agg(F.sum("members").alias("met")), "met")
    large = large.join(met, F.col("node") == F.col("_n")).select("key", "node", "n", "met")
    large = materialize(large, "large-buckets")
    heads = large.groupBy(F.col("key").alias("_key")).agg(F.max_by(F.struct("node", "n"), F.struct("met", F.xxhash64("node"))).alias("head"))
    heads = materialize(heads, "heads")
    return large.join(heads, F.col("key") == F.col("_key")).select(F.col("head.node").alias("head"), F.col("head.n").alias("n_head"), "node", "n").distinct()


def outsiders(family: DataFrame, labels: DataFrame) -> DataFrame:
    """(head, node, component, out): families in which not all members are in the head's component; out marks those."""
    of = labels.select(F.col("node").alias("_n"), "component")
    at = family.select("head", "node").join(of, F.col("node") == F.col("_n"), "left").select("head", "node", F.coalesce("component", "node").alias("component"))
    head = labels.select(F.col("node").alias("_h"), F.col("component").alias("_c"))
    at = materialize(at.join(head, F.col("head") == F.col("_h"), "left").select("head", "node", "component", (F.col("component") != F.coalesce("_c", "head")).alias("out")), "families-labelled")
    sizes = at.groupBy(F.col("head").alias("_h")).agg(F.count("*").alias("all"), F.count_if("out").alias("outside")).where("outside > 0")
    sizes = materialize(sizes, "family-sizes")
    return at.join(sizes, F.col("head") == F.col("_h")).drop("_h")


def buckets_of(h: np.ndarray) -> np.ndarray:
    return (mixed(h) >> np.uint64(64 - COUNTERS)).astype(np.int64)


def commonness(full: DataFrame) -> np.ndarray:
    """How many shingles of full(elements) fall into each of 2**COUNTERS counters: tells rare ones from common ones."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(1 << COUNTERS, np.int64)
        for b in batches:
            for x in b["elements"]:
                found += np.bincount(buckets_of(np.frombuffer(x.as_py(), np.uint64)), minlength=len(found))
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(found[some], pa.int64())], names=["at", "n"])

    got = full.select("elements").mapInArrow(released(count), "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # 2**COUNTERS rows at most
    out = np.zeros(1 << COUNTERS, np.int64)
    out[got["at"].to_numpy()] = got["n"].to_numpy()
    return out


def prefixes(sets_of: DataFrame, percent: int) -> DataFrame:
    """(element, place, small, node, component, out, n) for the rarest shingles of sets_of(node, component, out, elements).

    Two sets of n_a <= n_b elements that reach the similarity share percent * (n_a + n_b) / (100 + percent) of them, so
    in one order of all shingles a prefix of the smaller set meets one of the larger. The rows for a set as the smaller
    one (small) need a shorter prefix than those for it as the larger.
    """
    common = commonness(sets_of)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, x in enumerate(b["elements"]):
                e = np.frombuffer(x.as_py(), np.uint64)
                n = len(e)
                e = e[np.lexsort((e, common[buckets_of(e)]))]
                large = n - -(-percent * n // 100) + 1
                few_ = n - -(-2 * percent * n // (100 + percent)) + 1
                place = np.concatenate((np.arange(few_), np.arange(large)))
                rows = pa.array(np.full(len(place), i))
                small = pa.array(np.arange(len(place)) < few_)
                yield pa.RecordBatch.from_arrays([pa.array(e[place].view(np.int64)), pa.array(place), small, *(b[c].take(rows) for c in ("node", "component", "out")), pa.array(np.full(len(place), n))], names=["element", "place", "small", "node", "component", "out", "n"])

    return sets_of.select("node", "component", "out", "elements").mapInArrow(released(work), "element long, place long, small boolean, node long, component long, out boolean, n long")


def crossed(outside: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of different components, one of them outside its family's main one, that may reach the similarity.

    An exact prefix join: families of texts that all fall short of the similarity have their own shingles in the
    prefixes and make no pairs. A pair is made where the places leave enough shingles to share.
    """
    some = outside.groupBy("node").agg(F.first("component").alias("component"), F.max("out").alias("out"))
    held = full.join(some.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n")).drop("_n")
    rows = materialize(prefixes(materialize(held, "outside-sets"), percent), "prefixes")
    side = lambda x, small: rows.where(F.col("small") == small).select("element", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "component", "out", "n", "place")))
    met = side("a", True).join(side("b", False), "element").where("(n_a < n_b OR n_a = n_b AND node_a < node_b) AND component_a <> component_b AND (out_a OR out_b)")
    rest = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    met = met.where((F.col("n_a") * 100 >= F.col("n_b") * percent) & (rest * (100 + percent) >= percent * (F.col("n_a") + F.col("n_b"))))
    return met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def linked(docs: DataFrame, nodes: DataFrame, k: int, percent: int, key: bytes) -> DataFrame:
    """(node, component) of the nodes that have a link."""
    keys = bands(nodes)
    buckets = materialize(keys.groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("members")).where("members > 1"), "bucket-sizes")
    inside = materialize(keys.join(buckets, F.col("key") == F.col("_key")).select("key", "node", "n", "members"), "buckets")
    small = inside.where(F.col("members") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("node", "n"))).alias("m"))
    small = small.select(F.explode("m").alias("x"), "m").select("x", F.explode("m").alias("y")).where("x.node < y.node").select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.n").alias("n_a"), F.col("y.n").alias("n_b"))
    family = materialize(families(inside), "families")
    large = family.where(F.col("node") != F.col("head")).select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b"), F.col("n").alias("n_a"), F.col("n_head").alias("n_b"))
    pairs = small.unionAll(large).where(may_reach(F.col("n_a"), F.col("n_b"), percent)).select("a", "b").distinct()
    likely = materialize(estimated(pairs, nodes, percent), "likely")

    # The best partner of each node first: most of the other pairs are connected by then.
    ends = likely.select(F.col("a").alias("node"), "a", "b", "estimate").unionAll(likely.select(F.col("b").alias("node"), "a", "b", "estimate"))
    best = ends.groupBy("node").agg(F.max_by(F.struct("a", "b"), F.struct("estimate", F.xxhash64("a", "b"))).alias("p")).select("p.a", "p.b").distinct()
    wanted = ends.select("node").unionAll(family.select("node")).distinct().join(nodes.select("node", F.col("first._row").alias("row")), "node")
    full = materialize(full_sets(docs, wanted, k, key), "full-sets")
    links = materialize(confirmed(best, full, percent), "links-1")
    labels = components(links)

    def apart(of: DataFrame, labels: DataFrame) -> DataFrame:
        """The pairs whose ends are not connected."""
        side = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
        return of.select("a", "b").join(side("a"), "a", "left").join(side("b"), "b", "left").where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")

    more = materialize(confirmed(apart(likely, labels), full, percent), "links-2")
    if not more.isEmpty():
        links = links.unionAll(more)
        labels = components(links)
    outside = outsiders(family, labels)
    pairs = materialize(crossed(outside, full, percent), "crossed")
    last = materialize(confirmed(pairs, full, percent), "links-3")
    return labels if last.isEmpty() else components(links.unionAll(last))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one row of each component of near-duplicates: five words, a similarity of 0.8."""
    rows = with_row_id(docs)
    return without_rows(rows, grouped_rows(rows).where(~F.col("stays")).select("_row"))


def op6_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grouped(read(spark, sf_dir, "documents"), k=4)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
