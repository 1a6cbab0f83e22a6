"""Language identification by Bayesian fusion of evidence.

For each row, log-likelihoods of its whole text under one model of hashed byte trigrams a language are added to the
evidence of the declared language (markup or metadata), of the address suffix, and to the log of the host's prior.
Host priors are smoothed level by level (all rows, suffix, domain, host): at each level the sums of the rows'
text posteriors are drawn towards the prior of the level above. They come from grouped aggregations over all rows;
a row's own text is taken out of its host's sums before they are used for it.

``und`` is a further class, a flat model of trigrams: a text that it explains best is in none of the languages and
the row is rejected, as is one without any letter.

The models are fitted on a bounded sample of labelled rows (``SAMPLE``, for each language the smallest digests of
doc_id, or of the text where that is null; rows that share a digest at the limit are all taken), everything else on
all rows. A language without labelled rows has no model and explains no text.

The declared language is label and evidence at once: how well texts alone are told apart shows in ``text_lang``, or
with ``declared`` hidden, as on held-out rows.

Defined cases: null and empty texts are rejected with lang ``und``; a null or unknown declared language, suffix or
host is no evidence; null ids and repeated rows are judged row by row; an empty table gives an empty result; if no
labelled row exists, the declared language decides alone.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few, let, materialize, read, released, small_batches, with_row_id, without_rows
from .url_filter import host_of

LANGUAGES = ("en", "fr", "es", "de")
#: Labelled rows that the trigram models are fitted on at most.
SAMPLE = 4000
GRAMS = 1 << 16
#: Added to every trigram's count.
SMOOTHING = 0.5
#: Trigrams of a text that count as independent at most; a longer text is worth as much as one of that length.
WEIGHT = 200
#: Chance that a declared language, and that a country's suffix, names another language than the text's.
DECLARED_WRONG, SUFFIX_WRONG = 0.05, 0.2
#: Rows of evidence that a level's prior is worth at the level below.
STRENGTH = 20.0
UNKNOWN = 1e-3
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "uk": "en", "us": "en", "au": "en"}
#: Bytes worked on at a time.
SLICE = 1 << 21

_KIND = np.zeros(256, np.uint32)
_KIND[ord("a") : ord("z") + 1] = np.arange(1, 27)
_KIND[ord("A") : ord("Z") + 1] = np.arange(1, 27)
_KIND[128:] = np.arange(27, 155)


def grams(data: np.ndarray) -> np.ndarray:
    """A code for each trigram of bytes; case and what is no letter do not count. Code 0: no letter at all."""
    k = _KIND[data]
    code = (k[:-2] * np.uint32(24025) + k[1:-1] * np.uint32(155) + k[2:]) * np.uint32(2654435761)
    return np.where((k[:-2] | k[1:-1] | k[2:]) > 0, (code >> np.uint32(16)) | np.uint32(1), np.uint32(0))


def spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text starts and the last ends; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, ends


def sums(data: np.ndarray, ends: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """For each text the sum of each table over its trigrams, slice by slice."""
    out = np.zeros((len(ends) - 1, len(tables)))
    first, last = int(ends[0]), int(ends[-1])
    for a in range(first, last, SLICE):
        b = min(a + SLICE, last)
        codes = grams(data[a : min(b + 2, last)])
        i, j = np.searchsorted(ends, a, "right") - 1, np.searchsorted(ends, b, "left")
        lo = np.maximum(ends[i:j], a) - a
        hi = np.minimum(np.minimum(ends[i + 1 : j + 1] - 2, b) - a, len(codes))
        some = np.flatnonzero(hi > lo)
        if some.size:
            cut = np.stack((lo[some], hi[some]), 1).reshape(-1)
            for t, table in enumerate(tables):
                out[i + some, t] += np.add.reduceat(np.append(table[codes], np.zeros(1, table.dtype)), cut, dtype=np.float64)[::2]
    return out


def fit(docs: DataFrame, languages: tuple[str, ...] = LANGUAGES, sample: int = SAMPLE) -> np.ndarray:
    """Log-probabilities of trigrams, a row for each language, from a bounded sample of docs(doc_id, text, lang)."""
    labelled = docs.where(F.col("lang").isin(*languages) & F.col("text").isNotNull()).withColumn("_h", F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")))
    each = [labelled.where(F.col("lang") == x).select("_h").orderBy("_h").limit(max(1, sample // len(languages))).agg(F.max("_h").alias("cut")).select(F.lit(x).alias("of"), "cut") for x in languages]
    cuts = {r["of"]: r["cut"] for r in functools.reduce(DataFrame.unionAll, each).collect() if r["cut"] is not None}
    model = np.full((len(languages), GRAMS), SMOOTHING)
    if cuts:
        inside = functools.reduce(operator.or_, ((F.col("lang") == x) & (F.col("_h") <= cut) for x, cut in cuts.items()))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = np.zeros((len(languages), GRAMS), np.int64)
            for b in batches:
                data, ends = spans(b["text"])
                for i, lang in enumerate(b["lang"].to_pylist()):
                    for a in range(int(ends[i]), int(ends[i + 1]), SLICE):
                        found[languages.index(lang)] += np.bincount(grams(data[a : min(a + SLICE + 2, int(ends[i + 1]))]), minlength=GRAMS)
            which, gram = np.nonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(gram, pa.int32()), pa.array(found[which, gram], pa.int64())], names=["lang", "gram", "n"])

        counts = labelled.where(inside).select("text", "lang").mapInArrow(released(count), "lang int, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        with small_batches(docs.sparkSession):
            got = counts.toArrow()  # languages * GRAMS rows at most
        model[got["lang"].to_numpy(), got["gram"].to_numpy()] += got["n"].to_numpy()
    model = np.log(model / model[:, 1:].sum(1, keepdims=True)).astype(np.float32)
    if cuts:
        model[[i for i, x in enumerate(languages) if x not in cuts]] = -np.inf
    return model


def softmax(scores: list[Column]) -> Column:
    """An array of the scores' shares. Each step is evaluated once: written out, it would be repeated for every score."""
    exps = let(F.array(*scores), lambda s: let(F.array_max(s), lambda top: F.transform(s, lambda x: F.exp(x - top))))
    return let(exps, lambda e: let(F.aggregate(e, F.lit(0.0), lambda t, x: t + x), lambda total: F.transform(e, lambda x: x / total)))


def best_of(shares: Column, names: tuple[str, ...]) -> Column:
    """The largest share with its name, as a struct (p, lang)."""
    return F.array_max(F.zip_with(shares, F.array(*(F.lit(n) for n in names)), lambda p, n: F.struct(p.alias("p"), n.alias("lang"))))


def identify(rows: DataFrame, model: np.ndarray, levels: list[str], keep: list[str], languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """Judges rows(text, declared, suffix, the columns levels from the broadest to the narrowest, keep).

    Returns keep and lang, posterior, text_lang, n_grams and accepted.
    """
    count = np.ones(GRAMS, np.float32)
    count[0] = 0
    tables = [np.where(np.arange(GRAMS) > 0, m, 0).astype(np.float32) for m in model] + [count]
    scored_names = ["n_grams", *(f"_t{i}" for i in range(len(languages)))]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, ends = spans(b["text"])
            got = sums(data, ends, tables) if b.num_rows else np.zeros((0, len(tables)))
            columns = [pa.array(got[:, -1].astype(np.int64))] + [pa.array(got[:, i]) for i in range(len(languages))]
            rest = [n for n in b.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(b[n] for n in rest), *columns], names=[*rest, *scored_names])

    padded = F.concat(F.lit(" "), F.coalesce("text", F.lit("")), F.lit("  "))  # a single letter has trigrams, too
    told = rows.select(*keep, *(F.coalesce(F.col(x), F.lit("")).alias(f"_l{i}") for i, x in enumerate(levels)), F.lower("declared").alias("_declared"), F.lower("suffix").alias("_suffix"), padded.alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in told.schema if f.name != "text") + ", n_grams long, " + ", ".join(f"_t{i} double" for i in range(len(languages)))
    scored = told.mapInArrow(released(score), schema)
    # The text's evidence: tempered to WEIGHT trigrams; the flat model has the same chance for every trigram.
    temper = F.least(F.lit(1.0), F.lit(float(WEIGHT)) / F.greatest("n_grams", F.lit(1)))
    scored = scored.withColumns({f"_t{i}": F.col(f"_t{i}") * temper for i in range(len(languages))} | {"_u": F.col("n_grams") * temper * float(-np.log(GRAMS))})
    scored = scored.withColumn("_alone", softmax([F.col(f"_t{i}") for i in range(len(languages))]))
    scored = scored.withColumns({f"_p{i}": F.when(F.col("n_grams") > 0, F.get("_alone", F.lit(i))).otherwise(F.lit(0.0)) for i in range(len(languages))}).drop("_alone")
    with small_batches(rows.sparkSession):
        scored = materialize(scored, "language-scores")

    keys = [f"_l{i}" for i in range(len(levels))]
    add = [F.sum(f"_p{i}").alias(f"_p{i}") for i in range(len(languages))]
    table = scored.groupBy(*keys).agg(*add)
    whole = table.agg(*add).first()
    total = sum(whole[f"_p{i}"] or 0.0 for i in range(len(languages)))
    above = {i: F.lit(((whole[f"_p{i}"] or 0.0) + 1.0) / (total + len(languages))) for i in range(len(languages))}
    for depth in range(1, len(keys)):  # priors of the broader levels: sums drawn towards the level above
        part = table.groupBy(*keys[:depth]).agg(*add)
        n = sum((F.col(f"_p{i}") for i in range(1, len(languages))), F.col("_p0"))
        if depth > 1:
            part = part.join(up, keys[: depth - 1])
        up = part.select(*keys[:depth], *(((F.col(f"_p{i}") + STRENGTH * above[i]) / (n + STRENGTH)).alias(f"_a{depth}_{i}") for i in range(len(languages))))
        above = {i: F.col(f"_a{depth}_{i}") for i in range(len(languages))}
    host = table.select(*(F.col(k).alias(f"{k}_of") for k in keys), *(F.col(f"_p{i}").alias(f"_h{i}") for i in range(len(languages))))
    if len(keys) > 1:
        host = host.join(up, [host[f"{k}_of"] == up[k] for k in keys[:-1]]).drop(*keys[:-1])
    host = few(materialize(host, "language-hosts"))  # both sides come from files, so a host with most rows can be split
    joined = scored.join(host, functools.reduce(operator.and_, (F.col(k) == F.col(f"{k}_of") for k in keys)))
    joined = joined.withColumns({f"_q{i}": F.greatest(F.col(f"_h{i}") - F.col(f"_p{i}"), F.lit(0.0)) for i in range(len(languages))})  # without the row's own text
    left = [F.col(f"_q{i}") for i in range(len(languages))]
    n = sum(left[1:], left[0])
    country = F.create_map(*(F.lit(x) for pair in SUFFIXES.items() for x in pair))[F.col("_suffix")]

    def points(at: Column, lang: str, wrong: float) -> Column:
        return F.when(~F.coalesce(at.isin(*languages), F.lit(False)), 0.0).when(at == lang, float(np.log(1 - wrong))).otherwise(float(np.log(wrong / (len(languages) - 1))))

    scores = [F.col(f"_t{i}") + F.log((left[i] + STRENGTH * above[i]) / (n + STRENGTH)) + points(F.col("_declared"), x, DECLARED_WRONG) + points(country, x, SUFFIX_WRONG) for i, x in enumerate(languages)]
    scores.append(F.when(F.col("n_grams") > 0, F.col("_u") + float(np.log(UNKNOWN))).otherwise(0.0))
    joined = joined.withColumn("_best", best_of(softmax(scores), (*languages, "und")))
    text_best = best_of(F.array(*(F.col(f"_p{i}") for i in range(len(languages)))), languages)
    empty = F.col("n_grams") == 0
    return joined.select(
        *keep,
        F.when(empty, "und").otherwise(F.col("_best.lang")).alias("lang"),
        F.when(empty, 1.0).otherwise(F.round(F.col("_best.p"), 6)).alias("posterior"),
        F.when(~empty, text_best["lang"]).alias("text_lang"),
        "n_grams",
        (~empty & (F.col("_best.lang") != "und")).alias("accepted"),
    )


#: The suffix of the first web or mail address in a text.
ADDRESS = r"(?:https?://|@)[a-z0-9.-]+\.([a-z]{2,})\b"


def identify_documents(docs: DataFrame, keep: list[str], languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """docs(doc_id, text, lang, source): the metadata's language is the declared one, the source the host.

    Sources that are named alike but for a number at the end are a family, whose prior lies between those of all rows and of
    the source. The suffix is that of the first address in the text.
    """
    family, suffix = F.regexp_replace("source", r"[0-9]+$", ""), F.regexp_extract(F.lower(F.col("text").cast("string")), ADDRESS, 1)
    rows = docs.select(*keep, "text", F.col("lang").alias("declared"), suffix.alias("suffix"), family.alias("family"), F.col("source").alias("host"))
    return identify(rows, fit(docs, languages), ["family", "host"], keep, languages)


def identify_pages(pages: DataFrame, docs: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """pages(page_id, url, html): text without markup, the markup's lang, the host's suffix, and priors by suffix, domain and host."""
    host = host_of(F.col("url"))
    suffix = F.element_at(F.split(host, r"\."), -1)
    text = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>", " ")
    rows = pages.select("page_id", text.alias("text"), F.regexp_extract("html", r"(?i)<html\b[^>]*\blang=[\"']?([a-z]{2})", 1).alias("declared"), suffix.alias("suffix"), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"), host.alias("host"))
    return identify(rows, fit(docs, languages), ["suffix", "domain", "host"], ["page_id"], languages)


def accepted(docs: DataFrame) -> DataFrame:
    """docs without the rows in none of the languages."""
    rows = with_row_id(docs)
    return without_rows(rows, identify_documents(rows, ["_row"]).where(~F.col("accepted")))


def op10_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_documents(read(spark, sf_dir, "documents"), ["doc_id"])


def pages_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_pages(read(spark, sf_dir, "pages"), read(spark, sf_dir, "documents"))
