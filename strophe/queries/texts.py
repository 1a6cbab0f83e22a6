"""Retrieval, tags, names and scraping over documents, pages and names."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numeric
from ..functions import text as tx
from ..sources import records

QUERY = "Ther ing style of the heren, on mentation"
KEYWORDS = ["the", "ing", "tion", "eau", "keit", "ción", "there", "ment", "über", "para"]
STOP = ["the", "and", "for", "with"]
BEST = 8


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_topk(spark, sf_dir):
    """The eight records that hold most of a question's words, the first ones on a tie; the first eight if none does."""
    docs = table(spark, sf_dir, "documents")
    words = tx.tokens(F.lit(QUERY), stopwords=STOP)
    title = F.substring("text", 1, 40)
    hay = F.lower(F.concat_ws(" ", title, "lang", "source", "text"))
    scored = docs.select("doc_id", tx.keyword_score(words, title, F.col("source"), hay).cast("long").alias("score"), tx.excerpt(F.col("text"), 60).alias("excerpt"))
    # One bounded top-k, in which records without a hit come in their order; they stay only if there is no other.
    best = scored.orderBy(F.desc(F.greatest("score", F.lit(0))), "doc_id").limit(BEST)
    top = F.max("score").over(Window.partitionBy())
    both = best.withColumn("_top", top).where("score > 0 OR _top <= 0").drop("_top")
    return both.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))


def text_tags(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(tx.tags(F.col("text"), KEYWORDS), ",").alias("tags"))


def regex_scrape(spark, sf_dir):
    """The last number of each page's links and how many links it has, as a log is scraped for its last figure."""
    links = F.regexp_extract_all("html", F.lit(r'href="/([^"]*)"'), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.size(links).cast("long").alias("links"), F.coalesce(F.try_element_at(links, F.lit(-1)), F.lit("")).alias("last"))


def json_props(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    keys = F.json_object_keys("props")
    return e.select("event_id", F.array_join(F.array_sort(keys), ",").alias("keys"), F.size(keys).cast("long").alias("n"))


def name_sanitise(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    raw = F.concat(F.lit(" ."), F.col("p_name"), F.lit(" / "), F.col("p_type"), F.lit(":  x? -"))
    return p.select("p_partkey", tx.file_name(raw).alias("name"), tx.safe_name(F.concat("p_type", F.lit(" (A-B/C)"))).alias("safe"))


def output_stem(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    stem = (
        F.when(k % 7 == 0, F.concat("c_mktsegment", F.lit(" - "), "c_name", F.lit("_Mix")))
        .when(k % 7 == 1, F.concat("c_name", F.lit(" _MASTER")))
        .when(k % 7 == 2, F.concat(F.lower("c_mktsegment"), F.lit(" - Take? "), "c_name", F.lit(" - MASTER")))
        .when(k % 7 == 3, F.lit("  _final"))
        .when(k % 7 == 4, F.concat("c_mktsegment", F.lit(" - ")))
        .when(k % 7 == 5, F.concat(F.lit(" "), "c_name", F.lit("_processed_normalized ")))
    )
    return c.select("c_custkey", tx.output_stem(stem, F.when(k % 5 > 0, F.col("c_mktsegment")).otherwise("")).alias("stem"))


def content_fingerprint(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    content = F.coalesce("text", F.lit("")).cast("binary")
    return d.select("doc_id", F.concat(F.lit("sha256:"), F.sha2(content, 256)).alias("fingerprint"), records.content_key(content).alias("content_key"), records.content_key(content, 64).alias("short_key"))


def id_and_level_checks(spark, sf_dir):
    """Function ids that are well formed, levels as keys, and clock times, over names made from keys."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    name = F.when(k % 5 == 0, F.concat(F.lit("audio."), F.lower("p_brand"))).when(k % 5 == 1, F.concat(F.lit("audio.repair.x_"), k.cast("string"))).when(k % 5 == 2, F.lit("audio.Repair.x")).when(k % 5 == 3, F.lit("audio.a.b.c9_"))
    return p.select("p_partkey", tx.is_function_id(name).alias("is_id"), tx.level_key(F.concat(F.lit("  "), "p_type", F.lit(" "))).alias("level"), tx.clock(F.col("p_retailprice")).alias("clock"))


def json_answers(spark, sf_dir):
    """Objects taken out of answers with fences and words around them, read as rows."""
    e = table(spark, sf_dir, "events")
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat("props", F.lit(" done"))).otherwise(F.lit("no object"))
    found = tx.json_object(said)
    return e.select("event_id", F.size(F.json_object_keys(found)).cast("long").alias("n"), found.alias("object"))


def prompt_briefs(spark, sf_dir):
    """The lines of a prompt for each customer, without those that are missing."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    return c.select("c_custkey", tx.brief({"segment": F.col("c_mktsegment"), "nation": F.when(k % 3 > 0, F.col("c_nationkey")), "balance": F.when(k % 2 == 0, numeric.fixed(F.col("c_acctbal"), 1))}).alias("brief"))


_words = "['ther', 'ing', 'style', 'heren', 'mentation', 'prompt', 'lyrics', 'exclude', 'custom', 'song', 'studio', 'create']"
_kw = ", ".join(f"'{k}'" for k in KEYWORDS)
_clean = lambda s: rf"regexp_replace(regexp_replace(regexp_replace({s}, '[\\/:*?\"<>|\x00-\x1f]', '-', 'g'), '\s+', ' ', 'g'), '^[ .\-]+|[ .\-]+$', '', 'g')"
QUERIES = {
    "text_topk": text_topk, "text_tags": text_tags, "regex_scrape": regex_scrape, "json_props": json_props, "name_sanitise": name_sanitise, "output_stem": output_stem, "content_fingerprint": content_fingerprint,
    "id_and_level_checks": id_and_level_checks, "json_answers": json_answers, "prompt_briefs": prompt_briefs,
}
ORACLES = {
    "text_topk": f"""WITH s AS (SELECT doc_id, substr(text, 1, 40) AS title, lower(concat_ws(' ', substr(text, 1, 40), lang, source, text)) AS hay, source, substr(replace(trim(text, ' '), chr(10), ' '), 1, 60) AS excerpt FROM documents),
 c AS (SELECT doc_id, len(list_filter({_words}, lambda w: contains(hay, w))) + (CASE WHEN contains(lower(title), 'prompt') OR contains(lower(title), 'lyrics') OR contains(lower(title), 'style') THEN 4 ELSE 0 END) + (CASE WHEN source IN ('how_to', 'explanation') THEN 1 ELSE 0 END) AS score, excerpt FROM s)
 SELECT doc_id, score, excerpt, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM c WHERE score > 0 QUALIFY rank <= 8""",
    "text_tags": f"WITH t AS (SELECT doc_id, list_filter([{_kw}], lambda k: contains(lower(text), k))[1:8] AS t FROM documents) SELECT doc_id, CASE WHEN len(t) > 0 THEN array_to_string(t, ',') ELSE 'electronic' END AS tags FROM t",
    "regex_scrape": "WITH l AS (SELECT page_id, regexp_extract_all(html, 'href=\"/([^\"]*)\"', 1) AS l FROM pages) SELECT page_id, len(l) AS links, coalesce(l[-1], '') AS last FROM l",
    "json_props": "SELECT event_id, array_to_string(list_sort(json_keys(props)), ',') AS keys, len(json_keys(props)) AS n FROM events",
    "name_sanitise": "SELECT p_partkey, " + _clean("' .' || p_name || ' / ' || p_type || ':  x? -'") + " AS name, regexp_replace(regexp_replace(lower(p_type || ' (A-B/C)'), '[ \\-/]', '_', 'g'), '[()]', '', 'g') AS safe FROM part",
    "output_stem": """WITH s AS (SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN c_mktsegment || ' - ' || c_name || '_Mix' WHEN 1 THEN c_name || ' _MASTER' WHEN 2 THEN lower(c_mktsegment) || ' - Take? ' || c_name || ' - MASTER' WHEN 3 THEN '  _final' WHEN 4 THEN c_mktsegment || ' - ' WHEN 5 THEN ' ' || c_name || '_processed_normalized ' ELSE '' END AS stem,
  CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment ELSE 'O-M-A' END AS who FROM customer),
 b AS (SELECT c_custkey, who, CASE WHEN regexp_matches(trim(stem), '(_processed|_master|_final|_mix|_normalized)$', 'i') THEN regexp_replace(regexp_replace(trim(stem), '(_processed|_master|_final|_mix|_normalized)$', '', 'i'), '[ _-]+$', '') ELSE trim(stem) END AS title FROM s),
 h AS (SELECT *, starts_with(lower(title), lower(who || ' - ')) AS had FROM b),
 t AS (SELECT *, regexp_replace(regexp_replace(replace(CASE WHEN had THEN substr(title, length(who) + 4) ELSE title END, '?', '-'), '\\s+', ' ', 'g'), '^[ .-]+|[ .-]+$', '', 'g') AS safe FROM h)
 SELECT c_custkey, who || ' - ' || CASE WHEN safe = '' THEN 'Sin título' ELSE safe END || CASE WHEN had AND NOT ends_with(lower(safe), ' - master') THEN ' - Master' ELSE '' END AS stem FROM t""",
    "content_fingerprint": """WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents)
 SELECT doc_id, 'sha256:' || sha256(b) AS fingerprint, md5(encode(n::VARCHAR) || b[1:1048576] || CASE WHEN n > 3145728 THEN b[n // 2 + 1 : n // 2 + 1048576] || b[n - 1048575 : n] ELSE ''::BLOB END) AS content_key,
  md5(encode(n::VARCHAR) || b[1:64] || CASE WHEN n > 192 THEN b[n // 2 + 1 : n // 2 + 64] || b[n - 63 : n] ELSE ''::BLOB END) AS short_key FROM b""",
    "id_and_level_checks": """SELECT p_partkey, coalesce(regexp_full_match(CASE p_partkey % 5 WHEN 0 THEN 'audio.' || lower(p_brand) WHEN 1 THEN 'audio.repair.x_' || p_partkey WHEN 2 THEN 'audio.Repair.x' WHEN 3 THEN 'audio.a.b.c9_' END, 'audio\\.[a-z][a-z0-9_]*(\\.[a-z][a-z0-9_]*)+'), false) AS is_id,
 lower(p_type) AS level, lpad(CAST(floor(floor(p_retailprice) / 60) AS INTEGER)::VARCHAR, 2, '0') || ':' || lpad((CAST(floor(p_retailprice) AS INTEGER) % 60)::VARCHAR, 2, '0') AS clock FROM part""",
    "json_answers": "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN len(json_keys(props)) END AS n, CASE WHEN event_id % 3 < 2 THEN props END AS object FROM events",
    "prompt_briefs": "SELECT c_custkey, 'segment: ' || c_mktsegment || CASE WHEN c_custkey % 3 > 0 THEN chr(10) || 'nation: ' || c_nationkey ELSE '' END || CASE WHEN c_custkey % 2 = 0 THEN chr(10) || 'balance: ' || printf('%.1f', c_acctbal) ELSE '' END AS brief FROM customer",
}
