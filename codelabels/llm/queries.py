"""The operators as registered queries over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, line_dedup, mixing, periods, pii, quality, simhash, topk, toxicity, urls, variants, warc
from ..session import fresh_path, settle
from .common import ascii_lower, plain, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


@query
def op6_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded bytes of every document."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(read(spark, folder, "documents"), path, public_tokenizers.PATTERN)


def toxicity_model(spark: SparkSession, folder: str, docs: DataFrame) -> toxicity.Model:
    labels = read(spark, folder, "labels").filter(toxicity.for_training(F.col("doc_id")))
    return toxicity.fit(docs, labels)


@query
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Score and verdict of every document; learnt without the held-out fifth."""
    docs = read(spark, folder, "documents")
    model = toxicity_model(spark, folder, docs)
    scored = docs.select("doc_id", F.coalesce(~toxicity.for_training(F.col("doc_id")), F.lit(False)).alias("held_out"), toxicity.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query
def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's lines less those that a smaller document holds."""
    docs = read(spark, folder, "documents").select("doc_id", "text")
    found = line_dedup.dedup(docs)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


CHECKS["op9_line_dedup"] = """
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
lines AS (SELECT doc_id, generate_subscripts(a, 1) AS pos, unnest(a) AS line FROM split),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
),
shared AS (SELECT k, min(doc_id) AS holder FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
judged AS (SELECT doc_id, pos, line, coalesce(holder < doc_id, false) AS gone FROM keyed LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@query
def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(read(spark, folder, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


# The mixture: domains by source, as an editor would group them.
DOMAINS = ("web", "books", "news", "reference")
TARGETS = mixing.Targets({"web": 4, "books": 3, "news": 2, "reference": 1}, {"en": 6, "de": 2, "fr": 2, "es": 1}, {"src0": 3})
MAX_EPOCHS, SEED = 4, 7


def domain() -> Column:
    number = F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]+)$", 1)
    return F.element_at(F.array(*map(F.lit, DOMAINS)), (F.pmod(F.coalesce(F.try_to_number(number, F.lit("999999999")), F.lit(0)), F.lit(4)) + 1).cast("int"))


@query
def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Per document its leaf, tokens and number of copies in the mixture."""
    marked, leaves = mixing.plan(read(spark, folder, "documents"), TARGETS, domain(), max_epochs=MAX_EPOCHS, seed=SEED)
    return mixing.copies(marked, leaves, SEED).withColumnRenamed("id", "doc_id")


def _share_sql(name: str, nodes: str, parent: str, child: str) -> str:
    """One level of the tree: nodes has parent, child, capacity, weight, given."""
    over = f"OVER (PARTITION BY {parent})"
    before = f"OVER (PARTITION BY {parent} ORDER BY capacity::DOUBLE / weight::DOUBLE, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""
{name}_sums AS (
  SELECT * EXCLUDE (given), sum(weight) {over} AS every, coalesce(sum(weight) {before}, 0) AS w, coalesce(sum(capacity) {before}, 0) AS c,
    least(given, sum(capacity) {over}) AS given
  FROM ({nodes})
),
{name}_full AS (SELECT *, capacity::HUGEINT * (every - w)::HUGEINT <= weight::HUGEINT * greatest(given - c, 0)::HUGEINT AS is_full FROM {name}_sums),
{name} AS (
  SELECT *, CASE WHEN is_full THEN capacity ELSE least(capacity,
      (weight::HUGEINT * (given - coalesce(sum(capacity) FILTER (WHERE is_full) {over}, 0))::HUGEINT)
      // nullif(every - coalesce(sum(weight) FILTER (WHERE is_full) {over}, 0), 0)::HUGEINT) END AS budget
  FROM {name}_full
)"""


CHECKS["op1_mixing"] = f"""
WITH marked AS (
  SELECT doc_id, coalesce(['web', 'books', 'news', 'reference'][1 + coalesce(try_cast(nullif(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1), '') AS BIGINT), 0) % 4], '') AS domain,
    coalesce(lang, '') AS language, coalesce(source, '') AS source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens
  FROM documents
),
leaves AS (
  SELECT domain, language, source, sum(n_tokens) AS tokens, sum(n_tokens) * {MAX_EPOCHS} AS capacity,
    CASE domain WHEN 'web' THEN 4 WHEN 'books' THEN 3 WHEN 'news' THEN 2 WHEN 'reference' THEN 1 ELSE 1 END AS dw,
    CASE language WHEN 'en' THEN 6 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 1 ELSE 1 END AS lw,
    CASE source WHEN 'src0' THEN 3 ELSE 1 END AS sw
  FROM marked GROUP BY ALL
),
{_share_sql("top", "SELECT 0 AS top, domain, sum(capacity) AS capacity, any_value(dw) AS weight, (SELECT sum(tokens) FROM leaves) AS given FROM leaves GROUP BY domain", "top", "domain")},
{_share_sql("middle", "SELECT l.domain, l.language, sum(l.capacity) AS capacity, any_value(lw) AS weight, any_value(t.budget) AS given FROM leaves l JOIN top t ON l.domain = t.domain GROUP BY l.domain, l.language", "domain", "language")},
{_share_sql("low", "SELECT l.domain, l.language, l.source, l.tokens, l.capacity, sw AS weight, m.budget AS given FROM leaves l JOIN middle m ON l.domain = m.domain AND l.language = m.language", "domain, language", "source")},
ends AS (SELECT *, coalesce(budget // nullif(tokens, 0), 0) AS whole, budget - coalesce(budget // nullif(tokens, 0), 0) * tokens AS room FROM low),
placed AS (
  SELECT m.*, e.whole, e.room, md5('{SEED}:' || (e.whole + 1) || ':' || coalesce(doc_id::VARCHAR, '')) AS place
  FROM marked m JOIN ends e ON m.domain = e.domain AND m.language = e.language AND m.source = e.source
)
SELECT doc_id, domain, language, source, n_tokens,
  (whole + (sum(n_tokens) OVER (PARTITION BY domain, language, source ORDER BY place, doc_id ROWS UNBOUNDED PRECEDING) <= room)::INT)::BIGINT AS copies
FROM placed
"""


@query
def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of every document, the base rule, and the verdict of all rules together."""
    counted = read(spark, folder, "documents").select("doc_id", quality.counts(F.col("text")).alias("c")).select("doc_id", "c.*")
    voted = settle(counted.withColumn("votes", quality.votes()), "quality-votes")
    good = quality.fit(voted).probability(F.col("votes"))
    judged = voted.withColumns({"base_failed": quality.base_failed(), "quality": good})
    return judged.select("doc_id", *quality.COUNTS[:5], "base_failed", (~F.col("base_failed") & (F.col("quality") >= 0.5)).alias("kept"), "quality")


URL_RULES = tuple(urls.Rule(*r) for r in (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")))


# The hosts that the filter learns from, to be blocked and to be allowed, each under the same paths.
BLOCKED_HOSTS = (
    "www.casino-royal.com", "lucky-casino.example.net", "m.casino-night.example.org", "online-casinos.example.com", "best-slots.com", "free-slots.example.net",
    "free-gifts.example.com", "www.sport-bets.example.org", "bet-now.example.net", "poker-win.com", "m.texas-poker.net", "win-big-jackpot.example.com",
    "cheap-pills.com", "pills-online.example.net", "www.viagra-shop.com", "discount-pharma.example.org", "xxx-videos.com", "hot-xxx.net",
    "adult-cams.example.com", "m.live-cams.example.org", "payday-loans.com", "fast-loan-cash.example.net", "get-rich-quick.com", "cheap-replica-watches.net",
    "ads-click.example.net", "banner-track.com", "spam-mails.example.com", "link-farm.net", "blog.adult-toys.example.org", "click-ads.org", "traffic-track.example.com", "mail-spam.net",
)
ALLOWED_HOSTS = (
    "www.daily-news.com", "blog.gardening.example.org", "en.wiki.org", "school.edu", "m.weather.example.net", "library.org",
    "theother.example.com", "tionland.example.net", "www.other.example.org", "blog.there.example.com", "m.thing.example.org", "anthere.example.net",
    "recipes.com", "museum.example.org", "history.net", "www.physics.org", "train-times.example.com", "docs.software.org",
    "m.local-paper.example.net", "photos.example.com", "the-onion-farm.com", "city-council.example.org", "astronomy.net", "www.travel-notes.com",
    "ththal.example.net", "m.ththor.example.org", "thaththe.example.com", "m.ththly.example.net", "hathth.example.com", "www.ouththo.example.net", "thnded.example.org", "blog.thtish.example.net",
)
LABELLED_PATHS = ("/", "/en/12", "/de/7.html", "/fr/345/?page=2", "/es/9021#top")


def labelled_urls(spark: SparkSession) -> DataFrame:
    rows = [(f"http://{host}{path}", label) for label, hosts in ((1, BLOCKED_HOSTS), (0, ALLOWED_HOSTS)) for host in hosts for path in LABELLED_PATHS]
    return spark.createDataFrame(rows, "url string, label int")


@query
def op2_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    pages = read(spark, folder, "pages")
    return urls.judge(pages, URL_RULES, urls.fit(labelled_urls(spark)))


@query
def op7_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest other vectors of every fiftieth one."""
    vectors = read(spark, folder, "embeddings")
    return topk.search(vectors.filter("vec_id % 50 = 0"), vectors)


CHECKS["op7_topk"] = """
WITH held AS (
  SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
),
long AS (SELECT vec_id, unnest(v) AS w, generate_subscripts(v, 1) AS term FROM held),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, sum(a.w * b.w)::BIGINT AS score
  FROM long a JOIN long b ON a.term = b.term AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 GROUP BY ALL
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def archived(records: DataFrame) -> DataFrame:
    """What archives say of each page; the digest of a stored payload is taken anew from its bytes."""
    stored = F.col("payload").isNotNull()
    return records.select(
        warc.number(F.col("record_id")).alias("page_id"),
        F.when(stored, F.octet_length("payload")).otherwise(F.col("payload_bytes")).cast("long").alias("payload_bytes"),
        F.when(stored, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        warc.number(F.col("refers_to")).alias("refers_to"),
    )


@query
def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Writes a record per page, repeated payloads once, and reads the archives back."""
    archives = fresh_path(spark, "warc")
    warc.write(warc.marked(read(spark, folder, "pages")), archives)
    return archived(warc.read(spark, archives))


CHECKS["op10_warc"] = """
WITH bodies AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
firsts AS (SELECT digest, min(page_id) AS first FROM bodies WHERE n >= 100 GROUP BY digest)
SELECT page_id, n::BIGINT AS payload_bytes, b.digest AS payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM bodies b LEFT JOIN firsts f ON b.digest = f.digest
"""


def span_texts(found: Column) -> Column:
    ordered = F.array_sort(F.transform(found, lambda s: F.struct(s["start"], F.array_position(F.array(*map(F.lit, pii.KINDS)), s["kind"]), s["end"], s["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query
def op8_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Per document the number of each pattern's spans, their digest, and all spans."""
    docs = read(spark, folder, "documents")
    found = docs.select("doc_id", pii.spans(F.col("text"), pii.fit(docs)).alias("found"))
    base = F.filter("found", lambda s: s["base"])

    def number(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(number, pii.KINDS), F.sha2(span_texts(base), 256).alias("base_sha256"), span_texts(F.col("found")).alias("spans"))


def letter_runs(docs: DataFrame) -> DataFrame:
    """Every run of letters, A-Z lower-cased; one in 31, chosen by a checksum of key and run, has lost a letter.

    A row without key loses no letter.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z\u00C0-\u00FF]+"), F.lit(0))).alias("run"))
    runs = runs.select(ascii_lower(F.col("run")).alias("run"), F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), ascii_lower(F.col("run")))).alias("h"))
    at = F.pmod("h", F.length("run"))
    damaged = F.concat(F.col("run").substr(F.lit(1), at.cast("int")), F.col("run").substr(at.cast("int") + 2, F.length("run")))
    return runs.select(F.when(F.col("h") % 31 == 0, damaged).otherwise(F.col("run")).alias("word"))


@query
def op11_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Every word of seven letters or more that occurs twice, with its frequent spelling and where that leads."""
    docs = read(spark, folder, "documents")
    words = settle(variants.vocabulary(letter_runs(docs), min_chars=7, min_count=2), "variant-words")
    return variants.group(words, ratio=10)


def with_repeats(key: Column, text: Column) -> Column:
    """The text; for one key in ten with its words repeated from some place on, joined by a space."""

    @F.arrow_udf("string")
    def run(sums: pa.Array, texts: pa.Array) -> pa.Array:
        out = []
        for h, t in zip(sums.to_pylist(), plain(texts), strict=True):
            words = t.encode("utf-8", "replace").split() if h is not None and h % 10 == 0 else []
            if words:
                g, n = h // 10, len(words)
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                t = b" ".join(words[:a] + [words[a + (i - a) % p] for i in range(a, n)]).decode()
            out.append(t)
        return pa.array(out, pa.string())

    return run(F.crc32(key.cast("string")), text)


@query
def op12_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Per document its periodic runs of words, the strongest of them, and its text without the repeats."""
    docs = read(spark, folder, "documents")
    found = docs.select("doc_id", periods.runs(with_repeats(F.col("doc_id"), F.col("text"))).alias("f"))
    best = F.col("f.best")
    listed = F.transform("f.runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("f.runs").cast("long").alias("n_runs"),
        *(best[c].alias(c) for c in ("start", "length", "period")),
        F.expr("f.best.length * 1000 div f.best.period").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2(F.col("f.collapsed"), 256).alias("collapsed_sha256"),
    )


@query
def op13_langid(spark: SparkSession, folder: str) -> DataFrame:
    """Language and score of every document; learnt without the held-out fourth."""
    docs = read(spark, folder, "documents")
    may_learn = langid.for_training(F.col("doc_id"))
    model = langid.fit(docs.filter(may_learn))
    found = docs.select("doc_id", F.coalesce(~may_learn, F.lit(False)).alias("held_out"), langid.identify(F.col("text"), model).alias("f"))
    return found.select("doc_id", "held_out", F.col("f.lang").alias("lang_pred"), F.col("f.score").alias("score"))
