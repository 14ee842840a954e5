"""One query per operator over its whole table, and the SQL it is compared with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import (
    hard_negatives,
    language,
    licences,
    mixing,
    near_dup,
    order_minhash,
    packing,
    pii,
    resampling,
    rp_forest,
    token_files,
    toxicity,
    url_rules,
)
from barloom.llm.common import LOWER, UPPER, Query, crc_remainder, table

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        of_kind = F.filter(base, lambda s: s["kind"] == pii.KINDS.index(kind))
        return F.size(of_kind).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(kind) for kind in pii.BASE_PATTERNS],
        F.sha2(pii.describe(base), 256).alias("base_sha256"),
        pii.describe(F.col("spans")).alias("spans"),
    )


@query
def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    return mixing.mixed_sizes(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.ToxicityModel:
    """Trained on the labels whose crc32 remainder by 5 is not 0."""
    return toxicity.fit(docs, labels.filter(crc_remainder("doc_id", 5) != 0).select("doc_id", "toxic"))


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; rows with a null id count as not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        F.coalesce(crc_remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("offending").alias("n_offending"),
    )


@query
def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text."""
    return order_minhash.fingerprints(table(spark, sf_dir, "documents"))


@query
def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical digest, licence and licence notices of every document."""
    known = spark.createDataFrame(licences.KNOWN, "licence string, text string")
    return licences.scan(table(spark, sf_dir, "documents"), known)


_KNOWN_SQL = ", ".join(f"('{name}', '{text}')" for name, text in licences.KNOWN)
ORACLES["op6_licences"] = f"""
WITH known(licence, text) AS (VALUES {_KNOWN_SQL}),
listed AS (SELECT sha256({licences.canonical_sql('text')}) AS digest, min(licence) AS licence FROM known GROUP BY 1),
docs AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
whole AS (SELECT n, doc_id, text, {licences.canonical_sql('text')} AS words FROM docs),
lines AS (
    SELECT n, {licences.canonical_sql('line')} AS words
    FROM (SELECT n, unnest(string_split(translate(text, chr(13), chr(10)), chr(10))) AS line FROM docs)
),
notices AS (
    SELECT n, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices
    FROM lines JOIN listed ON words <> '' AND sha256(words) = digest GROUP BY n
)
SELECT doc_id, CASE WHEN words <> '' THEN sha256(words) END AS digest, licence, coalesce(notices, '') AS notices
FROM whole LEFT JOIN listed ON words <> '' AND sha256(words) = digest LEFT JOIN notices USING (n)
"""


@query
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned where the crc32 remainder by 4 is not 2. Rows with a null id
    count as not held out, and teach nothing."""
    docs = table(spark, sf_dir, "documents")
    held_out = crc_remainder("doc_id", 4) == 2
    model = language.fit(docs.filter(~held_out).select("text", "lang"))
    return language.classify(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


#: The rules of the query: host, path prefix, verdict.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


@query
def op8_judge_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, longest rule and verdict of every page; pages without a rule are allowed."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge_urls(pages, rules).drop("url")


ORACLES["op8_judge_urls"] = f"""
WITH rules(rhost, rpath, verdict) AS (VALUES {', '.join(map(str, URL_RULES))}),
rest AS (
    SELECT row_number() OVER () AS n, page_id,
        CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
    FROM pages
),
split AS (
    SELECT n, page_id,
        translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM rest
),
best AS (
    SELECT n, arg_max(rhost || rpath, length(rhost || rpath)) AS rule,
        arg_max(verdict, length(rhost || rpath)) AS verdict
    FROM split JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
    GROUP BY n
)
SELECT page_id, host, path, rule, coalesce(best.verdict, 'allow') AS verdict FROM split LEFT JOIN best USING (n)
"""


@query
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near duplicates of every document."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every vector whose id is divisible by 20."""
    return rp_forest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the vectors whose id is divisible by 100; where it is divisible by 7, the label
    counts as the next one."""
    vectors = table(spark, sf_dir, "embeddings")
    flipped = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", flipped), F.col("vec_id") % 100 == 0)


ORACLES["op11_hard_negatives"] = """
WITH vectors AS (
    SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v,
        CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT a.n AS a, a.vec_id AS anchor_id, r.n AS r, r.vec_id, a.label = r.label AS same,
        list_inner_product(a.v, r.v)::BIGINT AS score
    FROM vectors a JOIN vectors r ON a.n <> r.n WHERE a.vec_id % 100 = 0
),
positives AS (
    SELECT a, anchor_id, r AS p, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, r) <= 5
)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, vec_id AS negative_id, positive_score,
    score AS negative_score
FROM positives p JOIN scored s ON s.a = p.a AND NOT same
    AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.a, p.p ORDER BY score DESC, vec_id, r)
QUALIFY row_number() OVER w <= 10
"""


@query
def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents of at least 20 words, drawn to be like the benchmark."""
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


ORACLES["op12_resample"] = f"""
WITH bytes AS (
    SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, x:
        CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS checks
    FROM range(256) t(n)
),
texts AS (
    SELECT 'documents' AS side, row_number() OVER () AS n, doc_id, text FROM documents
    UNION ALL SELECT 'benchmark', row_number() OVER (), item_id, text FROM benchmark
),
split AS (
    SELECT side, n, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
        '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS words
    FROM texts
),
runs AS (
    SELECT side, n, unnest(list_concat(words,
        list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS run
    FROM split
),
named AS (SELECT DISTINCT run, hex(encode(run)) AS digits FROM runs),
hashed AS (
    SELECT run, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(digits) // 2), lambda i:
        16 * (strpos('0123456789ABCDEF', digits[2 * i + 1]) - 1) + strpos('0123456789ABCDEF', digits[2 * i + 2]) - 1)),
        lambda c, b: xor(c >> 8, checks[(xor(c, b) & 255) + 1]))) % 10000 AS bucket
    FROM named, bytes
),
counts AS (
    SELECT bucket, count(*) FILTER (side = 'documents') AS s, count(*) FILTER (side = 'benchmark') AS t
    FROM runs JOIN hashed USING (run) GROUP BY bucket
),
totals AS (SELECT sum(s)::DOUBLE AS total_s, sum(t)::DOUBLE AS total_t FROM counts),
gains AS (
    SELECT bucket,
        floor(1000 * ln((t + 1)::DOUBLE * (total_s + 10000) / ((s + 1)::DOUBLE * (total_t + 10000))))::BIGINT AS gain
    FROM counts, totals
),
weights AS (
    SELECT n, sum(gain)::BIGINT AS gain, count(*) AS n_features
    FROM runs JOIN hashed USING (run) JOIN gains USING (bucket) WHERE side = 'documents' GROUP BY n
),
scored AS (
    SELECT doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features,
        coalesce(floor(gain / n_features)::BIGINT, 0) AS weight,
        ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
    FROM split LEFT JOIN weights USING (n) WHERE side = 'documents'
),
full_ AS (
    SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score,
        count(*) FILTER (n_words >= 20) OVER () * 25 // 100 AS wanted
    FROM scored
),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id, n_features) AS place FROM full_
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= wanted THEN place END AS rank FROM placed
"""


@query
def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document in files of token ids, as read back from them."""
    read = token_files.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
