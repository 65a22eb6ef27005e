"""The registered queries: each applies its operator to its whole table and derives the agreed columns."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, divergence, interactions, jaccard_join, licenses, mixing, perplexity, pii, quality, secrets, syncmers, warc, wrappers
from tidemark.llm.registry import query


def vocabulary() -> str:
    """Path of the vocabulary file that the package of public tokenizers installs."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op5_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), vocabulary())


def _of_kind(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


@query("op4_secrets")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(documents(spark, sf_dir), keep=["doc_id"])
    return found.select(
        "doc_id",
        *[_of_kind(k) for k in ("assign", "access", "hex")],
        F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"),
    )


@query("op9_perplexity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = perplexity.judge(documents(spark, sf_dir), keep=["doc_id", "lang"])
    return judged.drop("lang")


@query("op1_jaccard_join")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(documents(spark, sf_dir)).drop("class", "comp")


@query("op6_pii")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(documents(spark, sf_dir), keep=["doc_id"])
    return found.select(
        "doc_id",
        *[_of_kind(k) for k in pii.KINDS],
        F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"),
    )


LICENSE_SQL = f"""
WITH t(tid, label, phrase, words) AS (VALUES {", ".join(f"({i}, '{label}', {i < len(licenses.PHRASES)}, string_split('{text}', ' '))" for i, (text, label) in enumerate((*licenses.PHRASES, *licenses.NOTICES)))}),
g AS (SELECT tid, label, phrase, len(words) - 1 AS size, unnest(range(len(words) - 1)) AS place, words FROM t),
grams AS (SELECT tid, label, phrase, size, place, words[place + 1] || ' ' || words[place + 2] AS gram FROM g),
d AS (SELECT row_number() OVER () AS row, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
p AS (SELECT row, words, unnest(range(len(words) - 1)) AS pos FROM d),
pairs AS (SELECT row, pos, words[pos + 1] || ' ' || words[pos + 2] AS gram FROM p),
votes AS (SELECT row, tid, label, phrase, size, pos - place AS start, bit_or((1::UBIGINT) << place) AS mask, max(pos) AS last, min(pos) AS first
  FROM pairs JOIN grams USING (gram) GROUP BY ALL),
marked AS (SELECT *, CASE WHEN phrase OR start - lag(start) OVER w > {licenses.GAP} THEN 1 ELSE 0 END AS fresh FROM votes WINDOW w AS (PARTITION BY row, tid ORDER BY start)),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY row, tid ORDER BY start) AS run FROM marked),
merged AS (SELECT row, tid, label, phrase, size, run, min(start) AS start, bit_count(bit_or(mask)) / size AS covered, max(last) - min(first) + 1 AS length
  FROM runs GROUP BY row, tid, label, phrase, size, run),
spans AS (SELECT * FROM merged WHERE CASE WHEN phrase THEN covered = 1 ELSE covered >= {licenses.COVER} AND length <= {licenses.STRETCH} * size END)
SELECT doc_id, len(any_value(words))::BIGINT AS n_words, count(*) FILTER (phrase)::BIGINT AS n_base,
  min(start) FILTER (phrase)::BIGINT AS first_word, max(start) FILTER (phrase)::BIGINT AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(covered), 0)::DOUBLE AS score
FROM d LEFT JOIN spans USING (row) GROUP BY row, doc_id
"""


@query("op3_licenses", LICENSE_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.labels(documents(spark, sf_dir))


@query("op2_mixing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


@query("op10_syncmers")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compare_with_edits(documents(spark, sf_dir))


#: Documents below this score are rejected.
QUALITY = 0.7


@query("op8_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.coalesce(quality.remainder(F.col("doc_id")) == 2, F.lit(False))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= QUALITY).cast("int").alias("predicted"))


@query("op7_wrappers")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wrappers.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))

#: Brute force: every order, step and mask, without coalitions.
INTERACTIONS_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, CASE WHEN len(words) < 50 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails,
  coalesce(good, false)::INT AS good, coalesce(toxic, false)::INT AS toxic FROM d LEFT JOIN l USING (doc_id)),
m AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
o(filter_order) AS (VALUES {", ".join(f"('{''.join(p)}')" for p in permutations("ABCDE"))}),
s AS (SELECT part, filter_order, step, filter_order[step] AS letter, n, good, toxic, fails,
    contains(fails, filter_order[step]) AS own, translate(fails, filter_order[1:step - 1], '') <> fails AS gone
  FROM m, o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, letter, sum(n) FILTER (NOT own AND NOT gone) AS kept,
    sum(n) FILTER (own AND NOT gone) AS removed, sum(n) FILTER (own AND gone) AS redundant, sum(n) FILTER (fails = letter) AS unique_fails,
    sum(good) FILTER (own AND NOT gone) AS good_lost, sum(toxic) FILTER (own AND NOT gone) AS toxic_lost
  FROM s GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, {", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
  coalesce(sum(removed) OVER (PARTITION BY part, letter), 0)::BIGINT AS shapley FROM r
"""


@query("op13_interactions", INTERACTIONS_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.filter_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: Brute force: the shares of all terms in all groups, pair by pair.
DIVERGENCE_SQL = """
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words FROM documents),
w AS (SELECT row, lang, source, unnest(words) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT row) AS docs FROM w GROUP BY ALL),
k AS (SELECT lang, term, sum(n)::HUGEINT AS lang_n FROM c GROUP BY ALL HAVING sum(docs) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, k.lang_n FROM g JOIN k ON k.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 1)) // (sum(n) OVER s + count(*) OVER s)::HUGEINT AS p,
    1 + (1000000000 * (lang_n + 1)) // (sum(lang_n) OVER s + count(*) OVER s)::HUGEINT AS q
  FROM x WINDOW s AS (PARTITION BY lang, source)),
pairs AS (SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(sum((a.p - b.p) * (a.p - b.p) // b.p), 0)::BIGINT AS value
  FROM g JOIN g AS o ON o.lang = g.lang AND o.source <> g.source LEFT JOIN p AS a ON a.lang = g.lang AND a.source = g.source
  LEFT JOIN p AS b ON b.lang = o.lang AND b.source = o.source AND b.term = a.term GROUP BY ALL),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
"""


@query("op12_divergence", DIVERGENCE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


_BASE32 = "||".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(sha, {5 * i + 1}, 5))::INT >> {15 - 5 * j}) & 31), 1)" for i in range(8) for j in range(4)
)
WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
m AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS head FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM head THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM head THEN head END AS refers_to FROM m
"""


@query("op11_warc", WARC_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    read = warc.records(spark, path, payload=False).where("record_type IN ('response', 'revisit')")
    return read.selectExpr(
        f"{warc.page_id('record_id')} AS page_id", "payload_bytes", "payload_digest", "record_type", f"{warc.page_id('refers_to')} AS refers_to"
    )
