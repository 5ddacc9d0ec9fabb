"""The operators of this subpackage as queries over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innsight.llm import (
    decontaminate,
    divergence,
    hmm,
    middles,
    pieces,
    pii,
    quality,
    secrets,
    simhash,
    suffixes,
    toxicity,
    vectors,
    wordpieces,
)

PIECES = "piece_bpe_32k.model"
PII_KEY = "a key of the test tables"  # a real one comes from the caller

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(build: Query) -> Query:
    """Registers a query under its name."""
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    network = toxicity.fit(docs, table(spark, folder, "labels"))
    scored = toxicity.with_toxicity(docs, network)
    return scored.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )


@query
def op2_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, PII_KEY)


@query
def op3_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = public_tokenizers.path(PIECES)
    return pieces.encode_texts(docs, model, with_ids=False).drop("text")


@query
def op4_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """A source is an owner; what it holds in one language is a repository."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "source", "lang")
    found = secrets.scan_secrets(
        docs, owner=F.col("source"), repository=F.concat_ws("/", "source", "lang")
    )
    return found.select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2("base_text", 256).alias("base_sha256"),
        "spans",
        "n_copied",
        "n_live",
    )


def _found(kind: int, pattern: str, least: int, group: int = 0) -> str:
    """Matches of a pattern as rows (place, kind, start, stop, value): the texts between
    matches and the matches alternate. Patterns are those of Spark, each written for an
    engine without options, lookbehind and possessive repeats."""
    return f"""
    SELECT place, {kind} AS kind, stop - length(match) AS start, stop, value FROM (
      SELECT place, match, value, sum(length(gap) + length(match)) OVER (PARTITION BY place ORDER BY k) AS stop
      FROM (
        SELECT place, unnest(range(len(m))) AS k, unnest(m) AS match, unnest(v) AS value,
          unnest(g[1 : len(m)]) AS gap
        FROM (SELECT place, regexp_extract_all(t, '{pattern}') AS m,
                regexp_extract_all(t, '{pattern}', {group}) AS v,
                regexp_split_to_array(t, '{pattern}') AS g
              FROM docs)
      )
    ) WHERE length(value) >= {least}"""


def _either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


_ASSIGN = (
    f"""({_either_case("password|passwd|secret|token|api_?key")})["'']?\\x20*[:=]\\x20*["'']?"""
    "([A-Za-z0-9+/_.=-]+)"
)

ORACLE["op4_secrets"] = f"""
WITH docs AS (
  SELECT row_number() OVER () AS place, doc_id, coalesce(text, '') AS t, source AS owner,
    concat_ws('/', source, lang) AS repository
  FROM documents
), base AS ({_found(0, _ASSIGN, 12, 2)}
  UNION ALL {_found(1, "AKIA[A-Z0-9]+", 18)}
  UNION ALL {_found(2, "[0-9a-f]+", 16)}
), generic AS ({_found(3, "[A-Za-z0-9+/_-]+", 24)}
    AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]')
    AND regexp_matches(value, '[A-Z]')
), spans AS (
  SELECT * FROM base UNION ALL
  SELECT * FROM generic g WHERE NOT EXISTS (
    SELECT 1 FROM base b WHERE b.place = g.place AND b.start < g.stop AND g.start < b.stop)
), held AS (
  SELECT value, count(DISTINCT owner) >= 3 AND count(DISTINCT repository) >= 3 AS copied
  FROM spans JOIN docs USING (place) GROUP BY value
), named AS (
  SELECT place, kind, start, copied,
    ['assign', 'access', 'hex', 'generic'][kind + 1] || ':' || start || ':' || stop AS name
  FROM spans JOIN held USING (value)
), counted AS (
  SELECT place, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b,
    count(*) FILTER (kind = 2) AS c, count(*) FILTER (copied) AS copies, count(*) AS n,
    string_agg(name, ',' ORDER BY start, kind) FILTER (kind < 3) AS base_text,
    string_agg(name, ',' ORDER BY start, kind) FILTER (kind < 3 OR NOT copied) AS shown
  FROM named GROUP BY place
)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
  sha256(coalesce(base_text, '')) AS base_sha256, coalesce(shown, '') AS spans,
  coalesce(copies, 0) AS n_copied, coalesce(n - copies, 0) AS n_live
FROM docs LEFT JOIN counted USING (place)
"""


@query
def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs)
    return found.withColumn("fingerprint", F.lpad(F.lower(F.hex("fingerprint")), 16, "0"))


@query
def op6_suffix_array(spark: SparkSession, folder: str) -> DataFrame:
    found = suffixes.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


ORACLE["op6_suffix_array"] = """
WITH docs AS (
  SELECT row_number() OVER () AS place, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), starts AS (
  SELECT place, i, md5(substr(h, 2 * i + 1, 800)) AS m
  FROM docs, unnest(range(greatest(length(h) // 2 - 399, 0))) AS t(i)
), repeated AS (
  SELECT place, i, i > lag(i) OVER w + 400 AS apart
  FROM starts WHERE m IN (SELECT m FROM starts GROUP BY m HAVING count(*) > 1)
  WINDOW w AS (PARTITION BY place ORDER BY i)
), numbered AS (
  SELECT place, i, sum(CAST(coalesce(apart, true) AS INTEGER)) OVER (PARTITION BY place ORDER BY i) AS run
  FROM repeated
), runs AS (SELECT place, min(i) AS a, max(i) + 400 AS b FROM numbered GROUP BY place, run),
kept AS (
  SELECT r.place, count(*) AS n, sum(b - a) AS gone, max(b) AS last, string_agg(part, '' ORDER BY a) AS parts
  FROM (SELECT place, a, b, coalesce(lag(b) OVER (PARTITION BY place ORDER BY a), 0) AS before FROM runs) r
  JOIN docs USING (place), LATERAL (SELECT substr(h, 2 * before + 1, 2 * (a - before)) AS part)
  GROUP BY r.place
)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
  coalesce(n, 0) AS n_spans,
  sha256(unhex(coalesce(parts, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM docs LEFT JOIN kept USING (place)
"""


@query
def op7_hidden_markov(spark: SparkSession, folder: str) -> DataFrame:
    return hmm.score_texts(table(spark, folder, "documents").select("doc_id", "text"))


@query
def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return wordpieces.count_tokens(docs, public_tokenizers.path(PIECES)).drop("text")


@query
def op9_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_vectors(table(spark, folder, "embeddings"))


ORACLE["op9_vectors"] = """
WITH RECURSIVE able AS (
  SELECT row_number() OVER () AS place, vec_id, label, embedding::DOUBLE[] AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda v: NOT isfinite(v))) = 0
    AND len(list_filter(embedding, lambda v: v <> 0)) > 0
), links AS (
  SELECT a.place AS p, a.vec_id AS a, b.vec_id AS b
  FROM able a JOIN able b ON a.label = b.label AND a.place <> b.place
    AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.98
), reached(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
), counts AS (SELECT a, count(*) AS n FROM links GROUP BY a),
least AS (SELECT a, min(b) AS b FROM reached GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links,
  least(e.vec_id, coalesce(l.b, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(l.b, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN counts c ON e.vec_id = c.a LEFT JOIN least l ON e.vec_id = l.a
"""


@query
def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


ORACLE["op10_decontamination"] = """
WITH items AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), item_windows AS (
  SELECT DISTINCT item, least(len(w), 13) AS n,
    array_to_string(w[i + 1 : i + 13], ' ') AS v
  FROM items, unnest(range(greatest(len(w) - 12, 1))) AS t(i) WHERE len(w) > 0
), docs AS (
  SELECT row_number() OVER () AS place, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), lengths AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT place, i, n, array_to_string(w[i + 1 : i + n], ' ') AS v
  FROM docs, lengths, unnest(range(greatest(len(w) - n + 1, 0))) AS t(i)
), found AS (
  SELECT d.place, d.i, d.n, m.item FROM doc_windows d JOIN item_windows m ON d.n = m.n AND d.v = m.v
), hit AS (
  SELECT place, count(DISTINCT k) AS n_hit FROM found, unnest(range(i, i + n)) AS t(k) GROUP BY place
), named AS (
  SELECT place, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT place, item FROM found) GROUP BY place
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (place) LEFT JOIN named USING (place)
"""


@query
def op11_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "n_chars")
    machine = quality.fit(docs, table(spark, folder, "labels"), numbers=("n_chars",))
    scored = quality.with_quality(docs, machine, numbers=("n_chars",))
    return scored.select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )


@query
def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    made = middles.fill_in_middle(docs)
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(middles.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLE["op12_fill_in_middle"] = """
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256(concat('7:', doc_id)) AS h,
    regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u
  FROM documents
), drawn AS (
  SELECT doc_id, t, u, len(u) AS n,
    ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS r1,
    ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS r2,
    ('0x' || substr(h, 17, 8))::BIGINT % 100 AS r3,
    ('0x' || substr(h, 25, 8))::BIGINT % 100 AS r4
  FROM units
), cut AS (
  SELECT doc_id, t, n,
    array_to_string(u[1 : least(r1, r2)], '') AS p,
    array_to_string(u[least(r1, r2) + 1 : greatest(r1, r2)], '') AS m,
    array_to_string(u[greatest(r1, r2) + 1 :], '') AS s,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r3 >= 100
      THEN 'plain' WHEN r4 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m)
    ELSE concat('<S>', s, '<P>', p, '<M>', m) END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM cut
"""


@query
def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit_sources(table(spark, folder, "documents").select("text", "lang", "source"))


ORACLE["op13_source_divergence"] = """
WITH docs AS (
  SELECT row_number() OVER () AS place, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), occurring AS (SELECT place, lang, source, unnest(w) AS term FROM docs),
kept AS (
  SELECT lang, term, count(*)::HUGEINT AS total FROM occurring GROUP BY lang, term
  HAVING count(DISTINCT place) >= 3
), langs AS (SELECT lang, count(*) AS v, sum(total)::HUGEINT AS n_lang FROM kept GROUP BY lang),
counted AS (
  SELECT lang, source, term, count(*)::HUGEINT AS c
  FROM occurring SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), groups AS (
  SELECT g.lang, g.source, coalesce(v, 0)::HUGEINT AS v, coalesce(n_lang, 0) AS n_lang,
    coalesce((SELECT sum(c) FROM counted k WHERE k.lang = g.lang AND k.source = g.source), 0)::HUGEINT AS n
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN langs USING (lang)
), chances AS (
  SELECT g.lang, g.source, t.term, coalesce(c, 0) AS c,
    1 + (1000000000::HUGEINT * (coalesce(c, 0) + 1)) // (g.n + g.v) AS p,
    1 + (1000000000::HUGEINT * (t.total + 1)) // (g.n_lang + g.v) AS q
  FROM groups g JOIN kept t USING (lang) LEFT JOIN counted USING (lang, source, term)
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
    coalesce((SELECT sum((x.p - y.p) * (x.p - y.p) // y.p) FROM chances x JOIN chances y
      ON x.lang = y.lang AND x.term = y.term
      WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value
  FROM chances WHERE c > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part
    ORDER BY value DESC, encode(item)) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked
WHERE part = 'pair' OR rank <= 200
"""
