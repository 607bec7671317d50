"""The numbered queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltrace.llm import ann, centroids, chat_format, decontam, divergence, license_scan, line_dedup, near_dup, packing, quality, toxicity, url_filter, warc
from siltrace.sources.tables import table

TOXIC_FROM = 0.3
GOOD_FROM = 0.3
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed vocabulary lies; it is a parameter of every operator that needs one."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = license_scan.license_scan(table(spark, sf, "documents"))
    base = F.filter("matches", lambda m: m["base"])
    base_labels = F.array_sort(F.array_distinct(F.transform(base, lambda m: m["label"])))
    named = F.transform("matches", lambda m: m["label"])
    stated = F.flatten(F.transform("expressions", lambda e: e["ids"]))
    score = F.when(F.exists("expressions", lambda e: e["tagged"] & e["valid"]), 1.0).when(F.size(base) > 0, 0.9).when(F.size("matches") > 0, 0.6).when(F.size("expressions") > 0, 0.3).otherwise(0.0)
    words = F.transform(base, lambda m: m["word"])
    return found.select(F.col("id").alias("doc_id"), "n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"), F.array_join(base_labels, ",").alias("base_labels"), F.array_join(F.array_sort(F.array_distinct(F.concat(named, stated))), ",").alias("labels"), score.alias("score"))


def op2_ann(spark: SparkSession, sf: str) -> DataFrame:
    return ann.nearest(table(spark, sf, "embeddings"), F.col("id") % 20 == 0, k=20)


def op3_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    scored = toxicity.toxicity(docs, toxicity.train(docs, table(spark, sf, "labels")))
    return scored.select("doc_id", F.coalesce(toxicity.held_out("doc_id"), F.lit(False)).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op4_warc(spark: SparkSession, sf: str) -> DataFrame:
    archive = warc.write_archives(table(spark, sf, "pages"))
    return warc.read_archives(archive).withColumnRenamed("id", "page_id").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "whole")


def op5_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.packed_sequences(table(spark, sf, "documents"), tokenizer_path()).withColumnRenamed("id", "doc_id")


def op6_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "text", F.col("_n_chunks").alias("n_chunks"), F.col("_n_removed").alias("n_removed"))


def op6_passage_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every repeated passage of over 50 words, then repeated chunks."""
    out = line_dedup.full_dedup(table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", F.col("_n_passage_lines").alias("n_passage_lines"), F.col("_n_chunks").alias("n_chunks"), F.col("_n_removed").alias("n_removed"))


def op7_near_dup(spark: SparkSession, sf: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf, "documents"), shingle=2, percent=80).withColumnRenamed("id", "doc_id")


def op8_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    formatted = chat_format.format_conversations(rows.unionByName(extra))
    return chat_format.read_conversations(formatted, in_order=True).withColumnRenamed("id", "conv_id")


def op9_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return op9_site_filter(spark, sf).drop("trust", "distrust")


def op9_site_filter(spark: SparkSession, sf: str) -> DataFrame:
    """The verdicts of ``op9_url_filter`` with the ranks behind them."""
    pages = table(spark, sf, "pages")
    return url_filter.url_verdicts(pages, RULES, *url_filter.rule_seeds(pages, RULES)).withColumnRenamed("id", "page_id")


def op10_decontam(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = decontam.contamination(docs, table(spark, sf, "benchmark"))
    spans = F.coalesce("_spans", F.array().cast("array<bigint>"))
    hit = F.aggregate(F.transform(spans, lambda x, k: F.when(k % 2 == 0, -x).otherwise(x)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    names = F.array_join("_items", ",")
    return found.select("doc_id", F.col("_words").alias("n_words"), hit.alias("n_hit"), F.size("_items").cast("bigint").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op11_centroids(spark: SparkSession, sf: str) -> DataFrame:
    return centroids.cluster(table(spark, sf, "embeddings")).withColumnRenamed("id", "vec_id")


def op12_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return divergence.divergence(table(spark, sf, "documents"))


def op13_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    scored = quality.quality(docs, quality.train(docs, table(spark, sf, "labels")))
    return scored.select("doc_id", F.coalesce(quality.held_out("doc_id"), F.lit(False)).alias("held_out"), F.col("_quality").alias("score"), (F.col("_quality") >= GOOD_FROM).cast("int").alias("predicted"))


_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_OP4 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, coalesce(html, '') AS h FROM pages
), g AS (
  SELECT h, max(page_id) AS m FROM p WHERE n >= 1000 GROUP BY h HAVING count(*) > 1
)
SELECT page_id, n AS payload_bytes, sha1(p.h) AS payload_digest,
       CASE WHEN m IS NULL OR m = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN m = page_id THEN NULL ELSE m END AS refers_to, true AS whole
FROM p LEFT JOIN g ON p.h = g.h
"""

_OP6 = rf"""
WITH l AS (
  SELECT doc_id, i, t, len(list_filter(string_split(translate(t, chr(13) || chr(9), '  '), ' '), lambda x: x <> '')) AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)
), m AS (
  SELECT *, ('0x' || substr(md5(t), 1, 8))::BIGINT AS h, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j FROM l WHERE w > 0
), r AS (
  SELECT *, coalesce((lag(h) OVER o * 31 + h) % 4294967296, 4294967296) AS r FROM m WINDOW o AS (PARTITION BY doc_id ORDER BY j)
), b AS (
  SELECT *, j = 1 OR (r < lag(r) OVER o AND r <= coalesce(lead(r) OVER o, 4294967296)) AS s FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY j)
), k AS (
  SELECT *, sum(CASE WHEN s THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY j ROWS UNBOUNDED PRECEDING) AS k FROM b
), c AS (
  SELECT doc_id, k, row_number() OVER (PARTITION BY t ORDER BY doc_id, k) > 1 AS again
  FROM (SELECT doc_id, k, string_agg(t, chr(10) ORDER BY j) AS t FROM k GROUP BY doc_id, k HAVING count(*) > 1)
), e AS (
  SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, j) > 1 AS again FROM k
), g AS (
  SELECT e.doc_id, e.i, e.w, e.k, e.s OR e.j = 1 AS opens, coalesce(c.again, false) AS chunk, e.j - row_number() OVER (PARTITION BY e.doc_id ORDER BY e.j) AS run
  FROM e LEFT JOIN c ON c.doc_id = e.doc_id AND c.k = e.k WHERE e.again
), x AS (
  SELECT doc_id, min(i) AS a, max(i) AS b, count(DISTINCT k) FILTER (WHERE chunk) AS n FROM g GROUP BY doc_id, run HAVING bool_or(chunk) OR sum(w) > {line_dedup.PASSAGE_WORDS}
), y AS (
  SELECT l.doc_id, string_agg(t, chr(10) ORDER BY i) AS text FROM l WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.doc_id = l.doc_id AND l.i BETWEEN a AND b) GROUP BY l.doc_id
), z AS (
  SELECT doc_id, sum(n) AS n, sum(b - a + 1) AS m FROM x GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(y.text, '') END AS text, CAST(coalesce(z.n, 0) AS BIGINT) AS n_chunks, CAST(coalesce(z.m, 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN y USING (doc_id) LEFT JOIN z USING (doc_id)
"""

_OP7 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w
), u AS (
  SELECT doc_id, unnest(s) AS x FROM s
), k AS (
  SELECT doc_id, len(s) AS n FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM p JOIN k ka ON ka.doc_id = a JOIN k kb ON kb.doc_id = b WHERE 100 * c >= 80 * (ka.n + kb.n - c)
), f AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, f.b FROM r JOIN f ON f.a = r.b
)
SELECT k.doc_id, k.n AS n_shingles, m.c AS component_id, k.doc_id = m.c AS kept
FROM k JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = k.doc_id
"""

_ESCAPED = r"regexp_replace(replace({}, '\', '\\'), '([<\[])(/?s>|</?SYS>>|/?INST\])', '\1\\\2', 'g')"
_OP8 = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum({len(chat_format.OPEN) + len(chat_format.TEXT) + len(chat_format.CLOSE)} + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


def _op9_sql(rounds: int = 6, damping: float = 0.5, threshold: float = 0.01) -> str:
    def fits(h: str, p: str) -> str:
        return f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"

    rules = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), -len(r[1])))
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in rules) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{k}'" for k, h, p in rules) + " END"
    def ranks(name: str, seeds: str, src: str, dst: str) -> str:
        out = f""", {name}s AS MATERIALIZED (SELECT DISTINCT host FROM u WHERE host <> '' AND ({seeds})),
{name}e AS MATERIALIZED (SELECT {src} AS a, {dst} AS b, n / sum(n) OVER (PARTITION BY {src}) AS w FROM edge),
{name}0 AS (SELECT host, 1.0::DOUBLE AS r FROM {name}s)"""
        for k in range(rounds):
            out += f""", {name}{k + 1} AS MATERIALIZED (SELECT host, sum(r) AS r FROM (
  SELECT b AS host, r * w * {damping}::DOUBLE AS r FROM {name}{k} JOIN {name}e ON host = a
  UNION ALL SELECT host, {1 - damping}::DOUBLE FROM {name}s) GROUP BY host)"""
        return out

    return f"""
WITH raw AS (
  SELECT page_id, html, {_LOW.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), u AS MATERIALIZED (
  SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict, html FROM raw
), link AS MATERIALIZED (
  SELECT host AS a, {_LOW.format("d")} AS b FROM (
    SELECT host, unnest(regexp_extract_all(coalesce(html, ''), '(?i)href\\s*=\\s*["'']?(?:[a-z][a-z0-9+.\\-]*:)?//([^/?#"''<>\\s]+)', 1)) AS d FROM u)
  WHERE host <> '' AND d <> '' AND host <> {_LOW.format("d")}
), h AS MATERIALIZED (
  SELECT host FROM u WHERE host <> '' UNION SELECT b FROM link
), up AS (
  SELECT host AS a, unnest(list_distinct([d FOR d IN [array_to_string(s[k:], '.') FOR k IN range(2, len(s))] IF regexp_matches(d, '[^.]\\.[^.]')])) AS b
  FROM (SELECT host, string_split(host, '.') AS s FROM h WHERE NOT regexp_matches(host, '^[0-9.]+(:[0-9]*)?$|^\\[') AND length(host) <= 253)
), edge AS MATERIALIZED (
  SELECT a, b, count(*) AS n FROM (SELECT a, b FROM link UNION ALL SELECT a, b FROM up UNION ALL SELECT b, a FROM up) GROUP BY a, b
){ranks("t", "verdict = 'allow'", "a", "b")}{ranks("d", "verdict = 'block'", "b", "a")}
SELECT page_id, u.host, path, rule, coalesce(verdict, CASE WHEN coalesce(d{rounds}.r, 0) > {threshold} AND coalesce(d{rounds}.r, 0) - coalesce(t{rounds}.r, 0) > {url_filter.TIE} THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN t{rounds} ON u.host = t{rounds}.host LEFT JOIN d{rounds} ON u.host = d{rounds}.host
"""


_OP10 = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '{_WORD}') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '{_WORD}') AS w FROM benchmark
), p AS (
  SELECT DISTINCT item, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS x
  FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), o AS (
  SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS x
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)
), f AS (
  SELECT doc_id, i, o.m, item FROM o JOIN p ON o.x = p.x AND o.m = p.m
), h AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM f) GROUP BY doc_id
), g AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM f) GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(g.n, 0) AS n_items, sha256(coalesce(g.s, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN g USING (doc_id)
"""


def _op11_sql(k: int = 8, rounds: int = 10, size: int = 64) -> str:
    """Each round as three steps: every vector's nearest centroid, sums of components, new centroids."""
    gap = "(v[{j}] - c[{j}]) * (v[{j}] - c[{j}])"
    far = " + ".join(gap.format(j=j) for j in range(1, size + 1))
    out = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size}
), c0 AS MATERIALIZED (
  SELECT n - 1 AS k, v AS c FROM (SELECT v, row_number() OVER (ORDER BY sha256('3:' || vec_id), v) AS n FROM v) WHERE n <= {k}
)"""
    for n in range(rounds + 1):
        out += f""", a{n} AS MATERIALIZED (
  SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min(d) AS d, arg_min(k, (d, k)) AS k FROM (SELECT r, vec_id, v, k, {far} AS d FROM v, c{n}) GROUP BY r
)"""
        if n < rounds:
            out += f""", c{n + 1} AS MATERIALIZED (
  SELECT c.k, coalesce(m, c) AS c FROM c{n} c LEFT JOIN (
    SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY j) AS m FROM (
      SELECT k, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{n}) GROUP BY k, j) GROUP BY k) m ON m.k = c.k
)"""
    return out + f"""
SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (k)
"""


_OP12 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), u AS MATERIALIZED (
  SELECT r, lang, source, unnest(w) AS term FROM d
), k AS MATERIALIZED (
  SELECT lang, term FROM u GROUP BY lang, term HAVING count(DISTINCT r) >= 3
), g AS MATERIALIZED (
  SELECT DISTINCT lang, source FROM d
), n AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k ON g.lang = k.lang
  LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM u GROUP BY ALL) c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), t AS (
  SELECT lang, source, sum(n)::HUGEINT + count(*) AS t FROM n GROUP BY ALL
), p AS MATERIALIZED (
  SELECT n.lang, n.source, term, n, 1 + {divergence.UNIT}::HUGEINT * (n + 1) // t AS p FROM n JOIN t ON n.lang = t.lang AND n.source = t.source
), l AS (
  SELECT x.lang, term, 1 + {divergence.UNIT}::HUGEINT * (n + 1) // t AS q FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM n GROUP BY ALL) x
  JOIN (SELECT lang, sum(n)::HUGEINT + count(DISTINCT term) AS t FROM n GROUP BY lang) y ON x.lang = y.lang
), s AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), o AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT p.lang, p.source, 'term', p.term, (p - q) * (p - q) // q FROM p JOIN l ON p.lang = l.lang AND p.term = l.term WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM o) WHERE part = 'pair' OR rank <= 200
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_license_scan, op2_ann, op3_toxicity, op4_warc, op5_packing, op6_line_dedup, op6_passage_dedup, op7_near_dup, op8_chat_format, op9_url_filter, op9_site_filter, op10_decontam, op11_centroids, op12_divergence, op13_quality)}


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": _OP4, "op6_line_dedup": _OP6, "op7_near_dup": _OP7, "op8_chat_format": _OP8, "op9_url_filter": _op9_sql(), "op10_decontam": _OP10, "op11_centroids": _op11_sql(), "op12_divergence": _OP12}
