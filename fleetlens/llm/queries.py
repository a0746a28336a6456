"""The queries of this subpackage, by name, and the SQL of those that DuckDB can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import load
from .decontamination import decontaminate, items_digest
from .hard_negatives import hard_negatives
from .jaccard_join import jaccard_components
from .mixing import mix_sources
from .packing import pack
from .pii import find_pii
from .quality import quality_filter
from .secret_scan import scan_secrets
from .topk import exact_top_k
from .substring_dedup import substring_dedup
from .token_alignment import align_tokenizers
from .toxicity import score_documents
from .url_filter import keys_of, url_filter, url_parts

URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
#: Hosts that are blocked with all below them where no rule fits, beside those that tracked_hosts() finds.
URL_BLOCKED_HOSTS = ["adult-x.example.com", "ads-track.example.com", "casino-win.example.net", "cheap-pills.example.net", "free-bets.example.net", "spam-farm.example.org"]


def op1_exact_top_k(spark, sf_dir):
    return exact_top_k(load(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 50 == 0, k=5)


def op2_mix_sources(spark, sf_dir):
    return mix_sources(load(spark, sf_dir, "documents"), (3, 1, 2), 1.5, 2.0)


def op3_pii(spark, sf_dir):
    found = find_pii(load(spark, sf_dir, "documents"))
    return found.withColumn("sanitised_sha256", F.sha2(F.col("sanitised").cast("binary"), 256))


def op4_jaccard_join(spark, sf_dir):
    return jaccard_components(load(spark, sf_dir, "documents"))


def op5_substring_dedup(spark, sf_dir):
    return substring_dedup(load(spark, sf_dir, "documents"), window=50)


def tracked_hosts(pages):
    """Hosts of which more than a fifth of the URLs carry a query."""
    host, _ = url_parts(F.col("url"))
    by = pages.select(host.alias("host"), F.contains("url", F.lit("?")).alias("asks")).where("host <> ''").groupBy("host")
    return by.agg(F.count_if("asks").alias("n"), F.count("*").alias("all")).where("5 * n > all").select("host")


def op6_url_filter(spark, sf_dir):
    pages = load(spark, sf_dir, "pages")
    listed = keys_of(spark, URL_BLOCKED_HOSTS).union(tracked_hosts(pages)).distinct()
    return url_filter(pages, URL_RULES, listed)


def op7_best_fit_packing(spark, sf_dir):
    import public_tokenizers

    return pack(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), room=4096, end_id=1)


def op8_toxicity(spark, sf_dir):
    scored = score_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), ["doc_id", "lang"])
    return scored.select("doc_id", "held_out", "score", "predicted", "threshold", "flagged")


def op9_quality_rules(spark, sf_dir):
    return quality_filter(load(spark, sf_dir, "documents"))


def op10_secret_scan(spark, sf_dir):
    return scan_secrets(load(spark, sf_dir, "documents"), ["doc_id"])


def op11_hard_negatives(spark, sf_dir):
    vectors = load(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", label), "vec_id", "embedding", "label", F.col("vec_id") % 100 == 0, positives=5, negatives=10, low=30, high=90)


def op12_decontamination(spark, sf_dir):
    found = decontaminate(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), width=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items_digest(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op13_token_alignment(spark, sf_dir):
    import public_tokenizers

    return align_tokenizers(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), groups="sha256")


QUERIES = {f.__name__: f for f in (op1_exact_top_k, op2_mix_sources, op3_pii, op4_jaccard_join, op5_substring_dedup, op6_url_filter, op7_best_fit_packing, op8_toxicity, op9_quality_rules, op10_secret_scan, op11_hard_negatives, op12_decontamination, op13_token_alignment)}

ORACLE = {
    "op1_exact_top_k": """
        WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
              FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op2_mix_sources": """
        WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
                          CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3.0::DOUBLE, 1.0, 2.0][(row_number() OVER (ORDER BY source COLLATE C NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
        o AS (SELECT *, 2.0 * source_size / w AS ratio, row_number() OVER (ORDER BY 2.0 * source_size / w, source) AS i FROM s),
        l AS (SELECT *, (1.5 * (SELECT sum(source_size) FROM s) - coalesce(sum(2.0 * source_size) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                        / sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
        t AS (SELECT source, source_size, CAST(least(2.0 * source_size, w * (SELECT level FROM l WHERE level <= ratio ORDER BY i LIMIT 1)) AS DOUBLE) AS target FROM o),
        e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
        g AS (SELECT d.source, d.h, sum(size) AS g, sum(sum(size)) OVER (PARTITION BY d.source ORDER BY d.h) AS run FROM d WHERE size > 0 GROUP BY d.source, d.h),
        f AS (SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, e.source_size, e.target, e.epochs, g.g, g.run, e.target - e.epochs * e.source_size AS budget
              FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source LEFT JOIN g ON g.source IS NOT DISTINCT FROM d.source AND g.h = d.h)
        SELECT doc_id, size, source_size, target,
               CAST(size * (epochs + CASE WHEN size > 0 AND (run <= budget OR (run - g <= budget AND g < 2 * (budget - (run - g)))) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM f""",
    "op4_jaccard_join": """
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        t AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
        x AS (SELECT doc_id, string_agg(x, ' ') OVER f AS h, count(*) OVER f AS n FROM t WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
        s AS (SELECT DISTINCT doc_id, h FROM x WHERE n = 5 UNION SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id AS node, doc_id AS seen FROM d UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen)
        SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.seen) AS component_id FROM d JOIN r ON r.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op5_substring_dedup": """
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        t AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
        x AS (SELECT doc_id, i, md5(string_agg(x, ' ') OVER f) AS h, count(*) OVER f AS n FROM t WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
        m AS (SELECT h, min(doc_id) AS first FROM x WHERE n = 50 GROUP BY h),
        r AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS i FROM x JOIN m USING (h) WHERE n = 50 AND doc_id > first),
        k AS (SELECT t.doc_id, count(*) AS n_words, count(r.i) AS n_removed, string_agg(x, ' ' ORDER BY t.i) FILTER (WHERE r.i IS NULL) AS kept FROM t LEFT JOIN r ON r.doc_id = t.doc_id AND r.i = t.i GROUP BY 1)
        SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id""",
    "op6_url_filter": """
        WITH a AS (SELECT page_id, url, CASE WHEN url IS NOT NULL AND instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        b AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path FROM a),
        c AS (SELECT *, CASE WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
                             WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
                             WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
                             WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule FROM b),
        q AS (SELECT host FROM b WHERE host <> '' GROUP BY host HAVING 5 * count_if(contains(url, '?')) > count(*)),
        k AS (SELECT list(DISTINCT host) AS listed FROM (SELECT host FROM q UNION ALL SELECT unnest(['adult-x.example.com', 'ads-track.example.com', 'casino-win.example.net', 'cheap-pills.example.net', 'free-bets.example.net', 'spam-farm.example.org'])))
        SELECT page_id, host, path, rule,
               CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
                    WHEN len(list_filter(listed, lambda h: ends_with('.' || host, '.' || h))) > 0 THEN 'block' ELSE 'allow' END AS verdict FROM c, k""",
    "op11_hard_negatives": """
        WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
              FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
        n AS (SELECT anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score,
                     CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank
              FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
        SELECT * FROM n WHERE rank <= 10""",
    "op12_decontamination": """
        WITH i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        g AS (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM i WHERE len(w) > 0),
        p AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + 9], ' ') AS h FROM g),
        d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        t AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
        x AS (SELECT doc_id, i, list(x) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS l FROM t),
        h AS (SELECT doc_id, i, k, item_id FROM (SELECT doc_id, i, k, array_to_string(l[1:k], ' ') AS h FROM x JOIN (SELECT DISTINCT k FROM p) ON len(l) >= k) JOIN p USING (h, k)),
        c AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + k - 1)) AS i FROM h) GROUP BY doc_id),
        m AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)""",
}
