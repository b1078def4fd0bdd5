"""The queries of this subpackage, each an operator over its whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from helixmill.llm import collocations, language, lexical, positional_index, prefix_bpe, projection_forest, quality, secrets, sharding, simhash, suffix_dedup, token_counts, warc
from helixmill.llm.common import shared_dir, stored, table

SLOP = 2  #: words that each word of a window may be away from its place, for n_near


def op1_warc_segments(spark, sf_dir):
    """Archives of all pages, written and read back: a row for each page."""
    path = f"{shared_dir(spark)}-warc"
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_benchmark_decontamination(spark, sf_dir):
    """Words of each document inside windows of 13 words of the benchmark, and items with a window nearby."""
    index = positional_index.build(table(spark, sf_dir, "documents"))
    return positional_index.contamination(positional_index.search(index, table(spark, sf_dir, "benchmark"), slop=SLOP))


def op3_quality_rules(spark, sf_dir):
    """Counts and verdict of each document; the strata are languages."""
    docs = table(spark, sf_dir, "documents").withColumn("stratum", F.col("lang"))
    features = stored(quality.with_counts(docs, ["doc_id", "stratum"]))
    rows = quality.judged(features, quality.calibrate(features, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_simhash_near_dedup(spark, sf_dir):
    """Fingerprint and component of each document."""
    rows = simhash.duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", simhash.as_hex().alias("fingerprint"), "component_id")


def op5_secret_scan(spark, sf_dir):
    """Secrets of each document as spans of code points, those of the base kinds counted and digested apart."""
    found = secrets.scan(table(spark, sf_dir, "documents"), ["doc_id"])
    base = [r.kind for r in secrets.BASE]
    said = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    digest = F.sha2(said(F.filter("found", lambda s: s["kind"].isin(base))), 256)
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in base), digest.alias("base_sha256"), said(F.col("found")).alias("spans"))


def op6_suffix_dedup(spark, sf_dir):
    """Bytes of each document that also stand in a document of a smaller id, removed."""
    rows = suffix_dedup.spans_removed(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op7_balanced_shards(spark, sf_dir):
    """Shard and slot of each document under the law of equal row counts."""
    return sharding.assigned(table(spark, sf_dir, "documents"))


def op8_token_counts(spark, sf_dir):
    """Tokens of each document by the word vocabulary."""
    return token_counts.counted(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_prefix_bpe(spark, sf_dir):
    """Ids of each document by the byte vocabulary, and what they decode to, as digests."""
    return prefix_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_language_id(spark, sf_dir):
    """Predicted language of each document, by a network fitted outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    return language.predicted(docs, language.train(docs))


def op11_collocations(spark, sf_dir):
    """The first 2000 phrases of each language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_embedding_near_dedup(spark, sf_dir):
    """Links and component of each vector, and whether it stays."""
    return projection_forest.near_duplicates(table(spark, sf_dir, "embeddings"))


def op13_ranked_search(spark, sf_dir):
    """The ten best documents of each benchmark item."""
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc_segments, op2_benchmark_decontamination, op3_quality_rules, op4_simhash_near_dedup, op5_secret_scan, op6_suffix_dedup, op7_balanced_shards,
        op8_token_counts, op9_prefix_bpe, op10_language_id, op11_collocations, op12_embedding_near_dedup, op13_ranked_search,
    )
}
QUERIES["pipeline"] = corpus_pipeline.run

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES = {
    "op1_warc_segments": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
     m AS (SELECT d, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY d)
SELECT p.page_id, p.n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN m.last > p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN m.last > p.page_id THEN m.last END AS refers_to
FROM p LEFT JOIN m ON p.d = m.d AND p.n >= 1000
""",
    "op2_benchmark_decontamination": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
     b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
     q AS (SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[k : k + 12], ' ') AS s
           FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS k FROM b WHERE len(w) > 0)),
     sizes AS (SELECT DISTINCT size FROM q),
     t AS (SELECT doc_id, k, size, array_to_string(w[k : k + size - 1], ' ') AS s
           FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, sizes WHERE len(w) >= size)),
     h AS (SELECT t.doc_id, t.k, t.size, q.item_id FROM t JOIN q ON t.s = q.s AND t.size = q.size),
     hit AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS x FROM h) GROUP BY doc_id),
     it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM h) GROUP BY doc_id),
     dw AS (SELECT doc_id, p, w[p] AS w FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
     qw AS (SELECT s AS q, size, j, string_split(s, ' ')[j] AS w FROM (SELECT DISTINCT s, size, unnest(range(1, size + 1)) AS j FROM q)),
     df AS (SELECT w, count(*) AS n FROM dw SEMI JOIN qw USING (w) GROUP BY w),
     rare AS (SELECT q, arg_min(j, n) AS j, arg_min(w, n) AS w FROM qw JOIN df USING (w) GROUP BY q, size HAVING count(*) = size),
     cand AS (SELECT DISTINCT doc_id, q, p - j + e AS a FROM rare JOIN dw USING (w), range(-{SLOP}, {SLOP} + 1) v(e)),
     close AS (SELECT c.doc_id, c.q FROM (SELECT cand.*, j, w, size, a + j + e AS p FROM cand JOIN qw USING (q), range(-{SLOP}, {SLOP} + 1) v(e)) c JOIN dw USING (doc_id, p, w) GROUP BY c.doc_id, c.q, a, size HAVING count(DISTINCT j) = size),
     nr AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM close JOIN q ON close.q = q.s GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN it ON d.doc_id = it.doc_id LEFT JOIN nr ON d.doc_id = nr.doc_id
""",
    "op6_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
     part AS (SELECT doc_id, o, substr(x, 2 * o + 1, 498) AS y FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 49, 200)) AS o FROM d WHERE len(x) >= 100)),
     s AS (SELECT doc_id, o + j AS k, md5_number(substr(y, 2 * j + 1, 100)) AS g FROM (SELECT *, unnest(range(0, len(y) // 2 - 49)) AS j FROM part)),
     m AS (SELECT g, min(doc_id) AS least FROM s GROUP BY g HAVING min(doc_id) < max(doc_id)),
     c AS (SELECT DISTINCT doc_id, k FROM s JOIN m USING (g) WHERE doc_id > least),
     o AS (SELECT doc_id, k, coalesce(k - lag(k) OVER w > 50, true) AS first FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
     r AS (SELECT doc_id, min(k) AS b, max(k) + 50 AS e FROM (SELECT doc_id, k, sum(first::INT) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM o) GROUP BY doc_id, run),
     gap AS (SELECT doc_id, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS a FROM r),
     t AS (SELECT d.doc_id, d.x, sum(e - b) AS n_removed, count(*) AS n_spans, string_agg(substr(d.x, 2 * a + 1, 2 * (b - a)), '' ORDER BY b) || substr(d.x, 2 * max(e) + 1) AS kept
           FROM d JOIN gap ON d.doc_id = gap.doc_id GROUP BY d.doc_id, d.x)
SELECT d.doc_id, len(d.x) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(t.kept, d.x))) AS kept_sha256
FROM d LEFT JOIN t ON d.doc_id = t.doc_id
""",
    "op11_collocations": f"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]') AS p FROM documents),
     w AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM (SELECT lang, unnest(p) AS p FROM t)),
     g AS (SELECT lang, m, array_to_string(w[k : k + m - 1], ' ') AS phrase
           FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM w, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m)),
     f AS (SELECT lang, m, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM g GROUP BY lang, m, phrase),
     n AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
     c AS (SELECT lang, m, phrase, f AS a, w FROM f WHERE m > 1 AND f >= 30),
     cut AS (SELECT lang, phrase, m, a, w, k, array_to_string(w[1 : k], ' ') AS x, array_to_string(w[k + 1 : m], ' ') AS y FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
     s AS (SELECT cut.lang, cut.phrase, cut.a, k, l.f AS l, r.f AS r, (2000000 * cut.a::HUGEINT) // (l.f + r.f) AS score
           FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = x JOIN f r ON r.lang = cut.lang AND r.phrase = y),
     b AS (SELECT lang, phrase, a, l, r, score FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
     i AS (SELECT lang, a, array_to_string(w[b : b + z - 1], ' ') AS phrase
           FROM (SELECT lang, a, w, z, m, unnest(range(1, m - z + 2)) AS b FROM (SELECT *, unnest(range(2, m)) AS z FROM c WHERE m > 2))),
     o AS (SELECT DISTINCT b.lang, b.phrase FROM b JOIN i ON i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.a >= 80 * b.a)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM b JOIN n ON n.lang = b.lang LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.phrase IS NULL
QUALIFY rank <= 2000
""",
    "op12_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
     e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
     n AS (SELECT a, count(*) AS n_links FROM e GROUP BY a),
     r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT v.vec_id, coalesce(n_links, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
""",
    "op13_ranked_search": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
     q AS (SELECT item_id, t, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS t FROM benchmark) GROUP BY item_id, t),
     s AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
     f AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM d) SEMI JOIN (SELECT DISTINCT t FROM q) USING (t) GROUP BY doc_id, t),
     k AS (SELECT t, CAST(floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1))) AS BIGINT) AS wt FROM f, s GROUP BY t, nd),
     m AS (SELECT doc_id, 100 - 75 + (75 * len(w) * nd) // l AS m FROM d, s),
     r AS (SELECT item_id, f.doc_id, CAST(sum(qtf * wt * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
           FROM f JOIN q USING (t) JOIN k USING (t) JOIN m ON m.doc_id = f.doc_id GROUP BY item_id, f.doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= 10
""",
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
