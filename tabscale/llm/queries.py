"""One query per corpus operator, with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from . import (exact_dedup, html_extract, lang_id, mixing, mtree, ngram_join, phrases, pii, prefix_trie, quality, sentencepiece,
               simhash, suffix_dedup)
from .common import table

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return deco


@register("op1_source_mixing")
def op1(spark, sf_dir):
    """Per document: tokens, weight and epochs of its source, copies in the mix, place in the permutation."""
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select(F.col("_id").alias("doc_id"), F.col("_source").alias("source"), "n_tokens", "weight", "epochs",
                       "copies", "mix_pos")


@register("op3_quality_classifier")
def op3(spark, sf_dir):
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op7_exact_dedup", r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS p,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm,
                  row_number() OVER () AS r
           FROM documents),
     g AS (SELECT *, sha256(norm) AS text_sha256,
                  first_value(doc_id) OVER w AS keep_id, first_value(r) OVER w AS keep_r,
                  count(*) OVER (PARTITION BY norm) AS group_size
           FROM d WINDOW w AS (PARTITION BY norm ORDER BY p DESC, doc_id NULLS LAST, r))
SELECT doc_id, keep_id, group_size, r = keep_r AS kept, text_sha256 FROM g""")
def op7(spark, sf_dir):
    out = exact_dedup.exact_groups(table(spark, sf_dir, "documents"), digest=True)
    return out.select(F.col("_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


@register("op9_language_id")
def op9(spark, sf_dir):
    return lang_id.identify(table(spark, sf_dir, "documents"))


@register("op6_html_extraction")
def op6(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages"))


@register("op10_exact_topk", """
WITH v AS (SELECT vec_id, row_number() OVER () AS r,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
           FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT a.vec_id AS query_id, a.r, b.vec_id,
                  list_sum(list_transform(range(1, least(len(a.q), len(b.q)) + 1), lambda i: a.q[i] * b.q[i]))::BIGINT AS score
           FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
     t AS (SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 5""")
def op10(spark, sf_dir):
    return mtree.top_k(table(spark, sf_dir, "embeddings"))


@register("op4_ngram_jaccard_join")
def op4(spark, sf_dir):
    out = ngram_join.similarity_classes(table(spark, sf_dir, "documents"))
    return out.select(F.col("_id").alias("doc_id"), "class_id", "n_links", "kept")


@register("op2_suffix_array_dedup")
def op2(spark, sf_dir):
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select(F.col("_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
                      "n_passage_words")


@register("op5_pii")
def op5(spark, sf_dir):
    out = pii.report(table(spark, sf_dir, "documents"))
    return out.withColumnRenamed("_id", "doc_id")


@register("op8_sentencepiece")
def op8(spark, sf_dir):
    return sentencepiece.encode(table(spark, sf_dir, "documents"))


_PHRASES_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
                  unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
     l AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM p),
     g AS (SELECT lang, unnest(list_transform(range(1, len(ws) + 1), lambda i: ws[i])) AS phrase, 1 AS m FROM l
           UNION ALL SELECT lang, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])), 2 FROM l
           UNION ALL SELECT lang, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])),
                            3 FROM l),
     f AS (SELECT lang, phrase, m, count(*) AS f FROM g GROUP BY ALL),
     n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
     c AS (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND f >= 10),
     k AS (SELECT lang, phrase, m, a, unnest(range(1, m)) AS k, ws FROM c),
     s AS (SELECT k.*, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
           FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(ws[1:k], ' ')
                  JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(ws[k + 1:], ' ')),
     b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
     t AS (SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase, a FROM c WHERE m = 3),
     d AS (SELECT b.* FROM b LEFT JOIN (SELECT lang, phrase, max(a) AS longer FROM t GROUP BY ALL) t USING (lang, phrase)
           WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM d JOIN n USING (lang) QUALIFY rank <= 2000"""


@register("op11_phrase_collocations", _PHRASES_SQL)
def op11(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@register("op12_simhash")
def op12(spark, sf_dir):
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("_id").alias("doc_id"), "fingerprint", "component_id")


@register("op13_prefix_trie", """
WITH t AS (SELECT conv_id AS c, turn, [coalesce(role, ''), coalesce(text, '')] AS x,
                  md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS k
           FROM conversations WHERE conv_id IS NOT NULL),
     o AS (SELECT c, list(x ORDER BY turn NULLS FIRST, k) AS p,
                  xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
                                  lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                                                           lambda u, v: xor(u >> 1, (u & 1) * 3988292384))), 4294967295) % 9 AS h
           FROM t GROUP BY c),
     q AS (SELECT o.c, list_concat(coalesce(s.p[1:o.h], []), o.p[o.h + 1:]) AS p FROM o LEFT JOIN o s ON s.c = o.c - o.c % 5),
     m AS (SELECT c, len(p) AS n_all, d, p[1:d] AS p FROM q, LATERAL (SELECT unnest(range(0, len(q.p) + 1)) AS d)),
     g AS (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs,
                  sha256(coalesce(string_agg(CASE WHEN n_all = d THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends_sha256
           FROM m GROUP BY p, d),
     x AS (SELECT g.*, up.conv_id AS parent_conv_id, coalesce(ch.n, 0) AS n_children,
                  CASE WHEN g.d = 0 THEN 0 ELSE (g.n_convs - 1) * strlen(g.p[g.d][2]) END AS own
           FROM g LEFT JOIN g up ON g.d > 0 AND up.d = g.d - 1 AND up.p = g.p[1:g.d - 1]
                  LEFT JOIN (SELECT p[1:d - 1] AS p, count(*) AS n FROM g WHERE d > 0 GROUP BY 1) ch ON ch.p = g.p),
     e AS (SELECT own, n_children, unnest(list_transform(range(0, d + 1), lambda i: p[1:i])) AS p FROM x),
     s AS (SELECT p, sum(own)::BIGINT AS saved_tokens, sum((n_children = 0)::INT)::BIGINT AS n_leaves FROM e GROUP BY p)
SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM x JOIN s USING (p)""")
def op13(spark, sf_dir):
    return prefix_trie.trie(prefix_trie.branched(prefix_trie.paths(table(spark, sf_dir, "conversations"))))


@register("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)
