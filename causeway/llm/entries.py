"""The queries of the training-data operators and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm import codebooks, decontam, fim, html_extract, langid, licenses, media, minhash, packing, quality, sharding, toxicity, warc
from causeway.llm._common import id_crc, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.pmod(id_crc("doc_id"), F.lit(5)) == 0
    net = toxicity.fit_toxicity(toxicity.with_labels(docs.where(~held_out), labels.where(~held_out), "toxic"))
    found = toxicity.score_toxicity(docs, net)
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted", "language")


def op4_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scorer, _ = quality.fit_quality(docs)
    return quality.score_quality(docs, scorer)


def op2_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.with_feature(media.media_columns(table(spark, sf_dir, "documents")))


def op5_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_hash_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_warc_index_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op8_dom_tree_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"), html_extract.fit_tree_model())


def op9_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op10_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(id_crc("doc_id"), F.lit(3)) == 1
    model = langid.fit_language_model(docs.where(~held_out))
    found = langid.predict_language(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "languages", "shares")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    back = fim.restored(F.col("output"), F.col("form")).getField("sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", back.alias("restored_sha256"))


def op12_kd_codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = codebooks.compress(table(spark, sf_dir, "embeddings"))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return found.select("vec_id", code.alias("code"), "error", "label_error", "codebooks_sha256")


def op13_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_toxicity_cnn,
        op2_spaced_seed_decontamination,
        op3_media_columns,
        op4_weak_label_quality,
        op5_window_packing,
        op6_hash_ring_shards,
        op7_warc_index_first,
        op8_dom_tree_extraction,
        op9_minmax_near_dedup,
        op10_language_mixture,
        op11_fill_in_middle,
        op12_kd_codebooks,
        op13_license_join,
    )
}

#: Near duplicates by a join on all shingles; at most this many rounds of a component's smallest id.
_NEAR_SQL = """
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws
            FROM documents
        ), s AS (
            SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {k} THEN [array_to_string(ws, ' ')]
                                ELSE list_distinct([array_to_string(ws[i:i + {k} - 1], ' ') FOR i IN range(1, len(ws) - {k} + 2)]) END AS sh
            FROM w
        ), g AS (
            SELECT min(doc_id) AS rep, sh, list_sort(sh) AS sorted FROM s GROUP BY ALL
        ), r AS (
            SELECT min(rep) AS rep, sorted FROM g WHERE len(sorted) > 0 GROUP BY sorted
        ), u AS (
            SELECT rep, len(sorted) AS n, unnest(sorted) AS x FROM r
        ), p AS (
            SELECT a.rep AS a, b.rep AS b FROM u a JOIN u b ON a.x = b.x AND a.rep < b.rep
            GROUP BY a.rep, b.rep HAVING 100 * count(*) >= {percent} * (any_value(a.n) + any_value(b.n) - count(*))
        ), e AS (
            SELECT a, b FROM p UNION SELECT b, a FROM p
        ), c AS (
            SELECT rep AS node, rep AS reached FROM r
            UNION
            SELECT c.node, e.b FROM c JOIN e ON c.reached = e.a
        ), m AS (
            SELECT node, min(reached) AS component_id FROM c GROUP BY node
        ), o AS (
            SELECT s.doc_id, len(s.sh) AS n_shingles, coalesce(m.component_id, s.doc_id) AS component_id
            FROM s LEFT JOIN r ON r.sorted = list_sort(s.sh) LEFT JOIN m ON m.node = r.rep
        )
        SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM o
"""


#: Every pair of equal words lies on a diagonal; on each, the most pairs in a window. No seeds.
_OVERLAP_SQL = f"""
        WITH dt AS (
            SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS ws FROM documents WHERE text IS NOT NULL
        ), bt AS (
            SELECT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS ws FROM benchmark WHERE text IS NOT NULL
        ), d AS (
            SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS di FROM dt
        ), b AS (
            SELECT item_id, least(len(ws), {decontam.WINDOW}) AS w, unnest(ws) AS word, unnest(range(len(ws))) AS bi FROM bt WHERE len(ws) >= {decontam.LEAST_WORDS}
        ), m AS (
            SELECT doc_id, item_id, w, di - bi AS diagonal, bi FROM d JOIN b USING (word)
        ), g AS (
            SELECT doc_id, item_id, diagonal FROM m GROUP BY doc_id, item_id, diagonal, w HAVING 5 * count(*) >= 4 * w
        ), x AS (
            SELECT doc_id, item_id, w, count(*) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY bi RANGE BETWEEN CURRENT ROW AND w - 1 FOLLOWING) AS k
            FROM m SEMI JOIN g USING (doc_id, item_id, diagonal)
        )
        SELECT doc_id, item_id, max(k)::BIGINT AS matched_words, max(w)::BIGINT AS window_words FROM x WHERE 5 * k >= 4 * w GROUP BY doc_id, item_id
"""

#: The pages of the tables hold their main text in one article element.
_ARTICLE_SQL = """
        WITH a AS (
            SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*)</article>', 1), '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS x FROM pages
        ), d AS (
            SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '&middot;?', '·', 'g'), '&copy;?', '©', 'g'), '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g') AS x FROM a
        ), t AS (
            SELECT page_id, url, trim(regexp_replace(x, '\\s+', ' ', 'g')) AS text FROM d
        )
        SELECT page_id, url, text, length(text) AS n_chars FROM t
"""


_CUT_SQL = """
        WITH u AS (
            SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
                   regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS us
            FROM documents
        ), d AS (
            SELECT doc_id, t, us, len(us) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
            FROM u
        ), c AS (
            SELECT doc_id, t, us, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                   CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
            FROM d
        ), p AS (
            SELECT doc_id, t, n, form, array_to_string(us[1:a], '') AS pre, array_to_string(us[a + 1:b], '') AS mid, array_to_string(us[b + 1:n], '') AS suf FROM c
        )
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM p
"""


def _codes_sql() -> str:
    """Codebooks by comparing every part with every entry."""
    parts, scale = codebooks.PARTS, codebooks.SCALE
    ctes = [
        "k AS (SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"w AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v, len(embedding) // {parts} AS m FROM k)",
        f"p AS (SELECT vec_id, g.part AS part, v[g.part * m + 1:(g.part + 1) * m] AS x FROM w, (SELECT unnest(range({parts})) AS part) g)",
        f"b0 AS (SELECT part, dense_rank() OVER (ORDER BY vec_id) - 1 AS entry, x FROM p WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT {codebooks.ENTRIES}))",
    ]
    distance = "list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    for r in range(codebooks.ROUNDS + 1):
        ctes.append(f"a{r} AS (SELECT p.vec_id, p.part, any_value(p.x) AS x, min({{'d': {distance}, 'e': b.entry}}) AS best FROM p JOIN b{r} b USING (part) GROUP BY p.vec_id, p.part)")
        if r < codebooks.ROUNDS:
            ctes.append(f"s{r} AS (SELECT part, best.e AS entry, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS v FROM a{r}, (SELECT unnest(range(1, (SELECT max(m) FROM w) + 1)) AS i) GROUP BY ALL)")
            ctes.append(f"n{r} AS (SELECT part, entry, list(v ORDER BY i) AS x FROM s{r} GROUP BY part, entry)")
            ctes.append(f"b{r + 1} AS (SELECT b.part, b.entry, coalesce(n.x, b.x) AS x FROM b{r} b LEFT JOIN n{r} n ON b.part = n.part AND b.entry = n.entry)")
    last = codebooks.ROUNDS
    ctes.append(f"h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{last})")
    ctes.append(f"c AS (SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a{last} GROUP BY vec_id)")
    ctes.append("l AS (SELECT c.*, label, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error FROM c JOIN w USING (vec_id))")
    return f"WITH {', '.join(ctes)} SELECT vec_id, code, error, label_error, codebooks_sha256 FROM l, h"


def _license_sql() -> str:
    """All blocks with a word of a template, without an order of words or filters."""
    rows = ", ".join(f"({k}, '{t.label}', {t.phrase}, {list(t.words)}, {t.need})" for k, t in enumerate(licenses.TEMPLATES))
    return f"""
        WITH t(tid, label, phrase, ws, need) AS (VALUES {rows}),
        s AS (SELECT *, len(ws) AS m, list_distinct(ws) AS own FROM t),
        o AS (SELECT tid, m, unnest(own) AS w FROM s),
        d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents
        ), x AS (
            SELECT doc_id, unnest(words) AS w, unnest(range(len(words))) AS pos FROM d
        ), h AS (
            SELECT doc_id, tid, unnest(CASE WHEN pos >= m THEN [pos // m - 1, pos // m] ELSE [0] END) AS block, w FROM x JOIN o USING (w)
        ), g AS (
            SELECT doc_id, tid, block, count(DISTINCT w) AS overlap FROM h GROUP BY doc_id, tid, block
        ), n AS (
            SELECT g.doc_id, s.label, max(overlap / len(s.own)) AS share FROM g JOIN s USING (tid) WHERE NOT phrase AND overlap >= need GROUP BY g.doc_id, s.label
        ), q AS (
            SELECT doc_id, s.label, pos FROM x JOIN s ON s.phrase AND s.ws[1] = x.w JOIN d USING (doc_id) WHERE words[pos + 1:pos + m] = s.ws
        ), b AS (
            SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, array_to_string(list_sort(list(DISTINCT label)), ',') AS base_labels FROM q GROUP BY doc_id
        ), a AS (
            SELECT doc_id, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(share) AS score FROM (SELECT doc_id, label, 1.0 AS share FROM q UNION ALL SELECT * FROM n) GROUP BY doc_id
        )
        SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
        FROM d LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id)
    """


ORACLE_SQL: dict[str, str] = {
    "op11_fill_in_middle": _CUT_SQL,
    "op12_kd_codebooks": _codes_sql(),
    "op13_license_join": _license_sql(),
    "op8_dom_tree_extraction": _ARTICLE_SQL,
    "op2_spaced_seed_decontamination": _OVERLAP_SQL,
    "op9_minmax_near_dedup": _NEAR_SQL.format(k=3, percent=85),
    "op7_warc_index_first": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, '')) AS payload_bytes
            FROM pages
        ), f AS (
            SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first_id IS NULL OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM p LEFT JOIN f USING (payload_digest)
    """,
}
