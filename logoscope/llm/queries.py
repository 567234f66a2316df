"""Queries of this package, one for each operator, over the whole of its table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from logoscope.llm import bpe, exact_dedup, fill_middle, impact_index, jaccard_join, kd_shards, language_id, multi_index, packing, pii, quality, resampling, token_shards

QUERIES: dict = {}
ORACLES: dict = {}


def query(name, sql=None):
    def put(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return put


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op3_content_sort",
    r"""
    WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm,
                      length(coalesce(text, '')) AS n_cp FROM documents)
    SELECT doc_id, first_value(doc_id) OVER w AS keep_id,
           count(*) OVER (PARTITION BY norm) AS group_size,
           doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
    FROM n WINDOW w AS (PARTITION BY norm ORDER BY n_cp DESC, doc_id)
    """,
)
def op3_content_sort(spark, sf_dir):
    """Groups of equal texts of all documents."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query("op2_kd_tree_shards")
def op2_kd_tree_shards(spark, sf_dir):
    """All documents in 16 shards of near equal bytes."""
    placed = kd_shards.kd_shards(table(spark, sf_dir, "documents"), shards=16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op1_token_tables")
def op1_token_tables(spark, sf_dir):
    """All documents as token ids in sorted-string tables, read back."""
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return token_shards.round_trip(table(spark, sf_dir, "documents"), tokenizer, end_id=2)


@query("op5_segment_tree_bpe")
def op5_segment_tree_bpe(spark, sf_dir):
    """Byte-level BPE of all documents, there and back."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def id_remainder(n):
    """crc32 of the identifier as text, modulo ``n``; of a null one that of empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(n))


@query("op4_string_kernel_language")
def op4_string_kernel_language(spark, sf_dir):
    """Language of all documents; a fifth of them is held out of the fit."""
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, docs.where(id_remainder(5) != 0))
    return found.select("doc_id", (id_remainder(5) == 0).alias("held_out"), "lang_pred", "score")


@query("op10_fourier_quality")
def op10_fourier_quality(spark, sf_dir):
    """Quality of all documents; labels of a quarter of them are held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = quality.quality_scores(docs, labels.where(id_remainder(4) != 2))
    return found.select("doc_id", (id_remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query(
    "op7_multi_index",
    """
    WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    ok AS (SELECT * FROM v WHERE length(e) > 0 AND length(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
             AND length(list_filter(e, lambda x: x <> 0)) > 0),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND length(a.e) = length(b.e)
          WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
    c AS (SELECT a AS id, a AS r FROM l UNION SELECT c.id, l.b FROM c JOIN l ON l.a = c.r),
    n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a), m AS (SELECT id AS vec_id, min(r) AS component FROM c GROUP BY id)
    SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component, vec_id) AS component_id,
           coalesce(component, vec_id) = vec_id AS kept
    FROM v LEFT JOIN n USING (vec_id) LEFT JOIN m USING (vec_id)
    """,
)
def op7_multi_index(spark, sf_dir):
    """Near-duplicates among all embeddings."""
    return multi_index.near_duplicates(table(spark, sf_dir, "embeddings"), 0.95)


@query("op8_information_theoretic_pii")
def op8_information_theoretic_pii(spark, sf_dir):
    """Personal data and disclosing terms of all documents."""
    return pii.report(table(spark, sf_dir, "documents"))


@query(
    "op9_signature_tree_join",
    r"""
    WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN length(w) >= 4 THEN list_distinct(list_transform(range(1, length(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))
                              WHEN length(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
    z AS (SELECT doc_id, length(s) AS n FROM s),
    t AS (SELECT doc_id, unnest(s) AS t FROM s),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM t a JOIN t b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
    c AS (SELECT a AS id, a AS r FROM l UNION SELECT c.id, l.b FROM c JOIN l ON l.a = c.r),
    m AS (SELECT id AS doc_id, min(r) AS component FROM c GROUP BY id)
    SELECT doc_id, n AS n_shingles, coalesce(component, doc_id) AS component_id FROM z LEFT JOIN m USING (doc_id)
    """,
)
def op9_signature_tree_join(spark, sf_dir):
    """Groups of near copies among all documents."""
    return jaccard_join.near_groups(table(spark, sf_dir, "documents"), k=4, similarity=(85, 100))


@query("op6_best_fit_packing")
def op6_best_fit_packing(spark, sf_dir):
    """All documents, as token ids with an end token, in sequences of four permitted lengths."""
    counted = token_shards.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return packing.pack(counted, F.col("n_tokens"))


@query(
    "op11_fill_in_middle",
    r"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
    u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
                 ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
    c AS (SELECT *, length(u) AS n, least(h1 % (length(u) + 1), h2 % (length(u) + 1)) AS a, greatest(h1 % (length(u) + 1), h2 % (length(u) + 1)) AS b FROM u),
    p AS (SELECT doc_id, t, n, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s,
                 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                      WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
    SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                            ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
    """,
)
def op11_fill_in_middle(spark, sf_dir):
    """All documents rearranged for filling in the middle, and rebuilt from that."""
    made = fill_middle.transform(table(spark, sf_dir, "documents"), seed="7", fim_percent=100, spm_percent=50)
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256")
    )


@query("op12_importance_resampling")
def op12_importance_resampling(spark, sf_dir):
    """All documents weighed towards the benchmark texts, and five in a hundred of the longer ones drawn."""
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), seed="42")


@query(
    "op13_impact_search",
    """
    WITH v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(1024 * x)) AS e FROM embeddings
               WHERE embedding IS NOT NULL AND length(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id AND length(c.e) = length(q.e)
          WHERE q.vec_id % 100 = 0)
    SELECT query_id, rank::INTEGER AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
    """,
)
def op13_impact_search(spark, sf_dir):
    """The ten best by inner product among all embeddings, for every hundredth of them."""
    return impact_index.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)
