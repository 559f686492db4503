"""The operators' queries over whole tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.llm import chat, decontaminate, embedding_dedup, html_text, merkle, minhash, mixing, prefix_trie, quality, token_counts, token_file, toxicity, warc
from barloom.llm.common import shared_folder, staged


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, base: str) -> DataFrame:
    return embedding_dedup.linked_vectors(table(spark, base, "embeddings"), cosine=0.9)


def op2_decontaminate(spark: SparkSession, base: str) -> DataFrame:
    return decontaminate.hit_counts(table(spark, base, "documents"), table(spark, base, "benchmark")).drop("spans")


def op3_html_text(spark: SparkSession, base: str) -> DataFrame:
    pages = table(spark, base, "pages")
    return html_text.extracted(pages, html_text.learned(pages)).select("page_id", "url", "text", "n_chars")


def op4_warc(spark: SparkSession, base: str) -> DataFrame:
    return warc.archived(table(spark, base, "pages"), least_bytes=0).drop("url")


def op5_minhash(spark: SparkSession, base: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, base, "documents"), shingle_words=4)


def op6_token_counts(spark: SparkSession, base: str) -> DataFrame:
    """Totals under two tokenizer versions after every document was inserted by a first rule, revised, deleted and inserted again."""
    rollup = token_counts.TokenRollup(spark, shared_folder(spark))
    token_history(rollup, table(spark, base, "documents"))
    return rollup.totals()


def token_history(rollup: token_counts.TokenRollup, docs: DataFrame) -> None:
    """Loads all documents with a token for every four characters begun, twice under one batch name; revises all of them to the
    tokenizers' counts; deletes all and inserts them again."""
    versions = ["words", "byte_bpe_50k"]
    chars = F.ceil(F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)) / 4).cast("long")
    first = docs.select("doc_id", "source", "lang", F.explode(F.array(*map(F.lit, versions))).alias("tokenizer"), chars.alias("tokens"))
    counts = staged(token_counts.counted(docs, versions))
    rollup.insert("load", first)
    rollup.insert("load", first)
    rollup.revise("recount", counts)
    rollup.delete("gone", counts)
    rollup.insert("again", counts)


def op7_chat(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    hostile = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.digest(chat.formatted(rows.unionByName(hostile)))


def op8_mixing(spark: SparkSession, base: str) -> DataFrame:
    return mixing.sharded(table(spark, base, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_toxicity(spark: SparkSession, base: str) -> DataFrame:
    docs = table(spark, base, "documents")
    return toxicity.scored(docs, toxicity.learned(docs, table(spark, base, "labels"))).select("doc_id", "held_out", "score", "predicted")


def op10_quality(spark: SparkSession, base: str) -> DataFrame:
    stats = staged(quality.measured(table(spark, base, "documents")))
    return quality.scored(stats, quality.learned(stats, table(spark, base, "labels")))


def op11_merkle(spark: SparkSession, base: str) -> DataFrame:
    """Every seventh document, by a hash of its id, is checked with one character more than its manifest says."""
    seventh = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    more = F.when(seventh, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars"))
    proven = merkle.manifest(table(spark, base, "documents"), claimed={"n_chars": more})
    return proven.withColumn("proof_sha256", F.sha2(F.array_join("siblings", ""), 256)).drop("siblings")


def op12_token_file(spark: SparkSession, base: str) -> DataFrame:
    return token_file.tokenized(table(spark, base, "documents"))


def op13_prefix_trie(spark: SparkSession, base: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(table(spark, base, "conversations"))


def pipeline(spark: SparkSession, base: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, base)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_embedding_dedup, op2_decontaminate, op3_html_text, op4_warc, op5_minhash, op6_token_counts, op7_chat, op8_mixing, op9_toxicity, op10_quality,
    op11_merkle, op12_token_file, op13_prefix_trie, pipeline)}

SQL = {
    "op1_embedding_dedup": """
WITH RECURSIVE raw AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
), ok AS (
  SELECT vec_id, v FROM raw
  WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), link AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.9
), reach AS (
  SELECT a AS vec_id, a AS other FROM link UNION SELECT reach.vec_id, link.b FROM reach JOIN link ON link.a = reach.other
), comp AS (SELECT vec_id, min(other) AS c FROM reach GROUP BY vec_id), n AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
SELECT raw.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c, raw.vec_id) AS component_id, coalesce(c, raw.vec_id) = raw.vec_id AS kept
FROM raw LEFT JOIN comp USING (vec_id) LEFT JOIN n USING (vec_id)""",
    "op2_decontaminate": r"""
WITH tok AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g, least(10, len(w)) AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM item WHERE len(w) > 0)
), size AS (SELECT DISTINCT k FROM win
), gram AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM tok, size WHERE len(w) >= k)
), occ AS (SELECT doc_id, i, k, item_id FROM gram JOIN win USING (g, k)
), hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM occ) GROUP BY doc_id
), items AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM occ) GROUP BY doc_id)
SELECT tok.doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
  sha256(coalesce(items.s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM tok LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op4_warc": r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages
), d AS (
  SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS x,
    first_value(page_id) OVER (PARTITION BY h ORDER BY page_id NULLS LAST) AS first, row_number() OVER (PARTITION BY h ORDER BY page_id NULLS LAST) AS n FROM p
)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (('0x' || substr(x, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - i % 4 * 5)::INT) % 32 + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN n > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n > 1 THEN first END AS refers_to
FROM d""",
    "op5_minhash": r"""
WITH RECURSIVE tok AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 3], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM tok WHERE len(w) > 0)
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), link AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * m >= 80 * (na.n + nb.n - m)
), reach AS (
  SELECT a AS doc_id, a AS other FROM link UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.other
), comp AS (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id)
SELECT tok.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c, tok.doc_id) AS component_id, coalesce(c, tok.doc_id) = tok.doc_id AS kept
FROM tok LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)""",
    "op7_chat": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) t(i)
), g AS (
  SELECT conv_id, count(*) AS n, string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(length(role) + length(text) + length('<|im_start|>') + length('<|im_end|>') + 2) AS plain,
    sum(len(regexp_extract_all(role || chr(1) || text, '<\\*\|'))) AS marks
  FROM c GROUP BY conv_id)
SELECT conv_id, n::BIGINT AS n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, (plain + marks)::BIGINT AS formatted_chars FROM g""",
    "op8_mixing": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(doc_id::VARCHAR, '') || 'mix-1') AS key FROM documents
), s AS (SELECT source, sum(size)::DOUBLE AS ss FROM d GROUP BY source
), w AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source)) % 3 WHEN 1 THEN 3.0::DOUBLE WHEN 2 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, 2.0 * ss AS lim FROM s
), r AS (
  SELECT *, lim / weight AS ratio, row_number() OVER o AS k,
    ((sum(ss) OVER ()) * 1.5 - coalesce(sum(lim) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
  FROM w WINDOW o AS (ORDER BY lim / weight, source IS NULL, source)
), f AS (SELECT min(k) AS k FROM r WHERE lev <= ratio
), t AS (SELECT source, ss, CASE WHEN r.k < f.k THEN lim ELSE weight * (SELECT lev FROM r, f WHERE r.k = f.k) END AS target FROM r, f
), p AS (
  SELECT doc_id, size, ss, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), q AS (SELECT *, CASE WHEN ss = 0 THEN 0 ELSE floor(target / ss) END AS rounds FROM p)
SELECT doc_id, size::BIGINT AS size, ss::BIGINT AS source_size, target, (rounds * size + greatest(0, least(size, floor(target) - rounds * ss - place)))::BIGINT AS taken FROM q""",
    "op11_merkle": """
WITH RECURSIVE doc AS (
  SELECT doc_id, lang, source, text, n_chars, CASE WHEN crc % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS claim FROM (
    SELECT *, xor(list_reduce(flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: [unicode((doc_id::VARCHAR)[i])::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
      lambda c, x: xor(xor(c, x) >> 1, (xor(c, x) & 1) * 3988292384), 4294967295::BIGINT), 4294967295) AS crc FROM documents)
), said AS (
  SELECT doc_id, lang, n_chars, claim, concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-')) AS a,
    coalesce(strlen(text) || ':' || text, '-') AS b FROM doc
), hashed AS (
  SELECT doc_id, lang, sha256(concat(a, coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-'), b)) AS leaf, sha256(concat(a, coalesce(strlen(claim::VARCHAR) || ':' || claim, '-'), b)) AS claim FROM said
), leaf AS MATERIALIZED (
  SELECT *, coalesce('1' || lang, '0') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM hashed
), node AS (
  SELECT tree, 0 AS level, i, n, leaf AS h FROM leaf
  UNION ALL SELECT tree, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM node WHERE n > 1 GROUP BY tree, level, i // 2, n
), top AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM node WHERE n = 1
), above AS (
  SELECT 0 AS level, i, n, subroot AS h FROM top
  UNION ALL SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM above WHERE n > 1 GROUP BY level, i // 2, n
), step AS (
  SELECT l.doc_id, l.leaf, x.level, s.h AS sib, l.i >> x.level AS place FROM leaf l JOIN (SELECT DISTINCT tree, level, n FROM node WHERE n > 1) x ON x.tree = l.tree
    LEFT JOIN node s ON s.tree = l.tree AND s.level = x.level AND s.i = xor(l.i >> x.level, 1)
  UNION ALL SELECT l.doc_id, l.leaf, 1000 + x.level, s.h, t.i >> x.level FROM leaf l JOIN top t ON t.tree = l.tree, (SELECT DISTINCT level, n FROM above WHERE n > 1) x
    LEFT JOIN above s ON s.level = x.level AND s.i = xor(t.i >> x.level, 1)
), path AS (SELECT doc_id, leaf, list({'sib': sib, 'odd': place % 2 = 1} ORDER BY level) AS p FROM step GROUP BY doc_id, leaf
), folded AS (
  SELECT l.doc_id, l.leaf, p, 1 AS k, l.claim AS h FROM leaf l LEFT JOIN path ON path.doc_id IS NOT DISTINCT FROM l.doc_id AND path.leaf = l.leaf
  UNION ALL SELECT doc_id, leaf, p, k + 1, sha256(CASE WHEN p[k].odd THEN concat(p[k].sib, h) ELSE concat(h, p[k].sib) END) FROM folded WHERE k <= len(p)
)
SELECT f.doc_id, f.leaf, top.subroot, r.h AS root, sha256(coalesce(array_to_string(list_transform(p, lambda x: x.sib), ''), '')) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM folded f JOIN leaf l ON l.doc_id IS NOT DISTINCT FROM f.doc_id AND l.leaf = f.leaf JOIN top ON top.tree = l.tree, (SELECT h FROM above WHERE n = 1) r WHERE k = coalesce(len(p), 0) + 1""",
    "op13_prefix_trie": r"""
WITH turn AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS t,
    len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS words FROM conversations WHERE conv_id IS NOT NULL
), conv AS (
  SELECT conv_id, list(t ORDER BY turn NULLS FIRST, role, t) AS said, list(words ORDER BY turn NULLS FIRST, role, t) AS words,
    xor(list_reduce(flatten(list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: [unicode((conv_id::VARCHAR)[i])::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
      lambda c, x: xor(xor(c, x) >> 1, (xor(c, x) & 1) * 3988292384), 4294967295::BIGINT), 4294967295) % 4 AS h FROM turn GROUP BY conv_id
), built AS (
  SELECT c.conv_id, coalesce(b.said[1:c.h], []) || c.said[c.h + 1:] AS said, coalesce(b.words[1:c.h], []) || c.words[c.h + 1:] AS words
  FROM conv c LEFT JOIN conv b ON b.conv_id = c.conv_id - c.conv_id % 20
), prefix AS MATERIALIZED (
  SELECT conv_id, d AS depth, len(said) AS size, CASE WHEN d > 0 THEN words[d] ELSE 0 END AS words, md5(array_to_string(said[1:d], '')) || d AS node, CASE WHEN d > 0 THEN md5(array_to_string(said[1:d - 1], '')) || (d - 1) END AS up
  FROM (SELECT *, unnest(range(len(said) + 1)) AS d FROM built)
), node AS MATERIALIZED (
  SELECT node, any_value(up) AS up, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n, any_value(words) AS words, max(size) = min(depth) AS leaf,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE size = depth), '')) AS ends FROM prefix GROUP BY node
), below AS (
  SELECT a.node, sum((x.n - 1) * x.words) AS saved, count(*) FILTER (WHERE x.leaf) AS leaves FROM node x JOIN prefix a ON a.conv_id = x.conv_id AND a.depth <= x.depth GROUP BY a.node
), kids AS (SELECT up, count(*) AS n FROM node WHERE up IS NOT NULL GROUP BY up)
SELECT x.conv_id, x.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, x.n::BIGINT AS n_convs, coalesce(kids.n, 0)::BIGINT AS n_children, below.leaves::BIGINT AS n_leaves,
  below.saved::BIGINT AS saved_tokens, x.ends AS ends_sha256
FROM node x JOIN below USING (node) LEFT JOIN node p ON p.node = x.up LEFT JOIN kids ON kids.up = x.node""",
}
