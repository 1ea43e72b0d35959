"""The registered queries of the operators: whole tables in, digest columns out."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import (
    blocks, divergence, html, lines, metricjoin, packing, ring, setjoin, topk, toxicity, trie, unigram, winnow)
from strata.llm.frames import importable

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the function under its name, with its SQL twin where there is one."""

    def register(function):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            importable(spark)
            return function(lambda table: spark.read.parquet(f"{folder}/{table}.parquet"))

        QUERIES[function.__name__] = run
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


# The rule on lines themselves, without hashes.
OP1_SQL = """
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS nr FROM cut),
keyed AS (SELECT doc_id, line, nr, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line),
common AS (SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 20 GROUP BY key
    HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.last_doc AS gone FROM keyed k LEFT JOIN common c USING (key))
SELECT doc_id, count(*) AS n_lines, count_if(gone)::BIGINT AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY nr) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

# Links made transitive: the smallest id that each one reaches.
CLOSURE = """
both_ways AS (SELECT u, v FROM link UNION SELECT v, u FROM link),
reach(node, seen) AS (SELECT u, v FROM both_ways UNION SELECT r.node, b.v FROM reach r JOIN both_ways b ON r.seen = b.u),
root AS (SELECT node, least(node, min(seen)) AS component_id FROM reach GROUP BY node)"""

OP4_SQL = """
WITH RECURSIVE good AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b ON a.vec_id < b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.9),""" + CLOSURE + """,
counted AS (SELECT u, count(*) AS n FROM both_ways GROUP BY u)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, coalesce(r.component_id, e.vec_id) AS component_id,
    coalesce(r.component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN counted c ON c.u = e.vec_id LEFT JOIN root r ON r.node = e.vec_id
"""

OP8_SQL = """
WITH whole AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM whole q JOIN whole c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""

OP10_SQL = """
WITH RECURSIVE word AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingle AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5
    THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS x FROM word),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM shingle a JOIN shingle b ON a.x = b.x AND a.doc_id < b.doc_id
    GROUP BY ALL),
link AS (SELECT u, v FROM common JOIN size a ON a.doc_id = u JOIN size b ON b.doc_id = v WHERE 100 * k >= 75 * (a.n + b.n - k)),""" + CLOSURE + """
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(r.component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN size s USING (doc_id) LEFT JOIN root r ON r.node = d.doc_id
"""

# The unsigned CRC-32 of the decimal conv_id, bit by bit.
OP12_SQL = """
WITH turn AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
    md5(length(role)::VARCHAR || ':' || role || text)) - 1 AS place FROM turn),
headed AS (SELECT DISTINCT conv_id, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda sum, c: list_reduce(list_prepend(xor(sum, c), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
        lambda s, z: xor(s >> 1, 3988292384 * (s & 1))))) % 6 AS head FROM placed),
line AS (SELECT h.conv_id, 0 AS part, p.place, p.role, p.text FROM headed h JOIN placed p
        ON p.conv_id = h.conv_id - h.conv_id % 100 AND p.place < h.head
    UNION ALL SELECT h.conv_id, 1, p.place, p.role, p.text FROM headed h JOIN placed p ON p.conv_id = h.conv_id AND p.place >= h.head),
whole AS (SELECT h.conv_id, coalesce(list({'role': l.role, 'text': l.text} ORDER BY l.part, l.place) FILTER (l.part IS NOT NULL), []) AS turns
    FROM headed h LEFT JOIN line l USING (conv_id) GROUP BY h.conv_id),
prefix AS (SELECT conv_id, d, turns[1:d] AS name, len(turns) = d AS ends FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM whole)),
node AS (SELECT d, name, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ids FROM prefix GROUP BY d, name),
child AS (SELECT d - 1 AS d, name[1:d - 1] AS name, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL),
full_node AS (SELECT n.*, p.conv_id AS parent_conv_id, coalesce(c.n_children, 0) AS n_children
    FROM node n LEFT JOIN node p ON n.d > 0 AND p.d = n.d - 1 AND p.name = n.name[1:n.d - 1]
    LEFT JOIN child c ON c.d = n.d AND c.name = n.name),
subtree AS (SELECT a.d, a.conv_id, count_if(b.n_children = 0) AS n_leaves,
    sum(CASE WHEN b.d = 0 THEN 0 ELSE (b.n_convs - 1) * length(b.name[b.d].text) END) AS saved
    FROM full_node a JOIN full_node b ON b.d >= a.d AND b.name[1:a.d] = a.name GROUP BY a.d, a.conv_id)
SELECT n.conv_id, n.d::BIGINT AS depth, n.parent_conv_id, n.n_convs, n.n_children, s.n_leaves::BIGINT AS n_leaves,
    s.saved::BIGINT AS saved_tokens, sha256(n.ids) AS ends_sha256
FROM full_node n JOIN subtree s USING (d, conv_id)
"""

OP13_SQL = """
WITH doc AS (SELECT row_number() OVER () AS nr, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
word AS (SELECT nr, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM doc),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM word GROUP BY ALL HAVING count(DISTINCT nr) >= 3),
counted AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM word GROUP BY ALL),
lang_size AS (SELECT lang, count(*)::HUGEINT AS v, sum(n) AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM doc),
total AS (SELECT lang, source, sum(c.n) AS total FROM counted c JOIN kept USING (lang, term) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(t.total, 0) + s.v) AS p,
    1 + (1000000000::HUGEINT * (k.n + 1)) // (s.total + s.v) AS lang_p
    FROM groups g JOIN kept k USING (lang) JOIN lang_size s USING (lang)
    LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
    LEFT JOIN total t ON t.lang = g.lang AND t.source = g.source),
distance AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(d.value, 0)::BIGINT AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN distance d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source),
term AS (SELECT lang, source, term AS item, (((p - lang_p) * (p - lang_p)) // lang_p)::BIGINT AS value FROM p WHERE n > 0 AND p > lang_p),
every AS (SELECT *, 'pair' AS part FROM pair UNION ALL SELECT *, 'term' FROM term)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM every QUALIFY part = 'pair' OR rank <= 200
"""


@query()
def op9_token_blocks(table) -> DataFrame:
    return blocks.checksums(blocks.token_files(table("documents"), WORD_BPE))


@query()
def op3_packing(table) -> DataFrame:
    return packing.pack(table("documents"), WORD_BPE)


@query(OP4_SQL)
def op4_vector_links(table) -> DataFrame:
    return metricjoin.linked(table("embeddings"))


@query()
def op6_ring_shards(table) -> DataFrame:
    return ring.shard(table("documents"), 8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query(OP8_SQL)
def op8_top_k(table) -> DataFrame:
    return topk.search(table("embeddings"), F.col("vec_id") % 100 == 0)


@query(OP10_SQL)
def op10_shingle_groups(table) -> DataFrame:
    return setjoin.grouped(table("documents"))


@query(OP1_SQL)
def op1_line_dedup(table) -> DataFrame:
    return lines.kept(table("documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


@query()
def op2_toxicity(table) -> DataFrame:
    docs = table("documents")
    model = toxicity.fit(docs, table("labels"), ~held_out())
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), "score", "predicted")


@query()
def op5_main_text(table) -> DataFrame:
    return html.extracted(table("pages"))


@query()
def op7_pieces(table) -> DataFrame:
    return unigram.round_trips(table("documents"), PIECE_MODEL)


@query()
def op11_fingerprints(table) -> DataFrame:
    return winnow.neighbours(table("documents")).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.lower(F.hex("entries")).alias("fingerprint"),
        F.lower(F.hex("edited_entries")).alias("edited_fingerprint"), "near_edited", "near_next")


@query(OP12_SQL)
def op12_prefix_trie(table) -> DataFrame:
    return trie.trie(table("conversations"))


@query(OP13_SQL)
def op13_source_divergence(table) -> DataFrame:
    return divergence.audit(table("documents"))
