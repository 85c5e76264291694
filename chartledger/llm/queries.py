"""The queries of this subpackage and the SQL that some of them are compared with."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartledger.llm import (
    chat,
    decontaminate,
    exact,
    language,
    mixing,
    neardup,
    negatives,
    prefix_trie,
    quality,
    secrets,
    token_counts,
    tokens,
    warc,
)
from chartledger.llm.common import read_table, text_or_empty

# Production weights of the mix: sources that are not listed have weight 1.
MIX_WEIGHTS = {"src0": 3.0, "src1": 2.0, "src2": 2.0}

ADVERSARIAL = "\\### Assistant: </turn> ok"


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"), MIX_WEIGHTS)
    return mixed.select(
        F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), "replica",
        F.col("copies"), "mix_key",
        F.md5(text_or_empty("row.text").cast("binary")).alias("text_md5"))


def op2_secret_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(read_table(spark, sf_dir, "documents"))


def op3_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_files(
        read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.quality_scores(
        spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return scored.drop("key")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        "contaminated")


def op6_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(read_table(spark, sf_dir, "pages"))


def op7_transducer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(
        read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_exact_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(read_table(spark, sf_dir, "documents"))


def op9_super_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_groups(read_table(spark, sf_dir, "documents")).drop("key")


def op10_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame(
        [(-7, 0, "user", ADVERSARIAL), (-7, 1, "assistant", ADVERSARIAL)], turns.schema)
    return chat.turn_digests(chat.read_back(chat.format_conversations(turns.unionByName(more))))


def op11_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(spark, read_table(spark, sf_dir, "documents"))


def op12_zone_map_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(
        F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(
            F.col("label")).alias("label"))
    return negatives.hard_negatives(vectors, F.col("vec_id") % 50 == 0)


def op13_parenthesis_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    return prefix_trie.conversation_trie(
        read_table(spark, sf_dir, "conversations"), conv - conv % 20,
        F.crc32(conv.cast("string").cast("binary")) % 4, 3)


QUERIES = {
    f.__name__: f for f in (
        op1_mix_sources, op2_secret_layers, op3_token_planes, op4_neighbour_quality,
        op5_decontaminate, op6_warc_salvage, op7_transducer_counts, op8_exact_blocks,
        op9_super_minhash, op10_chat_round_trip, op11_nearest_centroid,
        op12_zone_map_negatives, op13_parenthesis_trie,
    )
}


def _mix_sql() -> str:
    weight = "CASE " + " ".join(
        f"WHEN source = '{s}' THEN {w}" for s, w in sorted(MIX_WEIGHTS.items())) + " ELSE 1.0 END"
    unit = "CAST(CAST('0x' || substr(md5({}), 1, 13) AS BIGINT) AS DOUBLE)"
    ident = "coalesce(CAST(doc_id AS VARCHAR), 'null')"
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(text, '') AS body FROM documents),
s AS (SELECT source, CAST(sum(length(body) + 1) AS BIGINT) AS size,
             CAST({weight} AS DOUBLE) AS weight FROM d GROUP BY source),
r AS (SELECT source, weight / (SELECT sum(weight) FROM s) * 1.0
             * (SELECT CAST(sum(size) AS BIGINT) FROM s) / size AS rate FROM s),
m AS (SELECT source, greatest(1, CAST(ceil(rate / 8.0) AS INT)) AS pieces, rate FROM r),
c(source, k, p, cdf) AS (
  SELECT source, 0, exp(-(rate / pieces)), exp(-(rate / pieces)) FROM m
  UNION ALL
  SELECT c.source, c.k + 1, c.p * (m.rate / m.pieces) / (c.k + 1),
         c.cdf + c.p * (m.rate / m.pieces) / (c.k + 1)
  FROM c JOIN m ON c.source IS NOT DISTINCT FROM m.source WHERE c.k < 50),
u AS (
  SELECT d.doc_id, d.source, d.body, q.piece,
         {unit.format("concat_ws('|', 'mix', " + ident + ", CAST(q.piece AS VARCHAR))")}
           / {16 ** 13}.0 AS u
  FROM d JOIN m ON d.source IS NOT DISTINCT FROM m.source
  JOIN (SELECT unnest(range(1, 1000)) AS piece) q ON q.piece <= m.pieces),
n AS (
  SELECT u.doc_id, u.source, u.body, count(*) FILTER (WHERE c.cdf <= u.u) AS copies
  FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source GROUP BY ALL)
SELECT doc_id, source, CAST(g.replica AS INT) AS replica, CAST(copies AS INT) AS copies,
       CAST('0x' || substr(md5(concat_ws('|', 'mix', 'order', {ident},
            CAST(g.replica AS VARCHAR))), 1, 13) AS BIGINT) AS mix_key,
       md5(body) AS text_md5
FROM n JOIN (SELECT unnest(range(1, 10000)) AS replica) g ON g.replica <= n.copies
"""


_EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS body FROM documents)
WINDOW w AS (PARTITION BY body)
"""

_DECONTAMINATE_SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
i AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size,
         array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s
        FROM b WHERE len(w) > 0)),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS s FROM d),
h AS (
  SELECT p.doc_id, p.s, i.size, i.item_id
  FROM (SELECT DISTINCT size FROM i) z
  JOIN p ON p.s + z.size - 1 <= len(p.w)
  JOIN i ON i.size = z.size AND i.win = array_to_string(p.w[p.s:p.s + z.size - 1], ' ')),
hit AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + size)) AS place FROM h) GROUP BY doc_id),
it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(hit.n_hit, 0) AS n_hit,
       coalesce(it.n_items, 0) AS n_items, sha256(coalesce(it.items, '')) AS items_sha256,
       coalesce(hit.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""

_NEAR_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ')
         || CASE WHEN len(w) < 5 THEN ' <short>' ELSE '' END AS sh
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i
        FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (
  SELECT p.a, p.b FROM p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b
  WHERE 100 * p.c >= 75 * (na.n + nb.n - p.c)),
e AS (SELECT a AS x, b AS y FROM l UNION ALL SELECT b, a FROM l),
r(x, y) AS (
  SELECT doc_id, doc_id FROM n
  UNION
  SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
g AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles,
       coalesce(g.component_id, d.doc_id) AS component_id,
       d.doc_id = coalesce(g.component_id, d.doc_id) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN g ON g.x = d.doc_id
"""

_WARC_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS size
  FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest,
       CASE WHEN size >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END
         AS record_type,
       CASE WHEN size >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""

_ESCAPE = ("replace(replace(replace(replace({0}, '\\', '\\\\'), '</turn>', '<\\/turn>'), "
           "'### ', '#\\## '), ': ', ':\\ ')")
_CHAT_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS body
  FROM (SELECT conv_id, turn, role, text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '{ADVERSARIAL}'
        UNION ALL SELECT -7, 1, 'assistant', '{ADVERSARIAL}')),
e AS (
  SELECT *,
    contains(role, ': ') OR contains(role || body, '</turn>') OR contains(role, '### ')
    OR contains(body, '### ') OR regexp_replace(role, '\\\\(.)', '\\1', 'gs') <> role
    OR regexp_replace(body, '\\\\(.)', '\\1', 'gs') <> body AS clash
  FROM t),
f AS (
  SELECT *, 4 + 2 + 8 + CASE WHEN clash
    THEN length({_ESCAPE.format('role')}) + length({_ESCAPE.format('body')})
    ELSE length(role) + length(body) END AS chars FROM e),
c AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || body || chr(10), '' ORDER BY turn, role, body) AS told,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN body END, ''
             ORDER BY turn, role, body), '') AS loss,
    sum(chars) AS chars
  FROM f GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
FROM c
"""

_NEGATIVES_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id,
         CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id
                               ORDER BY s.score DESC, s.id) AS INT) AS rank,
       s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
  AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""

_TRIE_SQL = """
WITH o AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')}
    ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (
  -- head: the checksum that zlib calls crc32, of the id's decimal digits
  SELECT conv_id, own, conv_id - conv_id % 20 AS base, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(
      string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda crc, x: list_reduce(
      list_prepend(xor(crc, x), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]),
      lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v >> 1, CAST(3988292384 AS BIGINT))
                        ELSE v >> 1 END))) % 4 AS head
  FROM o),
r AS (
  SELECT h.conv_id, list_concat(coalesce(b.own[1:h.head], []), h.own[h.head + 1:]) AS path
  FROM h LEFT JOIN o b ON b.conv_id = h.base),
m AS (
  SELECT conv_id, len(path) AS len, d AS depth, path[1:d] AS node
  FROM (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS d FROM r)),
n AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)
      FILTER (WHERE len = depth), '')) AS ends_sha256
  FROM m GROUP BY node, depth),
k AS (SELECT node[1:depth - 1] AS up, count(*) AS n FROM n WHERE depth > 0 GROUP BY up),
t AS (
  SELECT n.*, coalesce(k.n, 0) AS n_children,
    CASE WHEN n.depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(
      node[n.depth].t, '[^\x20\x09-\x0D]+')) END AS saved
  FROM n LEFT JOIN k ON k.up = n.node),
u AS (
  SELECT node[1:d] AS top, sum(saved) AS saved_tokens,
         count(*) FILTER (WHERE n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM t) GROUP BY top)
SELECT t.conv_id, t.depth, p.conv_id AS parent_conv_id, t.n_convs, t.n_children, u.n_leaves,
       CAST(u.saved_tokens AS BIGINT) AS saved_tokens, t.ends_sha256
FROM t JOIN u ON u.top = t.node
LEFT JOIN t p ON t.depth > 0 AND p.depth = t.depth - 1 AND p.node = t.node[1:t.depth - 1]
"""

ORACLES = {
    "op1_mix_sources": _mix_sql(),
    "op5_decontaminate": _DECONTAMINATE_SQL,
    "op6_warc_salvage": _WARC_SQL,
    "op8_exact_blocks": _EXACT_SQL,
    "op9_super_minhash": _NEAR_SQL,
    "op10_chat_round_trip": _CHAT_SQL,
    "op12_zone_map_negatives": _NEGATIVES_SQL,
    "op13_parenthesis_trie": _TRIE_SQL,
}
