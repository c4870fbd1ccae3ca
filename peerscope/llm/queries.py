"""The registered queries of the operators: each applies its operator to the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op3_bpe_codec")
def bpe_codec(spark, sf_dir):
    from .bpe_codec import encode

    rows = encode(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op8_token_counts")
def token_counts(spark, sf_dir):
    from .token_count import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


@query("op9_token_files")
def token_files(spark, sf_dir):
    from .token_files import token_ids

    rows = token_ids(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LINE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM d),
k AS (SELECT *, {LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.pos, k.line, r.key IS NOT NULL AND k.doc_id <> r.last AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@query("op4_line_dedup", LINE_SQL)
def line_dedup(spark, sf_dir):
    from .line_dedup import drop_lines

    return drop_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


CONTAMINATION_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
g AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
o AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
h AS (SELECT DISTINCT doc_id, i, n, item FROM o JOIN g USING (gram, n)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""


@query("op5_decontamination", CONTAMINATION_SQL)
def decontamination(spark, sf_dir):
    from .decontamination import contamination

    rows = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                       F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


NEAR_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
k AS (SELECT a, b, shared = m.n AND shared = o.n AS equal FROM p JOIN n m ON m.doc_id = a JOIN n o ON o.doc_id = b WHERE 100 * shared >= 75 * (m.n + o.n - shared)),
l AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a),
e AS (SELECT b AS doc_id, min(a) AS first FROM k WHERE equal GROUP BY b)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(e.first, c.doc_id) AS class_id, component_id, c.doc_id = component_id AS kept
FROM c LEFT JOIN n ON n.doc_id = c.doc_id LEFT JOIN e ON e.doc_id = c.doc_id
"""


@query("op6_minhash_dedup", NEAR_SQL)
def minhash_dedup(spark, sf_dir):
    from .minhash_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "class_id", "component_id", "kept")


@query("op2_quality_classifier")
def quality_classifier(spark, sf_dir):
    from .quality_classifier import quality_scores, train

    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, train(docs, table(spark, sf_dir, "labels")))


VECTOR_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
ok AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(e, lambda x: abs(x))) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.93 ELSE false END),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT c.a AS vec_id, coalesce(n.n, 0) AS n_links, component_id, c.a = component_id AS kept FROM c LEFT JOIN n ON n.a = c.a
"""


@query("op1_embedding_dedup", VECTOR_SQL)
def embedding_dedup(spark, sf_dir):
    from .embedding_dedup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


#: From starts (doc_id, i) of removed windows of a width: the maximal runs (doc_id, a, z), half open; then what lies between them.
RUNS_SQL = """
k AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {width}, true) AS new FROM gone),
q AS (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM k),
runs AS (SELECT doc_id, min(i) AS a, max(i) + {width} AS z FROM q GROUP BY doc_id, run),
tot AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id),
keep AS (SELECT doc_id, lag(z, 1, 1) OVER (PARTITION BY doc_id ORDER BY a) AS a, a AS z FROM runs UNION ALL
  SELECT d.doc_id, coalesce((SELECT max(z) FROM runs WHERE runs.doc_id = d.doc_id), 1), d.n + 1 FROM d)"""

WORDS_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, len(w) AS n FROM documents),
o AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, n - 18)) AS i FROM d WHERE n >= 20)),
gone AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM o) WHERE k > 1),""" + RUNS_SQL.format(width=20) + """,
t AS (SELECT keep.doc_id, string_agg(array_to_string(w[a:z - 1], ' '), ' ' ORDER BY a) AS kept FROM keep JOIN d ON d.doc_id = keep.doc_id WHERE z > a GROUP BY keep.doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN tot ON tot.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""

BYTES_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, length(h) // 2 AS n FROM documents),
o AS (SELECT doc_id, i, substr(h, 2 * i - 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(1, n - 48)) AS i FROM d WHERE n >= 50)),
gone AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM o) WHERE first < doc_id),""" + RUNS_SQL.format(width=50) + """,
t AS (SELECT keep.doc_id, string_agg(substr(h, 2 * a - 1, 2 * (z - a)), '' ORDER BY a) AS kept FROM keep JOIN d ON d.doc_id = keep.doc_id WHERE z > a GROUP BY keep.doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN tot ON tot.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""


@query("op7_fm_substring", WORDS_SQL)
def fm_substring(spark, sf_dir):
    from .fm_substring import drop_repeated_words

    return drop_repeated_words(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op10_suffix_dedup", BYTES_SQL)
def suffix_dedup(spark, sf_dir):
    from .suffix_dedup import drop_repeated_bytes

    return drop_repeated_bytes(table(spark, sf_dir, "documents")).select("doc_id", F.col("n").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op11_piece_codec")
def piece_codec(spark, sf_dir):
    from .piece_codec import encode

    rows = encode(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))
    return rows.select("doc_id", "n_tokens", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


#: crc32 of the decimal digits of conv_id, bit by bit.
CRC_SQL = """xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
  lambda a, x: xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384)), 4294967295)"""

TRIE_SQL = f"""
WITH o AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) - 1 AS pos, k, strlen(text) AS size FROM (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS first, h, count(*) AS n FROM (SELECT conv_id, {CRC_SQL} % 9 AS h FROM o) GROUP BY ALL),
m AS (SELECT c.*, least(c.h, coalesce(f.n, 0)) AS k FROM c LEFT JOIN c f ON f.conv_id = c.first),
r AS (SELECT m.conv_id, o.pos, o.k, o.size FROM m JOIN o ON o.conv_id = m.first AND o.pos < m.h
  UNION ALL SELECT m.conv_id, o.pos - m.h + m.k, o.k, o.size FROM m JOIN o ON o.conv_id = m.conv_id AND o.pos >= m.h),
p AS (SELECT conv_id, pos + 1 AS depth, size, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY pos) AS path FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM m),
e AS (SELECT conv_id, depth = max(depth) OVER (PARTITION BY conv_id) AS ends, depth, size, path FROM p),
n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(size) AS saved, sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM e GROUP BY path, depth),
k AS (SELECT left(path, 32 * (depth - 1)) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
a AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON k.path = n.path),
t AS (SELECT up AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT unnest(list_transform(range(0, depth + 1), lambda d: left(path, 32 * d))) AS up, n_children, saved FROM a) GROUP BY up)
SELECT a.conv_id, CAST(a.depth AS BIGINT) AS depth, b.conv_id AS parent_conv_id, a.n_convs, a.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, a.ends_sha256
FROM a JOIN t ON t.path = a.path LEFT JOIN a b ON a.depth > 0 AND b.path = left(a.path, 32 * (a.depth - 1))
"""


@query("op12_prefix_trie", TRIE_SQL)
def prefix_trie(spark, sf_dir):
    from .prefix_trie import grafted, ordered_turns, prefix_nodes

    return prefix_nodes(*grafted(ordered_turns(table(spark, sf_dir, "conversations"))))


SEARCH_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS d, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (SELECT item_id, row_number() OVER () AS i, unnest(regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM benchmark),
q AS (SELECT item_id, i, t, count(*) AS times FROM i GROUP BY ALL),
s AS (SELECT count(*) AS nn, sum(len(w)) AS ll FROM d WHERE len(w) > 0),
tf AS (SELECT d, t, count(*) AS tf FROM (SELECT d, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
df AS (SELECT t, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, s GROUP BY t, nn),
m AS (SELECT d, doc_id, 25 + (75 * len(w) * nn) // CAST(ll AS BIGINT) AS m FROM d, s),
c AS (SELECT q.item_id, q.i, m.doc_id, m.d, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN tf ON tf.t = q.t JOIN df ON df.t = q.t JOIN m ON m.d = tf.d GROUP BY ALL)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM c WHERE score > 0) WHERE rank <= 10
"""


@query("op13_lexical_search", SEARCH_SQL)
def lexical_search(spark, sf_dir):
    from .lexical_search import ranked

    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
