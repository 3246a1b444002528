"""The registered ``opN_`` queries and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pestle.llm import bpe, chat, decontaminate, exact_dedup, html_extract, near_dedup, pii, quality, sharding, warc
from pestle.llm.common import table


#: Parameters of the tools that :func:`tool_messages` calls: tool, parameter, type, required.
TOOL_SCHEMAS = [("lookup", "query", "string", True), ("lookup", "limit", "integer", False), ("count", "text", "string", True), ("note", None, None, None)]


def tool_messages(conversations: DataFrame) -> DataFrame:
    """Every row of ``conversations`` (its turn times 4), and tool messages derived from each.

    The table holds no tool messages, so each assistant row also makes a call ``c<turn>`` of a tool, and each
    user row results of the call that the next turn makes, if it makes one: in time, before their call,
    repeated, or of a call that nobody makes. The text's length n chooses: n % 4 the tool (one of them in no
    schema), n % 5 the arguments (right, of a wrong type, missing, not in the schema, no object), n % 6 the
    results.
    """
    t, x = F.col("turn"), F.coalesce("text", F.lit(""))
    n = F.length(x)
    whole = F.to_json(F.struct(x.alias("q")))
    quoted = F.substr(whole, F.lit(6), F.length(whole) - 6)
    choose = lambda k, *values: F.element_at(F.array(*(v if not isinstance(v, str) else F.lit(v) for v in values)), (n % k + 1).cast("int"))
    tool = choose(4, "lookup", "count", "note", "other")
    arguments = choose(
        5, F.concat(F.lit('{"query": '), quoted, F.lit(', "limit": '), n.cast("string"), F.lit("}")), F.concat(F.lit('{"limit": "'), n.cast("string"), F.lit('"}')),
        F.concat(F.lit('{"text": '), quoted, F.lit(', "query": '), quoted, F.lit(', "extra": true}')), '"plain"', F.concat(F.lit('{"text": '), quoted, F.lit("}")),
    )
    call = F.concat(F.lit('{ "tool_calls": [ { "name": "'), tool, F.lit('", "id": "c'), t.cast("string"), F.lit('", "arguments": '), arguments, F.lit("} ] }"))
    named = F.when(n % 6 == 3, F.concat(F.lit("x"), t.cast("string"))).otherwise(F.concat(F.lit("c"), (t + 1).cast("string")))
    result = F.concat(F.lit('{ "tool_call_id": "'), named, F.lit('", "content": '), quoted, F.lit("}"))
    turns = F.array_compact(F.array(F.when((n % 6).isin(0, 3, 4), 2), F.when((n % 6).isin(1, 2, 4), 6), F.when(n % 6 == 2, 7)))
    message = lambda turn, role, text: F.struct(turn.cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    own = F.array(message(t * 4, F.col("role"), F.col("text")))
    calls = F.when(F.col("role") == "assistant", F.array(message(t * 4 + 1, F.lit("assistant"), call)))
    results = F.when(F.col("role") == "user", F.transform(turns, lambda k: message(t * 4 + k, F.lit("tool"), result)))
    none = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    return conversations.select("conv_id", F.inline(F.concat(own, F.coalesce(calls, none), F.coalesce(results, none))))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    schemas = spark.createDataFrame(TOOL_SCHEMAS, "tool string, param string, type string, required boolean")
    return chat.format_chat(tool_messages(table(spark, sf_dir, "conversations")), schemas)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), quality.trusted_ids(table(spark, sf_dir, "labels")))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pii_spans(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    digest = F.sha2(pii.joined_spans(base).cast("binary"), 256).alias("base_sha256")
    more = pii.KINDS[len(pii.BASE) :]
    return found.select("doc_id", *map(count, pii.BASE), digest, pii.joined_spans(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"), *map(count, more))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near"),
        F.array_join("near_items", ",").alias("near_items"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("hit_spans"),
    )


def op5_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op7_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.bpe_encode(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"), size=2)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_pages(table(spark, sf_dir, "pages"))
    return records.select(
        F.col("record_id").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extract_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


OP6_SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS len,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm ORDER BY len DESC, doc_id)
"""

OP1_SQL = """
WITH b AS (SELECT conv_id, turn AS t, role, text, to_json(coalesce(text, '')) AS q, length(coalesce(text, '')) AS n FROM conversations),
given(k, param, got) AS (VALUES (0, 'query', 'string'), (0, 'limit', 'integer'), (1, 'limit', 'string'), (2, 'text', 'string'), (2, 'query', 'string'), (2, 'extra', 'boolean'), (4, 'text', 'string')),
tools(tool) AS (VALUES ('lookup'), ('count'), ('note')),
params(tool, param, type, required) AS (VALUES ('lookup', 'query', 'string', true), ('lookup', 'limit', 'integer', false), ('count', 'text', 'string', true)),
c AS (SELECT conv_id, t, 4 * t + 1 AS turn, 'c' || t AS id, ['lookup', 'count', 'note', 'other'][n % 4 + 1] AS tool, n % 5 AS k, n, q FROM b WHERE role = 'assistant'),
e AS (SELECT conv_id, t, 'arguments: not an object' AS error FROM c WHERE k = 3
      UNION ALL SELECT conv_id, t, 'tool: unknown ' || tool FROM c WHERE tool NOT IN (SELECT tool FROM tools)
      UNION ALL SELECT conv_id, t, CASE WHEN p.type IS NULL THEN g.param || ': not in the schema' ELSE g.param || ': not of type ' || p.type END
                FROM c JOIN tools USING (tool) JOIN given g USING (k) LEFT JOIN params p ON p.tool = c.tool AND p.param = g.param WHERE p.type IS NULL OR p.type <> g.got
      UNION ALL SELECT conv_id, t, p.param || ': missing' FROM c JOIN params p ON p.tool = c.tool AND p.required WHERE k <> 3 AND NOT EXISTS (SELECT 1 FROM given g WHERE g.k = c.k AND g.param = p.param)),
errs AS (SELECT conv_id, t, list(error ORDER BY error) AS errors FROM e GROUP BY conv_id, t),
r AS (SELECT conv_id, t, 4 * t + unnest(CASE n % 6 WHEN 0 THEN [2] WHEN 1 THEN [6] WHEN 2 THEN [6, 7] WHEN 3 THEN [2] WHEN 4 THEN [2, 6] ELSE [] END) AS turn, CASE WHEN n % 6 = 3 THEN 'x' || t ELSE 'c' || (t + 1) END AS id, q FROM b WHERE role = 'user'),
l AS (SELECT r.*, c.turn AS call_turn, row_number() OVER (PARTITION BY r.conv_id, r.id ORDER BY r.turn) AS nth FROM r LEFT JOIN c USING (conv_id, id)),
m AS (SELECT conv_id, 4 * t AS turn, role, text, 0 AS n_calls, NULL::VARCHAR AS call_id, NULL::VARCHAR AS link, NULL::BIGINT AS call_turn, []::VARCHAR[] AS errors, '{"content":' || to_json(text) || ',"role":' || to_json(role) || '}' AS json FROM b
      UNION ALL
      SELECT conv_id, c.turn, 'assistant', '{ "tool_calls": [ { "name": "' || tool || '", "id": "' || id || '", "arguments": ' ||
             CASE k WHEN 0 THEN '{"query": ' || q || ', "limit": ' || n || '}' WHEN 1 THEN '{"limit": "' || n || '"}' WHEN 2 THEN '{"text": ' || q || ', "query": ' || q || ', "extra": true}' WHEN 3 THEN '"plain"' ELSE '{"text": ' || q || '}' END || '} ] }',
             1, NULL, CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.conv_id = c.conv_id AND r.id = c.id) THEN 'answered' ELSE 'open' END, NULL, coalesce(errors, []),
             '{"message":{"tool_calls":[{"arguments":' ||
             CASE k WHEN 0 THEN '{"limit":' || n || ',"query":' || q || '}' WHEN 1 THEN '{"limit":"' || n || '"}' WHEN 2 THEN '{"extra":true,"query":' || q || ',"text":' || q || '}' WHEN 3 THEN '"plain"' ELSE '{"text":' || q || '}' END ||
             ',"id":"' || id || '","name":"' || tool || '"}]},"role":"assistant"}'
      FROM c LEFT JOIN errs USING (conv_id, t)
      UNION ALL
      SELECT conv_id, turn, 'tool', '{ "tool_call_id": "' || id || '", "content": ' || q || '}', 0, id, CASE WHEN call_turn IS NULL THEN 'orphan' WHEN nth = 1 THEN 'linked' ELSE 'repeated' END, call_turn, [],
             '{"message":{"content":' || q || ',"tool_call_id":"' || id || '"},"role":"tool"}' FROM l)
SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN call_turn >= turn THEN call_turn ELSE turn END, coalesce(call_turn >= turn, false), role, text) - 1 AS position,
       n_calls::BIGINT AS n_calls, call_id, link, call_turn, len(errors) AS n_errors, errors, json
FROM m
"""

OP9_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
     q AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes < 100 OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes < 100 OR page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM q
"""

OP4_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS key FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
pos AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS key FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, pos.n, i FROM pos JOIN win USING (n, key)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hit GROUP BY doc_id),
isle AS (SELECT doc_id, min(p) AS a, max(p) + 1 AS z FROM (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS g FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) - 1 AS p FROM hit)) GROUP BY doc_id, g),
spans AS (SELECT doc_id, string_agg(a || ':' || z, ',' ORDER BY a) AS hit_spans FROM isle GROUP BY doc_id),
vocabulary AS (SELECT DISTINCT unnest(w) AS word FROM bw),
places AS (SELECT doc_id, p - 1 AS p, w[p] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM dw) WHERE w[p] IN (SELECT word FROM vocabulary)),
freq AS (SELECT word, count(*) AS f FROM places GROUP BY word),
lens AS (SELECT doc_id, len(w) AS n FROM dw),
terms AS (SELECT key, o, string_split(key, ' ')[o + 1] AS word FROM (SELECT DISTINCT key, unnest(range(0, n)) AS o FROM win)),
firsts AS (SELECT key, word, min(o) AS o FROM terms GROUP BY key, word),
picked AS (SELECT key, word, o, row_number() OVER (PARTITION BY key ORDER BY coalesce(f, 0), o) AS r FROM firsts LEFT JOIN freq USING (word)),
anchor AS (SELECT key, doc_id, p - o AS start, p FROM picked JOIN places USING (word) WHERE r = 1),
wanted AS (SELECT key, doc_id, start, p, word, start + o AS want, r FROM anchor JOIN picked USING (key) WHERE r BETWEEN 2 AND 4),
met AS (SELECT key, doc_id, start, wanted.p, r FROM wanted JOIN places USING (doc_id, word) WHERE abs(places.p - want) <= 5 GROUP BY ALL),
near AS (SELECT key, doc_id FROM anchor LEFT JOIN (SELECT key, doc_id, start, p, count(*) AS c FROM met GROUP BY ALL) USING (key, doc_id, start, p) JOIN (SELECT key, least(count(*), 4) - 1 AS need FROM picked GROUP BY key) USING (key) WHERE coalesce(c, 0) = need),
close_by AS (SELECT doc_id, item_id::VARCHAR AS item FROM near JOIN (SELECT DISTINCT key, item_id FROM win) USING (key) UNION SELECT doc_id, item_id::VARCHAR FROM hit),
nearby AS (SELECT doc_id, count(*) AS n_near, string_agg(item, ',' ORDER BY item) AS near_items FROM close_by GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       coalesce(n_near, 0) AS n_near, coalesce(near_items, '') AS near_items, coalesce(hit_spans, '') AS hit_spans
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN nearby USING (doc_id) LEFT JOIN spans USING (doc_id)
"""

OP5_SQL = r"""
WITH b(k) AS (SELECT unnest(range(256))),
t AS (SELECT list(list_reduce(list_concat([k], range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY k) AS t FROM b),
d AS (SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
x AS (SELECT doc_id, n, hex(encode(text)) AS h FROM d),
c AS (SELECT doc_id, n + 8 AS size, xor(list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(h, '..'), lambda y: ('0x' || y)::BIGINT)), lambda c, v: xor(t[(xor(c, v) & 255) + 1], c >> 8)), 4294967295) AS text_crc32 FROM x, t),
p AS (SELECT doc_id, size, text_crc32, sum(size) OVER (ORDER BY doc_id, size, text_crc32 ROWS UNBOUNDED PRECEDING) - size AS start, sum(size) OVER () AS total FROM c),
s AS (SELECT doc_id, size, text_crc32, start, CAST(least(23, ((2 * start + size) * 24) // (2 * total)) AS INTEGER) AS shard FROM p)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY start) - 1 AS slot, NULL::INTEGER AS grown_shard FROM s
"""

OP8_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT doc_id, list(s ORDER BY s) AS k, any_value(n.n) AS n FROM s JOIN n USING (doc_id) GROUP BY doc_id),
rare AS (SELECT s, count(*) AS df FROM s GROUP BY s),
ranked AS (SELECT doc_id, s, n, row_number() OVER (PARTITION BY doc_id ORDER BY df, s) AS r FROM s JOIN n USING (doc_id) JOIN rare USING (s)),
prefix AS (SELECT doc_id, s FROM ranked WHERE r <= n - ceil(0.8 * n) + 1),
cand AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM prefix a JOIN prefix b ON a.s = b.s AND a.doc_id < b.doc_id),
i AS (SELECT a, b, count(*) AS c FROM cand JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND y.s = x.s GROUP BY a, b),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(id, m) AS (SELECT DISTINCT a, a FROM l UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.id WHERE r.m < l.b),
m AS (SELECT id, min(m) AS m FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.m, d.doc_id) AS component_id, d.doc_id = coalesce(m.m, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.id = d.doc_id
"""

QUERIES = {f.__name__: f for f in (op1_chat_format, op2_quality, op3_pii, op4_decontaminate, op5_byte_shards, op6_exact_dedup, op7_bpe_tree, op8_minhash, op9_warc, op10_html_text)}
ORACLES = {
    "op1_chat_format": OP1_SQL,
    "op4_decontaminate": OP4_SQL,
    "op5_byte_shards": OP5_SQL,
    "op6_exact_dedup": OP6_SQL,
    "op8_minhash": OP8_SQL,
    "op9_warc": OP9_SQL,
}
