"""The queries of this subpackage by name, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.ann import nearest_neighbours
from tidemark.llm.decontaminate import contamination
from tidemark.llm.fixity import audit, hashed, placed, warc_records
from tidemark.llm.langid import language_id
from tidemark.llm.licenses import license_report
from tidemark.llm.near_duplicates import near_duplicates
from tidemark.llm.packing import pack_documents
from tidemark.llm.pii import personal_data_digest
from tidemark.llm.quality import RULES, STOP_WORDS, quality
from tidemark.llm.resampling import resampled
from tidemark.llm.token_store import read_tokens, write_tokens
from tidemark.llm.tool_calls import REPLY_SCHEMA, conversation_calls, link_tool_calls
from tidemark.llm.vector_codes import vector_codes
from tidemark.plans.staging import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_table(spark, sf_dir, "documents"))


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.where("vec_id % 20 = 0"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(_table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits the pages' WARC files against a replica in which known records are damaged: of
    97 pages one has its last byte turned, one is lost, and one is stored where the first has
    nothing."""
    pages = _table(spark, sf_dir, "pages")
    records = warc_records(pages)
    turned = F.concat(F.substring("record", F.lit(1), F.length("record") - 1), F.lit(b"\x00"))
    damaged = records.withColumn("record", F.when(F.expr("page_id % 97 = 0"), turned).otherwise(F.col("record")))
    replica = placed(hashed(damaged)).where("page_id % 97 <> 1").withColumn("offset", F.expr("if(page_id % 97 = 2, offset + 1, offset)"))
    return audit(placed(hashed(records)), replica)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), words=4)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data_digest(_table(spark, sf_dir, "documents"))


def op9_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that the conversations imply, of which known ones are damaged: by the conversation's
    number modulo 11, arguments of a wrong type (1), an absent one (2), broken JSON (3), an unknown
    tool (4), doubled calls (5), calls that follow themselves (6), lost (7) and doubled results (8)."""
    calls, results = conversation_calls(_table(spark, sf_dir, "conversations"))
    kind, turn = F.col("conv_id") % 11, F.split_part("call_id", F.lit(":"), F.lit(-1)).cast("long")
    text = F.get_json_object("arguments", "$.text")
    arguments = (
        F.when(kind == 1, F.to_json(F.struct(text.alias("text"), turn.cast("string").alias("turn"))))
        .when(kind == 2, F.to_json(F.struct(turn.alias("turn"))))
        .when(kind == 3, F.expr("left(arguments, length(arguments) - 1)"))
        .otherwise(F.col("arguments"))
    )
    calls = calls.withColumns({"arguments": arguments, "name": F.when(kind == 4, "answer").otherwise(F.col("name")), "parent_id": F.when(kind == 6, F.col("call_id")).otherwise(F.col("parent_id"))})
    results = results.where(kind != 7)
    calls, results = calls.unionByName(calls.where(kind == 5)), results.unionByName(results.where(kind == 8))
    return link_tool_calls(calls, results, REPLY_SCHEMA).withColumn("problems", F.array_join("problems", ","))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_tokens(_table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(_table(spark, sf_dir, "embeddings"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base columns, failed (the failed rules' names, comma-joined) and kept."""
    told = quality(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return told.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.array_join("failed", ",").alias("failed"), "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_pack": op2_pack,
    "op3_neighbours": op3_neighbours,
    "op4_licenses": op4_licenses,
    "op5_decontaminate": op5_decontaminate,
    "op6_fixity": op6_fixity,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_pii": op8_pii,
    "op9_tool_calls": op9_tool_calls,
    "op10_token_store": op10_token_store,
    "op11_vector_codes": op11_vector_codes,
    "op12_resampling": op12_resampling,
    "op13_quality": op13_quality,
}



def _failed_sql() -> str:
    """The table of rules as SQL: the names of those that fail, comma-joined."""
    sides = [(r.name, r.metric, [f"{r.metric} >= {r.least}"] * (r.least is not None) + [f"{r.metric} <= {r.most}"] * (r.most is not None)) for r in RULES]
    return "concat_ws(',', " + ", ".join(f"CASE WHEN NOT ({' AND '.join(inside)}) THEN '{name}' END" for name, _, inside in sides) + ")"


_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op5_decontaminate": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
 b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_FOLDED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
 s AS (SELECT item, w, least(13, len(w)) AS m FROM b WHERE len(w) > 0),
 p AS (SELECT DISTINCT item, m, array_to_string(w[i + 1 : i + m], ' ') AS said FROM (SELECT *, unnest(range(0, len(w) - m + 1)) AS i FROM s)),
 q AS (SELECT doc_id, i, m, array_to_string(w[i + 1 : i + m], ' ') AS said FROM (SELECT *, unnest(range(0, len(w) - m + 1)) AS i FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)),
 h AS (SELECT q.doc_id, q.i, q.m, p.item FROM q JOIN p USING (m, said)),
 n AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM h) GROUP BY doc_id),
 t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS said FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(said, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op7_near_duplicates": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 4], ' ') AS said FROM (SELECT *, unnest(range(0, greatest(1, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.said = b.said AND a.doc_id < b.doc_id GROUP BY ALL),
 e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
 u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
 r(id, root) AS (SELECT x, x FROM u UNION SELECT r.id, u.y FROM r JOIN u ON u.x = r.root),
 m AS (SELECT id, min(root) AS c FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id, coalesce(m.c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.id = d.doc_id""",
    "op6_fixity": """
WITH r AS (SELECT page_id // 1000 AS file, page_id, strlen(E'WARC/1.0\\r\\nWARC-Type: resource\\r\\nWARC-Record-ID: <urn:page:' || page_id || E'>\\r\\nWARC-Target-URI: ' || coalesce(url, '')
    || E'\\r\\nContent-Type: text/html\\r\\nContent-Length: ' || strlen(coalesce(html, '')) || E'\\r\\n\\r\\n') + strlen(coalesce(html, '')) + 4 AS length FROM pages),
 p AS (SELECT *, (sum(length) OVER (PARTITION BY file ORDER BY page_id ROWS UNBOUNDED PRECEDING) - length)::BIGINT AS place FROM r)
SELECT file, place AS "offset", length AS first_length, length AS second_length, 'changed' AS damage FROM p WHERE page_id % 97 = 0
UNION ALL SELECT file, place, length, NULL, 'missing' FROM p WHERE page_id % 97 IN (1, 2)
UNION ALL SELECT file, place + 1, NULL, length, 'extra' FROM p WHERE page_id % 97 = 2""",
    "op9_tool_calls": """
WITH c AS (SELECT conv_id, conv_id % 11 AS kind, turn, text, conv_id || ':' || turn AS call_id, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS island FROM conversations WHERE role = 'user'),
 d AS (SELECT *, CASE WHEN kind <> 6 THEN row_number() OVER (PARTITION BY conv_id, turn % 2, island ORDER BY turn) - 1 END AS depth,
  CASE kind WHEN 1 THEN '{"text":' || to_json(text) || ',"turn":"' || turn || '"}' WHEN 2 THEN '{"turn":' || turn || '}' WHEN 3 THEN 'null' ELSE '{"text":' || to_json(text) || ',"turn":' || turn || '}' END AS arguments,
  CASE kind WHEN 4 THEN 'answer' ELSE 'reply' END AS name, CASE kind WHEN 6 THEN call_id ELSE conv_id || ':' || (turn - 2) END AS parent_id,
  CASE kind WHEN 1 THEN 'turn' WHEN 2 THEN 'text' WHEN 3 THEN 'arguments' WHEN 4 THEN 'name' ELSE '' END AS problems FROM c),
 a AS (SELECT * FROM conversations WHERE role = 'assistant' AND conv_id % 11 <> 7)
SELECT d.conv_id, call_id, depth, name, CASE kind WHEN 5 THEN 2 ELSE 1 END::BIGINT AS n_calls, CASE WHEN a.conv_id IS NULL THEN 0 WHEN kind = 8 THEN 2 ELSE 1 END::BIGINT AS n_results, a.conv_id IS NOT NULL AS linked, problems, problems = '' AS valid,
 '{"arguments":' || arguments || ',"call_id":"' || call_id || '","conv_id":' || d.conv_id || ',"depth":' || coalesce(depth::VARCHAR, 'null') || ',"name":"' || name || '","parent_id":"' || parent_id || '","result":' || coalesce(to_json(a.text)::VARCHAR, 'null') || '}' AS json
FROM d LEFT JOIN a ON a.conv_id = d.conv_id AND a.turn = d.turn + 1""",
    "op13_quality": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
 w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
 g AS (SELECT doc_id, i, w[i : i + 2] AS said FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
 r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, said) > 1),
 c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(3) AS o(k) GROUP BY doc_id),
 m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  coalesce(n, 0)::BIGINT AS n_repeat_words, length(t) - length(replace(t, '!', '')) AS marks, len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}'))) AS letters,
  len(list_filter(w, lambda x: list_contains({STOP_WORDS!r}, lower(x)))) AS stops, len(l) AS lines, len(list_filter(l, lambda x: regexp_matches(x, '^[\\x20\\x09-\\x0D]*[-*•‣▪●]'))) AS bullets,
  len(list_filter(l, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$'))) AS dots FROM w LEFT JOIN c USING (doc_id)),
 s AS (SELECT *, coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word_chars, coalesce(n_symbols / nullif(n_words, 0), 0) AS symbol_ratio, coalesce(marks / nullif(n_words, 0), 0) AS exclamation_ratio, coalesce(letters / nullif(n_words, 0), 0) AS letter_ratio,
  coalesce(stops / nullif(n_words, 0), 0) AS stop_ratio, coalesce(n_dup_lines / nullif(lines, 0), 0) AS dup_line_ratio, coalesce(bullets / nullif(lines, 0), 0) AS bullet_ratio, coalesce(dots / nullif(lines, 0), 0) AS ellipsis_ratio,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, {_failed_sql()} AS failed, NOT base_failed AND {_failed_sql()} = '' AS kept FROM s""",
}
