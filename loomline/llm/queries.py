"""The queries that apply the operators to the tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import ann, bpe, conversation_repair, exact_dedup, merkle, ngram_join, packing, quality, secret_scan, substring_dedup, tool_calls, url_filter, warc
from loomline.llm.common import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_round_trip(table(spark, sf_dir, "pages"))
    gap = F.format_string("a gap in an archive just written, %s at byte %d: %s", "archive", "start", "gap")
    records = records.where(F.when(F.col("gap").isNull(), True).otherwise(F.raise_error(gap).cast("boolean")))
    return records.select(
        warc.page_number(F.col("record_id")).alias("page_id"),
        F.col("full_length").alias("payload_bytes"),
        F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"),
        "record_type",
        warc.page_number(F.col("refers_to")).alias("refers_to"),
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


URL_RULES = (
    url_filter.HostRule("org", "/", "allow"),
    url_filter.HostRule("example.org", "/es/", "block"),
    url_filter.HostRule("example.org", "/en/1", "block"),
    url_filter.HostRule("com", "/fr/", "allow"),
    url_filter.HostRule("com", "/de/", "block"),
)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_table(docs, table(spark, sf_dir, "labels"))
    return quality.score_table(docs, model).select("doc_id", (quality.fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_table(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


TOOL_SCHEMAS = {
    "reply": {"text": ("string", True), "turn": ("integer", True)},
    "context": {"text": ("string", True), "turn": ("integer", True)},
}


def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_calls.dialogue_calls(table(spark, sf_dir, "conversations"))
    return tool_calls.link_tool_calls(calls, results, TOOL_SCHEMAS)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents")).drop("span_list")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


def damaged_turns(rows: DataFrame) -> DataFrame:
    """Conversations as op11 damages them: conv_id, turn, role, text; a null role or text is one space."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(told("text"), "[.!?]", "")).otherwise(told("text"))
    times = F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))
    left = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(told("role")).alias("role"), text.alias("text"), kind.alias("kind"), times.alias("times"))
    return left.where("kind <> 0").select("conv_id", "turn", "role", "text", F.explode("times").alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    out = conversation_repair.repair(damaged_turns(rows), conversation=F.col("conv_id"), turn=F.col("turn"), role=F.col("role"), text=F.col("text"))
    every = rows.select("conv_id").distinct().withColumn("conversation", conversation_repair.named(F.col("conv_id")))
    found = every.join(out.summary, "conversation", "left").join(out.digests(), "conversation", "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return found.select("conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents")).documents.drop("n_paths")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cells = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    claimed = merkle.leaf_digest(*[F.col(c) + 1 if c == "n_chars" else F.col(c) for c in cells])
    docs = docs.withColumn("claimed", F.when(tampered, claimed))
    out = merkle.manifest(docs, merkle.leaf_digest(*[F.col(c) for c in cells]), group_col="lang", order_cols=["doc_id"], carry=["claimed"])
    out = out.withColumn("folded_root", merkle.fold(F.coalesce("claimed", "leaf"), F.col("proof")))
    return out.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_packing": op3_packing,
    "op4_url_filter": op4_url_filter,
    "op5_quality": op5_quality,
    "op6_bpe": op6_bpe,
    "op7_tool_calls": op7_tool_calls,
    "op8_ann": op8_ann,
    "op9_secret_scan": op9_secret_scan,
    "op10_ngram_join": op10_ngram_join,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_merkle": op13_merkle,
}

#: The unsigned CRC-32 of a short text, bit by bit.
CRC32 = """xor(list_reduce([4294967295::UBIGINT] || flatten([[ord(c)::UBIGINT] || [256::UBIGINT FOR i IN range(8)] FOR c IN string_split({0}, '')]),
  lambda a, x: CASE WHEN x < 256 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END), 4294967295::UBIGINT)"""


def _cheapest(*paths: str) -> str:
    return f"list_sort([{', '.join(paths)}], 'ASC', 'NULLS LAST')[1]"


def _edit(state: str, cost: str, initial: str, line: str = "") -> str:
    """A path {c: cost, a: initials, t: repaired lines} after one more edit; null where the state isn't reached."""
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{initial}', 't': {state}.t{' || chr(10) || ' + line if line else ''}}} END"


_KEEP = lambda s, x: f"CASE WHEN fault IS NULL OR fault = 'truncated' THEN CASE WHEN left(role, 1) = '{x}' THEN {_edit(s, 'more', 'K', 'role || chr(58) || text')} END END"
_REROLE = lambda s, name: f"CASE WHEN fault IS NULL OR fault = 'truncated' THEN {_edit(s, '3 + more', 'R', repr(name + ':') + ' || text')} END"
_DELETE = lambda s: _edit(s, "4", "D")
_ASK, _ANSWER = (lambda s: _edit(s, "3", "I", "'user:'")), (lambda s: _edit(s, "3", "I", "'assistant:'"))
#: A row's keep, rerole and delete for each state of (s?(ua)+)?, then insertions.
_STEP = ", ".join(
    f"{_cheapest(*paths)} AS s{k}"
    for k, paths in enumerate(
        (
            [_DELETE("s0")],
            [_DELETE("s1"), _KEEP("s0", "s")],
            [_DELETE("s2"), *[f(s, x) for s in ("s0", "s1", "s3") for f, x in ((_KEEP, "u"), (_REROLE, "user"))]],
            [_DELETE("s3"), _KEEP("s2", "a"), _REROLE("s2", "assistant")],
        )
    )
)
FRAMED = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || {0}, '-')"

SQL: dict[str, str] = {
    "op1_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), d AS (
  SELECT page_id, strlen(payload) AS n, sha1(payload) AS sha, max(page_id) OVER (PARTITION BY payload) AS top FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((('0x' || substr(sha, 1 + 10 * (i // 8), 10))::UBIGINT >> (35 - 5 * (i % 8))) & 31 AS INT) + 1, 1)
         FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM d
""",
    "op2_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""",
    "op4_url_filter": r"""
WITH RECURSIVE u AS (
  SELECT row_number() OVER () AS r, page_id, coalesce(url, '') AS url FROM pages
), h AS (
  SELECT r, page_id, url,
         translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM u
), j AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM h
), v AS (
  SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS fixed FROM j
), t AS (
  SELECT DISTINCT r, fixed, unnest(
    [('h:' || array_to_string(string_split(host, '.')[k:], '.')) FOR k IN range(1, len(string_split(host, '.')) + 1) IF host <> '']
    || [('p:' || regexp_replace(x, '[0-9]+', '0', 'g')) FOR x IN string_split(path, '/') IF x <> '']
    || [('q:' || regexp_extract(x, '(?s)^([^=]*)', 1)) FOR x IN string_split(regexp_extract(url, '(?s)^[^?#]*\?([^#]*)', 1), '&') IF x <> '']
    || CASE WHEN contains(url, '#') THEN ['#'] ELSE [] END) AS token
  FROM v
), n AS (
  SELECT count(*) AS urls FROM v WHERE fixed IS NOT NULL
), singles AS (
  SELECT token, count(*) FILTER (fixed = 'block') AS blocked, count(*) AS every FROM t WHERE fixed IS NOT NULL GROUP BY token
), labelled AS (
  SELECT r, any_value(fixed) AS fixed, list(token) AS tokens FROM t JOIN singles USING (token), n WHERE fixed IS NOT NULL AND blocked >= ceil(0.01 * urls) AND blocked / every < 0.8 GROUP BY r
), grown AS (
  SELECT [token] AS items, blocked, every FROM singles, n WHERE blocked >= ceil(0.01 * urls)
  UNION ALL
  SELECT items, blocked, every FROM (
    SELECT list_append(g.items, x.token) AS items, count(*) FILTER (fixed = 'block') AS blocked, count(*) AS every
    FROM grown g JOIN labelled l ON list_has_all(l.tokens, g.items), unnest(l.tokens) AS x(token)
    WHERE g.blocked / g.every < 0.8 AND x.token > g.items[-1] GROUP BY 1), n
  WHERE blocked >= ceil(0.01 * urls)
), rules AS (
  SELECT row_number() OVER () AS k, items FROM grown WHERE blocked / every >= 0.8
), hit AS (
  SELECT DISTINCT t.r FROM t JOIN (SELECT k, len(items) AS needed, unnest(items) AS token FROM rules) USING (token) GROUP BY t.r, k, needed HAVING count(*) = needed
)
SELECT page_id, host, path, rule, CASE WHEN fixed IS NOT NULL THEN fixed WHEN hit.r IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM v LEFT JOIN hit ON v.r = hit.r
""",
    "op7_tool_calls": r"""
WITH m AS (
  SELECT coalesce(CAST(conv_id AS VARCHAR), 'none') AS conversation, turn, coalesce(role, 'none') IN ('user', 'system') AS asks, role, text FROM conversations
), asked AS (
  SELECT conversation, conversation || '-' || coalesce(CAST(turn AS VARCHAR), 'none') AS call_id, count(*) AS n_calls,
         min({'turn': turn, 'name': CASE WHEN role = 'user' THEN 'reply' ELSE 'context' END, 'text': text}) AS c
  FROM m WHERE asks GROUP BY ALL
), given AS (
  SELECT conversation, conversation || '-' || coalesce(CAST(turn - 1 AS VARCHAR), 'none') AS call_id, count(*) AS n_results, min({'turn': turn, 'content': text}) AS r
  FROM m WHERE NOT asks GROUP BY ALL
), linked AS (
  SELECT *, CASE WHEN n_calls IS NULL THEN 'no-call' WHEN n_results IS NULL THEN 'no-result' WHEN r.turn < c.turn THEN 'early-result' ELSE 'linked' END AS status,
         CASE WHEN n_calls IS NOT NULL THEN CASE WHEN NOT coalesce(c.turn > 0, false) THEN 0
              WHEN EXISTS (SELECT 1 FROM asked z WHERE z.call_id = conversation || '-0' AND z.conversation = a.conversation) THEN 1 END END AS level
  FROM asked a FULL JOIN given USING (conversation, call_id)
)
SELECT conversation, call_id, status, c.name AS name, c.turn AS call_turn, r.turn AS result_turn,
       coalesce(n_calls, 0) AS n_calls, coalesce(n_results, 0) AS n_results, CAST(level AS BIGINT) AS level,
       CASE WHEN n_calls IS NULL THEN '' ELSE concat_ws(',', CASE WHEN c.text IS NULL THEN 'missing:text' END, CASE WHEN c.turn IS NULL THEN 'missing:turn' END) END AS errors,
       n_calls IS NOT NULL AND c.text IS NOT NULL AND c.turn IS NOT NULL AS valid,
       '{' || concat_ws(',',
         CASE WHEN n_calls IS NOT NULL THEN '"arguments":{' || concat_ws(',', '"text":' || to_json(c.text), '"turn":' || c.turn) || '}' END,
         '"content":' || to_json(r.content),
         CASE WHEN n_calls IS NOT NULL THEN '"depends_on":' || CASE WHEN c.turn > 0 THEN '["' || conversation || '-0"]' ELSE '[]' END END,
         '"id":"' || call_id || '"', '"level":' || level, '"name":"' || c.name || '"', '"status":"' || status || '"') || '}' AS json
FROM linked
""",
    "op9_secret_scan": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner, coalesce(lang, '') AS repo FROM documents
), patterns(kind, name, pattern, grp) AS (
  VALUES (0, 'assign', '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2),
         (1, 'access', 'AKIA[A-Z0-9]{16,}', 0), (2, 'hex', '[0-9a-f]{24,}', 0), (3, 'owned', '[A-Za-z0-9_-]{20,}', 0)
), cut AS (
  SELECT r, 0 AS kind, string_split_regex(text, '(?:(?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?(?:[A-Za-z0-9+/_.=-]+)') AS pieces,
         regexp_extract_all(text, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS hits,
         regexp_extract_all(text, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS vals FROM d
  UNION ALL SELECT r, 1, string_split_regex(text, 'AKIA[A-Z0-9]{16,}'), regexp_extract_all(text, 'AKIA[A-Z0-9]{16,}'), regexp_extract_all(text, 'AKIA[A-Z0-9]{16,}') FROM d
  UNION ALL SELECT r, 2, string_split_regex(text, '[0-9a-f]{24,}'), regexp_extract_all(text, '[0-9a-f]{24,}'), regexp_extract_all(text, '[0-9a-f]{24,}') FROM d
  UNION ALL SELECT r, 3, string_split_regex(text, '[A-Za-z0-9_-]{20,}'), regexp_extract_all(text, '[A-Za-z0-9_-]{20,}'), regexp_extract_all(text, '[A-Za-z0-9_-]{20,}') FROM d
), piece AS (
  SELECT r, kind, unnest(range(1, len(hits) + 1)) AS k, unnest(pieces[:len(hits)]) AS piece, unnest(hits) AS hit, unnest(vals) AS val FROM cut
), span AS (
  SELECT r, kind, hit, val, CAST(sum(length(piece) + length(hit)) OVER (PARTITION BY r, kind ORDER BY k) AS INT) AS stop FROM piece
), placed AS (
  SELECT r, kind, stop - length(hit) AS start, stop, val FROM span
  WHERE CASE kind WHEN 0 THEN length(val) >= 6 WHEN 3 THEN regexp_matches(val, '[A-Za-z]') AND len(regexp_extract_all(val, '[0-9]')) >= 4 ELSE true END
), candidate AS (
  SELECT p.*, owner, repo FROM placed p JOIN d USING (r)
  WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM placed b WHERE b.r = p.r AND b.kind < 3 AND b.start < p.stop AND p.start < b.stop)
), held AS (
  SELECT val, count(DISTINCT owner) AS owners, count(DISTINCT {'owner': owner, 'repo': repo}) AS repositories FROM candidate GROUP BY val
), judged AS (
  SELECT c.*, owners, repositories, owners <= 2 AND repositories <= 3 AS live,
         ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || start || ':' || stop AS said FROM candidate c JOIN held USING (val)
), by_row AS (
  SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg(said, ',' ORDER BY start, kind) FILTER (kind < 3) AS base,
         string_agg(said, ',' ORDER BY start, kind) FILTER (kind < 3 OR live) AS spans,
         string_agg(owners, ',' ORDER BY start, kind) FILTER (kind < 3 OR live) AS owners,
         string_agg(repositories, ',' ORDER BY start, kind) FILTER (kind < 3 OR live) AS repositories,
         count(*) FILTER (kind = 3 AND live) AS n_owned, count(*) FILTER (kind < 3 AND live) AS n_live, count(*) FILTER (kind < 3 AND NOT live) AS n_copied
  FROM judged GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_owned, 0) AS n_owned, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied,
       coalesce(owners, '') AS owners, coalesce(repositories, '') AS repositories
FROM d LEFT JOIN by_row USING (r)
""",
    "op11_conversation_repair": rf"""
WITH RECURSIVE o AS (
  SELECT coalesce('=' || conv_id, '') AS g, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {CRC32.format("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS k FROM conversations
), m AS (
  SELECT g, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM o WHERE k <> 0
), n AS (
  SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY g, role, text ORDER BY turn NULLS FIRST, copy) AS nth, lag(role) OVER w AS before
  FROM m WINDOW w AS (PARTITION BY g ORDER BY turn NULLS FIRST, role, text, copy)
), r AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
    WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    i > 1 AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au') AS wrong FROM n
), x AS (
  SELECT *, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS more FROM r
), f AS (
  SELECT g, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS s0, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS s1,
         {{'c': 3::BIGINT, 'a': 'I', 't': chr(10) || 'user:'}} AS s2, {{'c': 6::BIGINT, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS s3 FROM (SELECT DISTINCT g FROM x)
  UNION ALL
  SELECT g, i, s0, s1, s2, {_cheapest("s3", _ANSWER("s2"))} FROM (
    SELECT g, i, s0, s1, {_cheapest("s2", _ASK("s0"), _ASK("s1"), _ASK("s3"))} AS s2, s3 FROM (
      SELECT x.g, x.i, {_STEP} FROM f JOIN x ON x.g = f.g AND x.i = f.i + 1))
), best AS (
  SELECT f.g, {_cheapest("s0", "s3")} AS w FROM f JOIN (SELECT g, max(i) AS i FROM x GROUP BY g) z ON z.g = f.g AND z.i = f.i
), c AS (
  SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (wrong) AS illegal FROM x GROUP BY g
)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(w.c, 0) AS cost, coalesce(w.a, '') AS audit, sha256(coalesce(w.t[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT g, conv_id FROM o) o LEFT JOIN c USING (g) LEFT JOIN best USING (g)
""",
    "op12_substring_dedup": rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
), w AS (
  SELECT r, doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d
), k AS (
  SELECT *, CASE WHEN lead(word, 12) OVER t IS NOT NULL THEN concat_ws(' ', word, {", ".join(f"lead(word, {n}) OVER t" for n in range(1, 13))}) END AS said FROM w WINDOW t AS (PARTITION BY r ORDER BY i)
), s AS (
  SELECT said, min({{'d': doc_id, 'i': i}}) AS src FROM k WHERE said IS NOT NULL GROUP BY said
), f AS (
  SELECT k.r, k.doc_id, k.word, k.i, src, coalesce(src.d < doc_id, false) AS late FROM k LEFT JOIN s USING (said)
), c AS (
  SELECT *, max(late) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone,
         late AND NOT coalesce(lag(late) OVER t AND lag(src.d) OVER t = src.d AND lag(src.i) OVER t + 1 = src.i, false) AS fresh FROM f WINDOW t AS (PARTITION BY r ORDER BY i)
), g AS (
  SELECT r, count(*) FILTER (gone) AS n_removed, count(*) FILTER (fresh) AS n_spans, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY r
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(n_spans, 0) AS n_spans FROM d LEFT JOIN g USING (r)
""",
    "op13_merkle": f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS grp, n_chars, {" || ".join(FRAMED.format(c) for c in ("doc_id", "source", "lang"))} AS head, {FRAMED.format("text")} AS tail FROM documents
), e AS (
  SELECT *, sha256(head || {FRAMED.format("n_chars")} || tail) AS leaf, sha256(head || {FRAMED.format("(n_chars + 1)")} || tail) AS other,
         coalesce({CRC32.format("CAST(doc_id AS VARCHAR)")} % 7 = 0, false) AS tampered FROM d
), p AS (
  SELECT r, doc_id, grp, leaf, CASE WHEN tampered THEN other ELSE leaf END AS claimed, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS place FROM e
), lv AS (
  SELECT grp, 0 AS level, list(leaf ORDER BY place) AS nodes FROM p GROUP BY grp
  UNION ALL SELECT grp, level + 1, [sha256(array_to_string(nodes[2 * k + 1 : 2 * k + 2], '')) FOR k IN range((len(nodes) + 1) // 2)] FROM lv WHERE len(nodes) > 1
), s AS (
  SELECT grp, max_by(nodes, level)[1] AS subroot, max(level) AS top FROM lv GROUP BY grp
), g AS (
  SELECT *, row_number() OVER (ORDER BY grp) - 1 AS place FROM s
), tl AS (
  SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM g
  UNION ALL SELECT level + 1, [sha256(array_to_string(nodes[2 * k + 1 : 2 * k + 2], '')) FOR k IN range((len(nodes) + 1) // 2)] FROM tl WHERE len(nodes) > 1
), around AS (
  SELECT r, lv.level, p.place >> lv.level AS idx, nodes FROM p JOIN lv USING (grp) WHERE len(nodes) > 1
  UNION ALL SELECT r, top + tl.level, g.place >> tl.level, nodes FROM p JOIN g USING (grp) CROSS JOIN tl WHERE len(nodes) > 1
), sib AS (
  SELECT r, level, CASE WHEN idx % 2 = 1 THEN 'L' || nodes[idx] ELSE 'R' || coalesce(nodes[idx + 2], '') END AS x FROM around
), proofs AS (
  SELECT r, list(x ORDER BY level) AS xs FROM sib GROUP BY r
), f AS (
  SELECT p.*, subroot, (SELECT max_by(nodes, level)[1] FROM tl) AS root, coalesce(xs, []) AS xs FROM p JOIN s USING (grp) LEFT JOIN proofs USING (r)
), z AS (
  SELECT *, list_reduce([claimed] || xs, lambda a, x: CASE WHEN x[1] = 'L' THEN sha256(x[2:] || a) ELSE sha256(a || x[2:]) END) AS folded_root FROM f
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string([x[2:] FOR x IN xs], '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM z
""",
}
