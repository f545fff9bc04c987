"""DuckDB twins of the queries that SQL can state."""

from __future__ import annotations

from paperloom.llm import chat_format, quality_rules
from paperloom.llm.quality_rules import QualityParams

_WORD = r"[^\x20\x09-\x0D]"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def op1() -> str:
    p = QualityParams()
    stock = " OR ".join(f"contains(lower(line), {_quoted(x)})" for x in quality_rules.STOCK_PHRASES)
    count = lambda chars: f"(length(line) - length(regexp_replace(line, '[{chars}]', '', 'g')))"
    return rf"""WITH base AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}+') AS w FROM documents),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM base),
told AS (SELECT *, len(regexp_extract_all(line, '{_WORD}+')) AS nw, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) > 1 AS again FROM lines),
failed AS (SELECT doc_id, count(*) FILTER (WHERE nw > 0 AND again) AS n_dup_lines, coalesce(sum(length(line)) FILTER (WHERE nw > 0 AND (again OR (nw <= 40 AND ({stock}))
  OR ({count("|<>")} >= 2 AND {count("|<>")} > CAST({p.max_separator_share} AS DOUBLE) * nw) OR {count("#*$%&|<>")} > CAST({p.max_symbol_share} AS DOUBLE) * nw
  OR NOT regexp_matches(line, {_quoted(quality_rules.SENTENCE_END)}))), 0) AS lost FROM told GROUP BY 1),
windows AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM base)),
repeated AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS c FROM windows) WHERE c > 1) GROUP BY 1),
judged AS (SELECT b.doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  f.n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, CASE WHEN length(t) > 0 THEN CAST(f.lost AS DOUBLE) / length(t) ELSE 0 END AS share FROM base b JOIN failed f USING (doc_id) LEFT JOIN repeated r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {p.min_words} OR 100 * n_repeat_words > {p.max_repeat_percent} * n_words AS base_failed,
  NOT (n_words < {p.min_words} OR 100 * n_repeat_words > {p.max_repeat_percent} * n_words) AND share <= CAST({p.max_lost_share} AS DOUBLE) AS kept FROM judged"""


def op4() -> str:
    fixed = len(chat_format.TURN) + 1 + len(chat_format.END) + 1
    escaped = rf"regexp_replace(text, {_quoted(chat_format._ESCAPE)}, '\1\2\\\3', 'g')"
    role = "replace(replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<', '%3C'), '[', '%5B')"
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL
  SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({fixed} + length({role}) + length({escaped})) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id"""


def op6(k: int = 5, percent: int = 80) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{_WORD}+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {k - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {k - 1}, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
linked AS (SELECT x, y FROM met JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= {percent} * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM linked UNION ALL SELECT y, x FROM linked),
reach AS (SELECT doc_id, doc_id AS r FROM sizes UNION SELECT reach.doc_id, b.y FROM reach JOIN both_ways b ON reach.r = b.x)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(m.low, d.doc_id) AS component_id FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN (SELECT doc_id, min(r) AS low FROM reach GROUP BY 1) m USING (doc_id)"""


def _crc32(hexed: str) -> str:
    """The checksum of bytes told in hexadecimal digits; its table ``steps`` of 256 entries is made by its rule in ``_STEPS``."""
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all({hexed}, '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda a, b: xor(a // 256, steps[xor(a % 256, b) + 1])), 4294967295)"


_STEPS = "crc AS (SELECT list_transform(range(0, 256), lambda n: list_reduce(list_prepend(n, range(0, 8)), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS steps)"


def op7(shards: int = 24) -> str:
    """The law is told in full."""
    return f"""WITH {_STEPS},
sized AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, {_crc32("h")} AS text_crc32 FROM (SELECT doc_id, text, hex(encode(coalesce(text, ''))) AS h FROM documents), crc),
summed AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32 ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total FROM sized),
placed AS (SELECT *, least({shards - 1}, CAST((2 * upto - size) * {shards} // (2 * total) AS INTEGER)) AS shard FROM summed)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM placed"""


def op11() -> str:
    """Edits told forwards: for every row and state the cheapest edits so far, of equal ones the letters that come first."""
    best = lambda *ways: f"list_sort(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))[1]"
    way = lambda state, cost, letter, row: f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'o': {state}.o || {row}}} END"
    insert = lambda state, role: way(state, 5, "I", f"chr(10) || '{role}:'")
    only = lambda condition, way: f"CASE WHEN {condition} THEN {way} END"
    kept = lambda state, letter: only(f"stays AND starts_with(role, '{letter}')", way(state, "extra", "K", "chr(10) || role || ':' || text"))
    named = lambda state, role: only("stays", way(state, "1 + extra", "R", f"chr(10) || '{role}:' || text"))
    gone = lambda state: way(state, 2, "D", "''")
    opened = lambda rows: f"SELECT *, {best('a', insert('u1', 'assistant'))} AS a1 FROM (SELECT *, {best('u', insert('q', 'user'), insert('s', 'user'), insert('a', 'user'))} AS u1 FROM {rows})"
    return rf"""WITH RECURSIVE {_STEPS},
told AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')))")} % 20 AS kind FROM conversations, crc),
hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM told)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM hurt)),
judged AS (SELECT *, CASE WHEN NOT regexp_matches(text, '{_WORD}') THEN 'blank' WHEN again THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 'truncated' ELSE '' END AS fault,
  lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1) AS met FROM placed),
steps_in AS (SELECT conv_id, i, role, text, fault IN ('', 'truncated') AS stays, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS extra FROM judged),
run AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': 0, 'a': '', 'o': ''}} AS q, CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, o VARCHAR)) AS s, CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, o VARCHAR)) AS u, CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, o VARCHAR)) AS a FROM (SELECT DISTINCT conv_id FROM judged)
  UNION ALL SELECT conv_id, i, {gone("q")}, {best(gone("s"), kept("q", "s"))}, {best(gone("u1"), *[w for x in ("q", "s", "a1") for w in (kept(x, "u"), named(x, "user"))])}, {best(gone("a1"), kept("u1", "a"), named("u1", "assistant"))}
  FROM ({opened("(SELECT r.q, r.s, r.u, r.a, n.* FROM run r JOIN steps_in n ON n.conv_id IS NOT DISTINCT FROM r.conv_id AND n.i = r.i + 1)")})),
ended AS (SELECT conv_id, {best("q", "a1")} AS w FROM ({opened("(SELECT * FROM run SEMI JOIN (SELECT conv_id AS c, max(i) AS m FROM judged GROUP BY 1) ON c IS NOT DISTINCT FROM conv_id AND m = i)")})),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
  count(*) FILTER (WHERE met NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY 1)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(w.c, 0) AS BIGINT) AS cost, coalesce(w.a, '') AS audit, sha256(coalesce(substr(w.o, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted k ON k.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id"""


def op12(k: int = 10) -> str:
    upper, term = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{term}')"
    return f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
totals AS (SELECT count(*) AS nn, CAST(sum(len(w)) AS BIGINT) AS ll FROM docs WHERE len(w) > 0),
asked AS (SELECT row_number() OVER () AS q, item_id, unnest(list_distinct({words})) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)),
held AS (SELECT r, doc_id, term, count(*) AS tf, n FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(nn) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM held, totals GROUP BY 1),
scored AS (SELECT q, item_id, r, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll)))) AS BIGINT) AS score FROM asked JOIN held USING (term) JOIN weights USING (term), totals GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= {k}"""


def op13(width: int = 200) -> str:
    """Every window of every text, by a 64-bit hash of its bytes in hexadecimal digits."""
    return f"""WITH texts AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (SELECT r, i, hash(substr(h, 2 * i + 1, {2 * width})) AS m FROM (SELECT r, h, unnest(range(0, length(h) // 2 - {width - 1})) AS i FROM texts WHERE length(h) >= {2 * width})),
hit AS (SELECT r, i FROM windows WHERE m IN (SELECT m FROM windows GROUP BY 1 HAVING count(*) > 1)),
begun AS (SELECT *, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + {width}, true) AS new FROM hit),
runs AS (SELECT r, min(i) AS a, max(i) + {width} AS b FROM (SELECT *, count(*) FILTER (WHERE new) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM begun) GROUP BY r, run),
gone AS (SELECT r, count(*) AS n, sum(b - a) AS bytes FROM runs GROUP BY 1),
edges AS (SELECT r, a, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM (SELECT * FROM runs UNION ALL SELECT r, length(h) // 2, NULL FROM texts)),
kept AS (SELECT r, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS h FROM edges JOIN texts USING (r) GROUP BY 1)
SELECT doc_id, length(t.h) // 2 AS n_bytes, CAST(coalesce(bytes, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(k.h)) AS kept_sha256 FROM texts t JOIN kept k USING (r) LEFT JOIN gone USING (r)"""


ORACLES = {"op1_quality_rules": op1(), "op4_chat_format": op4(), "op6_ngram_join": op6(), "op7_sharding": op7(), "op11_conversation_repair": op11(), "op12_ranked_search": op12(), "op13_suffix_dedup": op13()}
