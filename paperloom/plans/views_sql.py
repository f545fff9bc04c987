"""The views of ``paperloom.sources.views`` as DuckDB common table expressions, for the oracles."""

from __future__ import annotations

from paperloom import rules
from paperloom.sources.views import UNIT_TYPES, VECTOR_TYPES


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def choice(values, index: str) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + f"][CAST({index} AS BIGINT) + 1]"


def listed(values) -> str:
    return ", ".join(quoted(v) for v in values)


def trimmed(x: str) -> str:
    return f"regexp_replace({x}, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')"


VIEWS = {
    "papers": (
        (),
        rf"""SELECT paper_id, 'Paper ' || paper_id AS title, string_agg(part, chr(10) || chr(10) ORDER BY doc_id) AS text FROM (
  SELECT doc_id, doc_id // 6 + 1 AS paper_id, {choice(rules.SECTION_HEADINGS, "doc_id % 6")} || chr(10) || CASE doc_id % 6 WHEN 0 THEN '12' WHEN 1 THEN 'doi: 10.1000/x'
    WHEN 2 THEN 'We use a learning rate of 0.00' || ((doc_id // 6 + 1) % 3 + 1) || ' and batch size ' || (16 * ((doc_id // 6 + 1) % 2 + 1)) || '. We propose an archi-' || chr(10) || 'tecture.'
    WHEN 3 THEN 'Evaluation on dataset D' || ((doc_id // 6 + 1) % 5) || ' with batch size 32 for 50 epochs.' ELSE '' END
    || chr(10) || chr(10) || replace(coalesce(text, ''), chr(10), chr(10) || chr(10)) AS part FROM documents) GROUP BY paper_id""",
    ),
    "paper_rows": (
        (),
        """SELECT p AS paper_id, p % 9 AS category_id, 'Paper ' || p || CASE WHEN p % 7 = 0 THEN ' a survey' ELSE '' END AS title,
  CASE WHEN p % 11 = 0 THEN NULL ELSE 900 + p * 37 % 1300 END AS publish_year, 'kw' || (p % 4) || ', topic' || (p % 3) AS keywords,
  CASE WHEN p % 4 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS parse_status
  FROM (SELECT doc_id // 6 + 1 AS p FROM documents WHERE doc_id % 6 = 0)""",
    ),
    "categories": (
        (),
        """SELECT category_id, name, category_id * 10 AS sort_order, category_id = 1 AS system_flag FROM (
  SELECT source AS name, row_number() OVER (ORDER BY source NULLS FIRST) AS category_id FROM (SELECT DISTINCT source FROM documents)) WHERE category_id % 7 <> 0""",
    ),
    "chunks": (
        (),
        rf"""SELECT doc_id AS chunk_id, doc_id // 6 + 1 AS paper_id, doc_id % 6 AS chunk_index, {choice(rules.SECTION_TYPES, "doc_id % 6")} AS section_type,
  {choice(rules.SECTION_HEADINGS, "doc_id % 6")} AS section_title, CASE doc_id % 6
    WHEN 2 THEN 'We use a learning rate of 0.00' || ((doc_id // 6 + 1) % 3 + 1) || ' and batch size ' || (16 * ((doc_id // 6 + 1) % 2 + 1)) || '. We propose an architecture. ' || text
    WHEN 3 THEN 'Evaluation on dataset D' || ((doc_id // 6 + 1) % 5) || ' with batch size 32 for 50 epochs. ' || text ELSE text END AS content,
  doc_id % 6 = 5 AS is_reference, length(text) < 200 AS is_noise, round(length(text) % 100 / 100.0, 2) AS quality_score FROM documents""",
    ),
    "questions": ((), "SELECT item_id AS question_id, text AS question FROM benchmark"),
    "gold": ((), "SELECT item_id AS question_id, doc_id AS chunk_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)"),
    "vectors": ((), f"SELECT vec_id AS point_id, vec_id % 50 + 1 AS paper_id, {choice(VECTOR_TYPES, 'label % 3')} AS content_type, embedding FROM embeddings"),
    "vector_queries": ((), "SELECT vec_id // 100 AS query_id, embedding AS query FROM embeddings WHERE vec_id % 100 = 0"),
    "vector_queries2": ((), "SELECT vec_id // 100 AS query_id, embedding AS query FROM embeddings WHERE vec_id % 100 = 50"),
    "units": (
        (),
        f"""SELECT d.doc_id AS unit_id, d.doc_id // 6 + 1 AS paper_id, {choice(UNIT_TYPES, "d.doc_id % 17")} AS knowledge_type, 'Subject ' || (d.doc_id % 5) AS subject_text,
  'states' AS predicate_text, CASE WHEN d.doc_id % 3 = 0 THEN d.source || ' ' || d.lang ELSE d.text END AS object_value,
  CASE WHEN quality = 1 AND toxic = 0 THEN 'GOLD' WHEN quality IS NOT NULL THEN 'SILVER' ELSE 'BRONZE' END AS confidence_level,
  {choice(("LLM", "USER", "PROFILE", "DETERMINISTIC", "SECTION_SUMMARY"), "d.doc_id % 5")} AS extraction_method,
  CASE WHEN d.doc_id % 19 = 0 THEN 'REJECTED' WHEN d.doc_id % 4 = 0 THEN 'CONFIRMED' ELSE 'AUTO' END AS verification_status,
  CASE WHEN d.doc_id % 8 <> 0 THEN d.text END AS evidence_text FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    ),
    "chat": ((), "SELECT conv_id AS session_id, turn AS msg_id, role, text AS content FROM conversations"),
    "spans": ((), "SELECT user_id AS request_id, event_type AS stage, value AS ms, ts, event_id FROM events"),
    "jobs": (
        (),
        """SELECT event_id AS job_id, user_id AS paper_id, CASE event_type WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' ELSE 'PROCESSING' END AS status,
  ts AS create_time, CAST(floor(value) AS BIGINT) % 20 AS processed, CAST(20 AS BIGINT) AS total FROM events""",
    ),
    "feedback": (
        (),
        """SELECT event_id, user_id AS unit_id, CASE event_type WHEN 'purchase' THEN 'CONFIRM' WHEN 'error' THEN 'REJECT' ELSE 'CORRECT' END AS action,
  CASE WHEN event_type = 'signup' THEN 'v' || event_id END AS object_value, ts FROM events WHERE event_type IN ('purchase', 'error', 'signup')""",
    ),
}


def add_view(name: str, needs: tuple[str, ...], sql: str) -> None:
    VIEWS[name] = (needs, sql)


def over(body: str, *names: str) -> str:
    """``body`` behind the common table expressions that it needs."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for n in VIEWS[name][0]:
                visit(n)
            order.append(name)

    for n in names:
        visit(n)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order) + "\n" + body
