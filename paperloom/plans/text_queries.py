"""Registered queries over text: cleaning, sections, chunks, assets (B)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom import rules
from paperloom.functions import text as T
from paperloom.operators import text as X
from paperloom.plans.catalog import query
from paperloom.plans.views_sql import add_view, listed, over, trimmed
from paperloom.sources import views as V

TRIM_LINE = trimmed("x")


def _noise(line: str) -> str:
    low = f"lower({trimmed(line)})"
    return "CASE " + " ".join(f"WHEN regexp_matches({low}, '{p}') THEN '{n}'" for n, p in rules.NOISE_RULES) + " END"


def _bare(x: str) -> str:
    return trimmed(f"regexp_replace(lower({x}), '{rules.NUMBERING}', '')")


def _any(x: str, parts) -> str:
    return "(" + " OR ".join(f"contains({x}, '{p}')" for p in parts) + ")"


def _title_type(x: str) -> str:
    bare = _bare(f"coalesce({x}, '')")
    cases = []
    for kind, how, parts in rules.TITLE_RULES:
        test = f"{bare} IN ({listed(parts)})" if how == "is" else f"regexp_matches({bare}, '{parts[0]}')" if how == "match" else _any(bare, parts)
        cases.append(f"WHEN {test} THEN '{kind}'")
    return "CASE " + " ".join(cases) + " ELSE 'UNKNOWN' END"


def _inferred(title: str, content: str) -> str:
    bare = _bare(f"coalesce({content}, '')")
    return f"CASE WHEN {_title_type(title)} <> 'UNKNOWN' THEN {_title_type(title)} " + " ".join(f"WHEN {_any(bare, p)} THEN '{k}'" for k, p in rules.CONTENT_RULES) + " ELSE 'UNKNOWN' END"


def _heading(x: str) -> str:
    shape = f"(regexp_matches({x}, '{rules.NUMBERED_HEADING}') OR (regexp_matches({x}, '{rules.TITLE_CASE_HEADING}') AND len(regexp_split_to_array({x}, '\\s+')) <= {rules.HEADING_WORDS}))"
    return f"(length({x}) <= {rules.HEADING_CHARS} AND NOT suffix({x}, '.') AND ({_title_type(x)} <> 'UNKNOWN' OR {shape}))"


_CLEAN = trimmed(
    "regexp_replace(list_aggregate(list_transform(list_filter(list_transform(string_split("
    "regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '([A-Za-z])-\\n([A-Za-z])', '\\1\\2', 'g'), chr(10)), "
    f"lambda x: {TRIM_LINE}), lambda x: NOT regexp_matches(x, '^\\d{{1,4}}$') AND ({_noise('x')}) IS NULL), "
    "lambda x: regexp_replace(x, '[ \\t]+', ' ', 'g')), 'string_agg', chr(10)), '\\n{3,}', chr(10) || chr(10), 'g')"
)
add_view("cleaned", ("papers",), f"SELECT paper_id, title, {_CLEAN} AS text FROM papers")
add_view(
    "lines",
    ("cleaned",),
    f"SELECT paper_id, CAST(pos - 1 AS BIGINT) AS pos, {TRIM_LINE} AS line FROM (SELECT paper_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM cleaned)",
)
add_view("marked", ("lines",), f"SELECT *, line <> '' AND {_heading('line')} AS h0, {_title_type('line')} AS t FROM lines")
add_view(
    "sections",
    ("marked",),
    rf"""SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY sec) - 1 AS section_index, section_title, {_inferred("section_title", "content")} AS section_type, content FROM (
  SELECT *, max(sec) OVER (PARTITION BY paper_id) AS last, sum(CASE WHEN sec > 0 OR content <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY paper_id) AS n FROM (
    SELECT paper_id, sec, coalesce(max({trimmed(f"regexp_replace(line, '{rules.TITLE_NUMBERING}', '')")}) FILTER (WHERE h), 'Unknown') AS section_title,
      {trimmed("coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT h), '')")} AS content FROM (
      SELECT *, sum(CASE WHEN h THEN 1 ELSE 0 END) OVER (PARTITION BY paper_id ORDER BY pos) AS sec FROM (
        SELECT *, h0 AND coalesce(pos <= min(CASE WHEN h0 AND t = 'REFERENCES' THEN pos END) OVER (PARTITION BY paper_id), true) AS h FROM marked)) GROUP BY paper_id, sec))
  WHERE content <> '' OR (sec > 0 AND (sec < last OR n = 1))""",
)


@query(over("SELECT paper_id, length(text) AS n_chars, md5(text) AS digest FROM cleaned", "cleaned"))
def b1_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.clean(V.papers(spark, sf_dir)).select("paper_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


@query(over(f"SELECT rule, count(*) AS lines FROM (SELECT {_noise('x')} AS rule FROM (SELECT unnest(string_split(text, chr(10))) AS x FROM papers)) WHERE rule IS NOT NULL GROUP BY rule", "papers"))
def b2_noise_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.noise_profile(V.papers(spark, sf_dir))


@query(f"SELECT doc_id, CAST(pos - 1 AS BIGINT) AS pos, {TRIM_LINE} AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)")
def b3_explode_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.explode_lines(V.table(spark, sf_dir, "documents"), "doc_id").withColumn("pos", F.col("pos").cast("long"))


@query(over("SELECT paper_id, pos, line, t AS section_type FROM marked WHERE h0", "marked"))
def b4_b5_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = X.explode_lines(X.clean(V.papers(spark, sf_dir)), "paper_id").where((F.col("line") != "") & T.is_heading(F.col("line")))
    return lines.select("paper_id", F.col("pos").cast("long").alias("pos"), "line", T.section_type_from_title(F.col("line")).alias("section_type"))


@query(f"SELECT doc_id, {_inferred('source', 'text')} AS section_type FROM documents")
def b6_infer_section_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select("doc_id", T.infer_section_type(F.col("source"), F.col("text")).alias("section_type"))


@query(over("SELECT paper_id, section_index, section_title, section_type, md5(content) AS digest FROM sections", "sections"))
def b7_sectionize(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.sectionize(X.clean(V.papers(spark, sf_dir)))
    return out.select("paper_id", F.col("section_index").cast("long").alias("section_index"), "section_title", "section_type", F.md5("content").alias("digest"))


_NONE = "CAST([] AS VARCHAR[])"
_FLAT_P = trimmed(r"regexp_replace(p, '\s+', ' ', 'g')")
_PARTS = f"list_filter(list_transform(regexp_split_to_array(content, '\\n\\s*\\n'), lambda p: {_FLAT_P}), lambda p: p <> '')"
add_view(
    "packed",
    ("sections",),
    f"""SELECT * EXCLUDE (f), CASE WHEN f.cur = '' THEN f.out ELSE list_append(f.out, f.cur) END AS texts FROM (SELECT *, list_reduce(list_prepend({{'out': {_NONE}, 'cur': ''}}, list_transform({_PARTS}, lambda p: {{'out': {_NONE}, 'cur': p}})),
  lambda s, p: CASE WHEN length(s.cur) + length(p.cur) + 2 <= {rules.TARGET_CHARS} THEN {{'out': s.out, 'cur': CASE WHEN s.cur = '' THEN p.cur ELSE s.cur || chr(10) || chr(10) || p.cur END}}
    ELSE {{'out': list_append(CASE WHEN s.cur = '' THEN s.out ELSE list_append(s.out, s.cur) END, p.cur), 'cur': ''}} END) AS f FROM sections)""",
)
_STEP = rules.MAX_CHARS - rules.OVERLAP_CHARS
add_view(
    "cut_chunks",
    ("packed",),
    f"""SELECT * EXCLUDE (cuts), generate_subscripts(cuts, 1) AS part, unnest(cuts) AS chunk FROM (SELECT *, flatten(list_transform(texts, lambda x: CASE WHEN length(x) <= {rules.MAX_CHARS} THEN [{TRIM_LINE}]
  ELSE list_filter(list_transform(range(0, CAST(ceil((length(x) - {rules.MAX_CHARS}) / {float(_STEP)}) AS BIGINT) + 1), lambda i: {trimmed(f"substr(x, i * {_STEP} + 1, {rules.MAX_CHARS})")}), lambda y: y <> '') END)) AS cuts FROM packed)""",
)
_NOISY = f"(length(chunk) < {rules.NOISE_CHARS} OR section_type = 'BACK_MATTER')"


@query(
    over(
        f"""SELECT c.paper_id, row_number() OVER (PARTITION BY c.paper_id ORDER BY section_index, part) - 1 AS chunk_index, section_index, section_title, section_type, md5(chunk) AS content,
  md5('Paper Title: ' || title || chr(10) || 'Section Type: ' || section_type || chr(10) || 'Section Title: ' || section_title || chr(10) || 'Content:' || chr(10) || chunk) AS index_text, greatest(1, CAST(ceil(length(chunk) / 4.0) AS BIGINT)) AS token_count, length(chunk) AS char_count,
  section_type = 'REFERENCES' AS is_reference, {_NOISY} AS is_noise, CASE WHEN {_NOISY} THEN CAST(0.2 AS DOUBLE) ELSE 1.0 END AS quality_score FROM cut_chunks c JOIN (SELECT paper_id, title FROM papers) USING (paper_id) WHERE chunk <> ''""",
        "cut_chunks",
        "papers",
    )
)
def b8_b10_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = V.papers(spark, sf_dir)
    out = X.build_chunks(X.sectionize(X.clean(papers)), papers)
    return out.withColumns({"content": F.md5("content"), "index_text": F.md5("index_text")})


@query(
    f"""SELECT doc_id, CAST(i AS BIGINT) AS part, {trimmed(f"substr(text, i * {rules.MAX_CHARS - rules.OVERLAP_CHARS} + 1, {rules.MAX_CHARS})")} AS chunk FROM (
  SELECT doc_id, text, unnest(range(0, greatest(CAST(ceil((length(text) - {rules.MAX_CHARS}) / {float(rules.MAX_CHARS - rules.OVERLAP_CHARS)}) AS BIGINT), 0) + 1)) AS i FROM documents)"""
)
def b9_long_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = V.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.long_windows(F.col("text"))).alias("part", "chunk"))
    return docs.withColumn("part", F.col("part").cast("long"))


@query(over(f"""SELECT paper_id, section_type, count(*) AS n_chunks, md5(substr({trimmed("regexp_replace(arg_min(content, chunk_index), '\\s+', ' ', 'g')")}, 1, 500)) AS preview FROM chunks GROUP BY paper_id, section_type""", "chunks"))
def b11_sections_from_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.sections_from_chunks(V.chunks(spark, sf_dir), ("paper_id", "section_type"))
    return out.select("paper_id", "section_type", "n_chunks", F.md5("content_preview").alias("preview"))


_USABLE = f"NOT is_reference AND NOT is_noise AND section_type NOT IN ('REFERENCES', 'BACK_MATTER') AND {trimmed('content')} <> ''"
add_view("usable", ("chunks",), f"SELECT * FROM chunks WHERE {_USABLE}")


@query(over("SELECT chunk_id, section_type FROM usable", "usable"))
def b12_usable_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.usable_chunks(V.chunks(spark, sf_dir)).select("chunk_id", "section_type")


@query(over(f"SELECT chunk_id FROM usable WHERE length({trimmed('content')}) >= 20", "usable"))
def b13_summarizable_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.summarizable_chunks(V.chunks(spark, sf_dir)).select("chunk_id")


_LOW = f"lower({trimmed('content')})"
LOW_VALUE = (
    f"(length({_LOW}) >= 80 AND NOT regexp_matches({_LOW}, '^(references|reference|bibliography)') AND "
    f"(length({_LOW}) - length(replace({_LOW}, 'doi', ''))) / 3 + (length({_LOW}) - length(replace({_LOW}, 'http', ''))) / 4 < 3)"
)


@query(over(f"SELECT chunk_id FROM chunks WHERE {LOW_VALUE}", "chunks"))
def b14_drop_low_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.drop_low_value(V.chunks(spark, sf_dir)).select("chunk_id")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    extra = F.concat(
        F.lit("\nFigure "), i % 3 + 1, F.lit(". Overview of part "), i % 5, F.lit("\nfig "), i % 3 + 1, F.lit(": again\nTable 2: results\nx_"), i % 4,
        F.lit(" = y + 12 \nx_"), i % 4, F.lit(" = y + 12\nAlgorithm "), i % 2, F.lit(": train the model\n then\n \tPseudocode of it\nend"),
    )
    return V.table(spark, sf_dir, "documents").select(i.alias("page_id"), F.concat("text", extra).alias("text"))


add_view(
    "asset_pages",
    (),
    """SELECT doc_id AS page_id, text || chr(10) || 'Figure ' || (doc_id % 3 + 1) || '. Overview of part ' || (doc_id % 5) || chr(10) || 'fig ' || (doc_id % 3 + 1) || ': again' || chr(10) || 'Table 2: results'
  || chr(10) || 'x_' || (doc_id % 4) || ' = y + 12 ' || chr(10) || 'x_' || (doc_id % 4) || ' = y + 12' || chr(10) || 'Algorithm ' || (doc_id % 2) || ': train the model' || chr(10) || ' then' || chr(10) || ' ' || chr(9) || 'Pseudocode of it' || chr(10) || 'end' AS text FROM documents""",
)


@query(
    over(
        r"""SELECT page_id, asset_type, label, caption FROM (SELECT page_id, CASE WHEN k = 'table' THEN 'TABLE' ELSE 'FIGURE' END AS asset_type,
  CASE WHEN k = 'table' THEN 'table' ELSE 'figure' END || regexp_extract(x, '(?i)^(fig(?:ure)?\.?|table)\s*([0-9]+)', 2) AS label, regexp_extract(x, '(?i)^(fig(?:ure)?\.?|table)\s*([0-9]+)[.:]?\s*(.*)$', 3) AS caption,
  row_number() OVER (PARTITION BY page_id, CASE WHEN k = 'table' THEN 'table' ELSE 'figure' END || regexp_extract(x, '(?i)^(fig(?:ure)?\.?|table)\s*([0-9]+)', 2) ORDER BY pos) AS n
  FROM (SELECT *, lower(regexp_extract(x, '(?i)^(fig(?:ure)?\.?|table)', 1)) AS k FROM (SELECT page_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM asset_pages)
  WHERE regexp_matches(x, '(?i)^(fig(?:ure)?\.?|table)\s*([0-9]+)[.:]?\s*(.*)$'))) WHERE n = 1""",
        "asset_pages",
    )
)
def b15_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.extract_captions(_pages(spark, sf_dir), "page_id").select("page_id", "asset_type", "label", "caption")


add_view(
    "equations",
    ("asset_pages",),
    f"""SELECT page_id, pos, expression FROM (SELECT *, row_number() OVER (PARTITION BY page_id, expression ORDER BY pos) AS again FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n FROM (SELECT page_id, pos, {TRIM_LINE} AS expression FROM (
    SELECT page_id, unnest(string_split(text, chr(10))) AS x, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS pos FROM asset_pages))
  WHERE regexp_matches(expression, '[=≈≤≥]') AND length(expression) >= 8 AND NOT contains(lower(expression), 'http')) WHERE n <= 12) WHERE again = 1""",
)


@query(over("SELECT * FROM equations", "equations"))
def b16_equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.extract_equations(_pages(spark, sf_dir), "page_id").withColumn("pos", F.col("pos").cast("long"))


add_view(
    "algorithms",
    ("asset_pages",),
    f"""SELECT page_id, place, {trimmed("regexp_replace(substr(text, place, 1200), '\\s+', ' ', 'g')")} AS context FROM (SELECT page_id, text, x, CAST(coalesce(sum(length(x) + 1) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS BIGINT) AS place FROM (
  SELECT page_id, text, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM asset_pages)) WHERE regexp_matches(x, '(?i)^[ \t]*(algorithm|pseudocode|encode-process-decode)')""",
)


@query(over('SELECT page_id, place AS "at", context FROM algorithms', "algorithms"))
def b17_algorithms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.extract_algorithms(_pages(spark, sf_dir), "page_id").select("page_id", "at", "context")


@query(over(f"""SELECT page_id, {trimmed("regexp_replace(substr(text, 101, 500), '\\s+', ' ', 'g')")} AS nearby FROM asset_pages""", "asset_pages"))
def b18_nearby_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", X.nearby_text(F.col("text"), F.lit(101), 500).alias("nearby"))


_HASHED = "SELECT page_id, '{kind}' AS asset_type, CAST({sure} AS DOUBLE) AS confidence, sha256({x}) AS content_hash, sha256('v1|' || page_id || '|{kind}|' || sha256({x})) AS revision, min(pos) AS pos FROM {table} GROUP BY page_id, {x}"


@query(over(_HASHED.format(kind="EQUATION", sure=0.55, x="expression", table="equations") + " UNION ALL " + _HASHED.format(kind="ALGORITHM", sure=0.6, x="context", table="algorithms").replace("min(pos)", "min(place)"), "equations", "algorithms"))
def b19_asset_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    algorithms = X.extract_algorithms(pages, "page_id").withColumnRenamed("at", "pos")
    return X.asset_rows(X.extract_equations(pages, "page_id"), "EQUATION", 0.55, "v1").unionByName(X.asset_rows(algorithms, "ALGORITHM", 0.6, "v1", text="context"))


@query(f"""SELECT doc_id, substr({trimmed("regexp_replace(regexp_replace(text, '[\\x00-\\x1f\\x7f]', ' ', 'g'), '\\s+', ' ', 'g')")}, 1, 300) AS preview FROM documents""")
def b22_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select("doc_id", X.preview_text(F.col("text")).alias("preview"))
