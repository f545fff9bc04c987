"""Fields of model output, workflow states, ideas from dialogue, and drafts with their sources and revisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom import rules
from paperloom.functions.text import collapse, trim_all
from paperloom.operators.dialogue import citations

# --- vector points


def build_points(chunks: DataFrame) -> DataFrame:
    """chunk_id, text to embed and payload columns; ``preview`` holds 300 characters without control characters."""
    shown = collapse(F.regexp_replace(F.coalesce("content", F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{10000}-\x{10FFFF}]", " "))
    index = F.col("index_text") if "index_text" in chunks.columns else F.lit(None).cast("string")
    return chunks.select(
        "chunk_id", "paper_id", F.coalesce("section_type", F.lit("UNKNOWN")).alias("section_type"), F.coalesce("section_title", F.lit("")).alias("section_title"), "chunk_index",
        F.coalesce("is_reference", F.lit(False)).alias("is_reference"), F.coalesce("is_noise", F.lit(False)).alias("is_noise"), F.lit("RAW_CHUNK").alias("content_type"),
        F.when(trim_all(index) != "", index).otherwise(F.coalesce("content", F.lit(""))).alias("embedding_text"), F.substring(shown, 1, 300).alias("preview"),
    )


# --- fields of model output


def field(text: Column, label: str, following: str | None) -> Column:
    """The text between the mark of ``label`` and that of ``following``, or the end; empty without the first mark.

    A mark stands at the head of a line, behind heading signs, bullets, numbers or bold marks, with or without a colon.
    """
    mark = lambda x: rf"{rules.FIELD_MARK}\Q{x}\E"
    stop = rf"(?={mark(following)}|\z)" if following else r"\z"
    found = F.regexp_extract(F.coalesce(text, F.lit("")), rf"{mark(label)}{rules.FIELD_END}((?s:.*?)){stop}", 1)
    return trim_all(F.regexp_replace(found, r"^[\s:：\-—]+", ""))


def extract_fields(rows: DataFrame, labels: tuple[str, ...], text: str = "text") -> DataFrame:
    """Adds ``fields``, array<struct<label, value>> in the order of ``labels``, which follow each other in the text.

    A blank one says that it is missing; the last one takes the whole text instead.
    """
    values = []
    for i, label in enumerate(labels):
        value = field(F.col(text), label, labels[i + 1] if i + 1 < len(labels) else None)
        other = F.col(text) if i + 1 == len(labels) else F.lit(rules.MISSING_FIELD)
        values.append(F.struct(F.lit(label).alias("label"), F.when(value == "", other).otherwise(value).alias("value")))
    return rows.withColumn("fields", F.array(*values))


def is_useful(text: Column) -> Column:
    flat = collapse(F.coalesce(text, F.lit("")))
    return (F.length(flat) >= 20) & (~flat.rlike(rules.UNUSABLE) | (F.length(flat) > 80))


def fallback_summary(rows: DataFrame, text: str = "text", summary: str = "summary", points: str = "key_points") -> DataFrame:
    """A missing summary becomes the flat text, cut; missing key points its first bullet lines, if the text is useful."""
    flat = F.substring(collapse(F.regexp_replace(F.col(text), r"(?m)^\s*[-*]\s*", "")), 1, 300)
    lines = F.filter(F.transform(F.split(F.col(text), r"\r\n|\n|\r"), trim_all), lambda x: x.startswith("-") | x.startswith("•") | x.rlike(r"^\d+[.)、]"))
    useful = is_useful(F.col(text))
    return rows.withColumns(
        {
            summary: F.when((F.col(summary) == rules.MISSING_FIELD) & useful, flat).otherwise(F.col(summary)),
            points: F.when((trim_all(F.col(points)) == "") & useful, F.array_join(F.slice(lines, 1, 6), "\n")).otherwise(F.col(points)),
        }
    )


def units_from_json(answers: DataFrame, sections: DataFrame, labels: tuple[str, ...] = rules.KNOWLEDGE_LABELS) -> DataFrame:
    """batch_id, pos, paper_id, section_id, knowledge_type, subject_text, predicate_text, object_value, quote.

    ``answers`` (batch_id, raw) hold a JSON array, or an object with ``units``, maybe in a code fence; a unit stays if its
    label is known, its section is one of its batch (``sections``: batch_id, section_id, paper_id, title) and it says
    something. Text that is no such JSON gives no unit.
    """
    unit = "struct<knowledgeType:string,sectionId:bigint,subject:string,predicate:string,objectValue:string,evidenceQuote:string>"
    bare = trim_all(F.regexp_replace(trim_all(F.col("raw")), r"(?s)^```[^\n]*\n(.*)```.*$", "$1"))
    listed = F.when(bare.startswith("["), F.from_json(bare, f"array<{unit}>")).otherwise(F.from_json(bare, f"struct<units:array<{unit}>>")["units"])
    rows = answers.select("batch_id", F.posexplode(listed).alias("pos", "u")).select("batch_id", "pos", "u.*")
    kind = F.when(trim_all(F.coalesce("knowledgeType", F.lit(""))) == "", "CONCLUSION").otherwise(F.translate(F.upper(trim_all(F.col("knowledgeType"))), "- ", "__"))
    rows = rows.withColumn("knowledge_type", kind).where(F.col("knowledge_type").isin(*labels) & (trim_all(F.col("objectValue")) != ""))
    rows = rows.join(sections.withColumnRenamed("section_id", "sectionId"), ["batch_id", "sectionId"])
    other = lambda c, instead: F.when(trim_all(F.coalesce(c, F.lit(""))) == "", instead).otherwise(F.col(c))
    return rows.select(
        "batch_id", "pos", "paper_id", F.col("sectionId").alias("section_id"), "knowledge_type", other("subject", F.col("title")).alias("subject_text"), other("predicate", F.lit("states")).alias("predicate_text"),
        F.col("objectValue").alias("object_value"), F.when(trim_all(F.col("evidenceQuote")) != "", trim_all(F.col("evidenceQuote"))).alias("quote"),
    )


# --- workflow


def workflow_state(papers: DataFrame) -> DataFrame:
    """Adds state, ready, processing and failed to papers (parse_status, vector_status, job_status, has_profile, index_complete)."""
    done = lambda c: F.upper(F.coalesce(c, F.lit(""))).isin(*rules.DONE_STATES)
    broken = lambda c: F.upper(F.coalesce(c, F.lit(""))).isin(*rules.FAILED_STATES)
    busy = lambda c: F.upper(F.coalesce(c, F.lit(""))) == "PROCESSING"
    parsed, stored = done("parse_status"), done("vector_status")
    state = (
        F.when(~parsed, F.when(broken("parse_status"), "parseFailed").otherwise("pendingParse"))
        .when(~stored, F.when(broken("vector_status"), "vectorFailed").otherwise("pendingVector"))
        .when(F.col("job_status") == "PROCESSING", "profileProcessing")
        .when(F.col("job_status") == "FAILED", "profileFailed")
        .when(~F.coalesce("has_profile", F.lit(False)), "pendingProfile")
        .when(~F.coalesce("index_complete", F.lit(False)), "pendingProfileIndex")
        .otherwise("ready")
    )
    working = F.when(~parsed, busy("parse_status")).when(~stored, busy("vector_status")).otherwise(F.col("state") == "profileProcessing")
    return papers.withColumn("state", state).withColumns({"ready": F.col("state") == "ready", "processing": working, "failed": F.col("state").endswith("Failed")})


# --- ideas


def suggest_ideas(pairs: DataFrame) -> DataFrame:
    """Adds reason to pairs (question, answer, verdict): ASKED for an improvement, ANSWERED with one, or null.

    ``verdict`` is a model's word on the answer; it counts only where the question looks for research.
    """
    said = trim_all(F.coalesce("verdict", F.lit("")))
    some = trim_all(F.coalesce("answer", F.lit(""))) != ""
    question = F.coalesce("question", F.lit(""))
    asked = question.rlike("(?i)" + rules.IMPROVEMENT_INTENT)
    answered = question.rlike("(?i)" + rules.RESEARCH_GATE) & (said.startswith("是") | (F.lower(said) == "yes"))
    return pairs.withColumn("reason", F.when(some & asked, "ASKED").when(some & answered, "ANSWERED"))


def idea_evidence(ideas: DataFrame, rows: DataFrame, text: Column, base: Column, weight: int, tie: str, n: int) -> DataFrame:
    """The ``n`` best ``rows`` (paper_id, ...) for each idea (idea_id, paper_id, text): its words in the row's text,
    times ``weight``, plus ``base``; ties by ``tie``. Adds idea_id, points and pos.

    Words are runs of letters, digits and underscores, three characters or more. Ideas meet only rows of their papers.
    """
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"), lambda x: F.length(x) >= 3))
    told = ideas.select("idea_id", "paper_id", words.alias("_words"))
    scored = rows.withColumns({"_text": F.lower(text), "_base": base}).join(told, "paper_id")
    scored = scored.withColumn("points", F.size(F.filter("_words", lambda w: F.col("_text").contains(w))).cast("long") * weight + F.col("_base")).drop("_words", "_text", "_base")
    order = Window.partitionBy("idea_id", "paper_id").orderBy(F.desc("points"), F.asc_nulls_last(tie))
    return scored.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= n)


# --- drafts


def _first_chunks(chunks: DataFrame, n: int) -> DataFrame:
    """The ``n`` best chunks of each paper inside the sections that drafts use, without references and noise."""
    rows = chunks.where(F.col("section_type").isin(*rules.WRITING_SECTIONS) & ~F.coalesce("is_reference", F.lit(False)) & ~F.coalesce("is_noise", F.lit(False)) & (trim_all(F.col("content")) != ""))
    order = Window.partitionBy("paper_id").orderBy(F.desc_nulls_last("quality_score"), "chunk_index", "chunk_id")
    return rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= n)


def bibliography(docs: DataFrame, papers: DataFrame, chunks: DataFrame, key: str = "project_id", text: str = "content") -> DataFrame:
    """key, paper_id, title, chunk_id, excerpt: each cited paper once with its best chunk, cut."""
    cited = citations(docs, key, text).select(key, "paper_id").distinct()
    best = _first_chunks(chunks, 1).select("paper_id", "chunk_id", F.substring("content", 1, 360).alias("excerpt"))
    return cited.join(papers.select("paper_id", "title"), "paper_id").join(best, "paper_id", "left").select(key, "paper_id", "title", "chunk_id", "excerpt")


def writing_evidence(projects: DataFrame, papers: DataFrame, profiles: DataFrame, summaries: DataFrame, chunks: DataFrame, chars: int = rules.WRITING_CHARS) -> DataFrame:
    """project_id, evidence: the selected papers' metadata, profile, three summaries and three best chunks, cut.

    ``projects`` (project_id, paper_ids), ``papers`` (paper_id, title, publish_year), ``profiles`` (paper_id, content,
    update_time; the latest counts), ``summaries`` (paper_id, section_id, section_type, section_title, content). A
    paper's block is built once; then papers join projects, and those that begin behind ``chars`` stay out.
    """
    cut = lambda c, n: F.substring(F.coalesce(c, F.lit("")), 1, n)
    head = papers.select("paper_id", F.lit(0).alias("step"), F.lit(0).alias("n"), F.concat_ws("\n", F.concat(F.lit("=== [P"), "paper_id", F.lit("] ===")), F.coalesce("title", F.lit("")), F.coalesce(F.col("publish_year").cast("string"), F.lit("?"))).alias("line"))
    last = profiles.groupBy("paper_id").agg(F.max_by("content", F.struct("update_time", "content")).alias("content")).select("paper_id", F.lit(1).alias("step"), F.lit(0).alias("n"), cut(F.col("content"), 2600).alias("line"))
    few = summaries.where(F.col("section_type").isin(*rules.WRITING_SECTIONS)).withColumn("n", F.row_number().over(Window.partitionBy("paper_id").orderBy("section_id"))).where("n <= 3")
    few = few.select("paper_id", F.lit(2).alias("step"), "n", F.concat(F.lit("["), F.coalesce("section_title", F.lit("")), F.lit("] "), cut(F.col("content"), 700)).alias("line"))
    raw = _first_chunks(chunks, 3).select("paper_id", F.lit(3).alias("step"), "n", F.concat(F.lit("chunk#"), "chunk_id", F.lit(" "), cut(F.col("content"), 900)).alias("line"))
    blocks = head.unionByName(last).unionByName(few).unionByName(raw).groupBy("paper_id").agg(F.sort_array(F.collect_list(F.struct("step", "n", "line"))).alias("ls"))
    blocks = blocks.select("paper_id", F.concat(F.array_join("ls.line", "\n"), F.lit("\n")).alias("block"))
    chosen = projects.select("project_id", F.posexplode(F.array_distinct("paper_ids")).alias("pos", "paper_id")).join(blocks, "paper_id")
    ahead = F.coalesce(F.sum(F.length("block")).over(Window.partitionBy("project_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = chosen.withColumn("_ahead", ahead).where(F.col("_ahead") < chars)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "block"))), lambda x: x["block"]), "")
    return chosen.groupBy("project_id").agg(F.substring(text, 1, chars).alias("evidence"))


def parse_outlines(drafts: DataFrame, most: int = 7, least_words: int = 300) -> DataFrame:
    """project_id, pos, heading, words for drafts (project_id, raw, allowed_ids, target_words).

    The JSON object's ``sections`` count if there is one and their sourcePaperIds are all allowed; otherwise the default
    outline holds. Headings that are blank are left out, the first ``most`` stay and share the words.
    """
    told = F.from_json(F.regexp_extract(F.coalesce("raw", F.lit("")), r"(?s)(\{.*\})", 1), "struct<sections:array<struct<heading:string,sourcePaperIds:array<bigint>>>>")["sections"]
    none = F.array().cast("array<bigint>")
    foreign = F.exists(told, lambda s: F.size(F.array_except(F.coalesce(s["sourcePaperIds"], none), F.coalesce(F.col("allowed_ids"), none))) > 0)
    usable = F.coalesce((F.size(told) > 0) & ~foreign, F.lit(False))
    plain = F.array(*[F.lit(x) for x in rules.DEFAULT_OUTLINE])
    heads = F.filter(F.transform(told, lambda s: trim_all(F.coalesce(s["heading"], F.lit("")))), lambda x: x != "")
    heads = F.slice(F.when(usable, F.when(F.size(heads) > 0, heads).otherwise(F.slice(plain, 1, 1))).otherwise(plain), 1, most)
    rows = drafts.select("project_id", "target_words", heads.alias("heads"))
    words = F.greatest(F.lit(least_words), F.floor(F.col("target_words") / F.size("heads"))).cast("long")
    return rows.select("project_id", words.alias("words"), F.posexplode("heads").alias("pos", "heading"))


def revisions(rows: DataFrame) -> DataFrame:
    """Revisions (project_id, revision_id, create_time, ...) with their place, newest first."""
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("create_time"), F.desc("revision_id"))))


def restore_revisions(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """``rows`` (project_id, revision_id, kind, content, create_time) and a new row for each choice (project_id, revision_id, at).

    The new one takes the old content and the next number of its project; a choice that is no revision of its project
    adds nothing.
    """
    last = rows.groupBy("project_id").agg(F.max("revision_id").alias("last"))
    again = chosen.join(rows, ["project_id", "revision_id"]).join(last, "project_id")
    again = again.withColumn("n", F.row_number().over(Window.partitionBy("project_id").orderBy("at", "revision_id")))
    added = again.select("project_id", (F.col("last") + F.col("n")).alias("revision_id"), F.lit("VERSION_RESTORED").alias("kind"), "content", F.col("at").alias("create_time"))
    return rows.select(added.columns).unionByName(added)
