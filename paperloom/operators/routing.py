"""Routing of questions: intents by words, model answers, decisions, terms and candidates from the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom import rules
from paperloom.functions.text import has_any, trim_all
from paperloom.operators.lexical import contained_terms, topk

Q = "question_id"


def _labels(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def route_questions(questions: DataFrame, question: str = "question", papers: str = "paper_ids") -> DataFrame:
    """Adds scope, intent, layer, confidence, types and sections to questions (question_id, question, paper_ids).

    Words of a sole route win over all; otherwise the routes whose words occur add up and the last one names the intent.
    A question about the whole library that asks for papers, and one that no route fits, fall back to the catalog or to
    profiles. Null questions fit no route.
    """
    q = F.lower(F.coalesce(F.col(question), F.lit("")))
    ids = F.size(F.array_distinct(F.filter(F.coalesce(F.col(papers), F.array().cast("array<bigint>")), lambda x: x > 0)))
    scope = F.when(ids == 0, "LIBRARY").when(ids == 1, "SINGLE").otherwise("MULTI")

    def gathered(place: int) -> Column:
        return F.array_distinct(F.flatten(F.array(*[F.when(has_any(q, r[1]), _labels(r[place])).otherwise(_labels(())) for r in rules.ROUTES])))

    intent, types, sections, sole = F.lit("OVERVIEW"), gathered(2), gathered(3), F.lit(False)
    for name, words, _, _ in rules.ROUTES:
        intent = F.when(has_any(q, words), name).otherwise(intent)
    for name, words, kinds, parts in reversed(rules.SOLE_ROUTES):
        hit = has_any(q, words)
        sole = sole | hit
        intent, types, sections = F.when(hit, name).otherwise(intent), F.when(hit, _labels(kinds)).otherwise(types), F.when(hit, _labels(parts)).otherwise(sections)
    rows = questions.withColumns({"scope": scope, "intent": intent, "types": types, "sections": sections})
    plain = F.size("types") == 0
    task = F.col("intent") == rules.SOLE_ROUTES[0][0]
    broad = has_any(q, rules.BROAD_WORDS) & (F.col("scope") == "LIBRARY")
    fuzzy, whole = has_any(q, rules.FUZZY_WORDS) & plain, has_any(q, rules.WHOLE_WORDS) & plain
    layer = F.when(broad | fuzzy, "PAPER_CATALOG").when(whole, "PROFILE_AND_SECTION").when(plain | task, "PAPER_PROFILE").otherwise("KNOWLEDGE_UNIT")
    confidence = F.when(~plain, "HIGH").when(~broad & fuzzy, "LOW").otherwise("MEDIUM")
    intent = F.when(broad, "DISCOVERY").when(fuzzy, "FUZZY").when(whole, "CROSS_SECTION").otherwise(F.col("intent"))
    return rows.withColumns({"layer": layer, "confidence": confidence, "intent": intent})


def needs_model_route(plans: DataFrame, question: str = "question") -> DataFrame:
    """Adds needs_model: the rules are not sure, or the question compares."""
    return plans.withColumn("needs_model", (F.col("confidence") != "HIGH") | has_any(F.lower(F.col(question)), rules.MODEL_MARKERS))


def _named(values: Column, allowed) -> Column:
    names = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.translate(F.upper(trim_all(x)), "- ", "__"))
    return F.array_distinct(F.filter(names, lambda x: x.isin(*allowed)))


def merge_routes(plans: DataFrame, answers: DataFrame, least: float = rules.MODEL_LEAST) -> DataFrame:
    """Plans with the labels of a model's JSON ``answers`` (question_id, raw), one for a question at most.

    Adds router_source: RULE without an answer, MODEL, or RULE_FALLBACK with the first reason in fallback_reason
    (NO_ANSWER, NOT_JSON, BAD_CONFIDENCE, LOW_CONFIDENCE, NO_LABEL), which leaves the plan as it was.
    """
    ddl = "intent string, knowledgeTypes array<string>, sectionTypes array<string>, confidence double, explanation string"
    bare = trim_all(F.regexp_replace(F.col("raw"), "```(json|JSON)?", ""))
    told = answers.select(Q, F.lit(True).alias("_asked"), trim_all(F.coalesce("raw", F.lit(""))).alias("_raw"), F.get_json_object(bare, "$").alias("_json"), F.from_json(bare, ddl).alias("_m"))
    rows = plans.join(told, Q, "left")
    level, kinds, parts = F.col("_m.confidence"), _named(F.col("_m.knowledgeTypes"), rules.KNOWLEDGE_LABELS), _named(F.col("_m.sectionTypes"), rules.SECTION_LABELS)
    reason = (
        F.when(F.col("_asked").isNull(), F.lit(None).cast("string"))
        .when(F.col("_raw") == "", "NO_ANSWER")
        .when(F.col("_json").isNull(), "NOT_JSON")
        .when(level.isNull() | F.isnan(level) | ~level.between(0, 1), "BAD_CONFIDENCE")
        .when(level < least, "LOW_CONFIDENCE")
        .when((F.size(kinds) == 0) & (F.size(parts) == 0), "NO_LABEL")
    )
    rows = rows.withColumns({"fallback_reason": reason, "_kinds": kinds, "_parts": parts})
    rows = rows.withColumn("router_source", F.when(F.col("_asked").isNull(), "RULE").when(F.col("fallback_reason").isNull(), "MODEL").otherwise("RULE_FALLBACK"))
    model = F.col("router_source") == "MODEL"
    intent = F.translate(F.upper(trim_all(F.col("_m.intent"))), "- ", "__")
    types = F.when(model, F.array_union("types", "_kinds")).otherwise(F.col("types"))
    return rows.withColumns(
        {
            "intent": F.when(model & intent.rlike(r"^[A-Z][A-Z0-9_]{1,39}$"), intent).otherwise(F.col("intent")),
            "layer": F.when(model & (F.size(types) > 0), "KNOWLEDGE_UNIT").otherwise(F.col("layer")),
            "confidence": F.when(model, F.when(level >= rules.MODEL_HIGH, "HIGH").otherwise("MEDIUM")).otherwise(F.col("confidence")),
            "types": types,
            "sections": F.when(model, F.array_union("sections", "_parts")).otherwise(F.col("sections")),
        }
    ).drop("_asked", "_raw", "_json", "_m", "_kinds", "_parts")


def validate_decisions(answers: DataFrame, labels: int, least: float = rules.MODEL_LEAST) -> DataFrame:
    """question_id, valid, confidence, needed for answers (question_id, label, choice, confidence, probabilities).

    Valid if ``labels`` labels are answered, each by one of three options with a probability each, which add up to one,
    the chosen one the largest, none of them uncertain or below ``least``, and some label needed. ``needed`` lists those
    labels in order, confidence is the smallest; both are null where the answer is not valid.
    """
    p = F.col("probabilities")
    parts = [p[c] for c in rules.CHOICES]
    usual = F.lit(True)
    for x in parts:
        usual = usual & F.coalesce(x.between(0, 1), F.lit(False))
    fits = (F.size(p) == len(rules.CHOICES)) & usual & (F.abs(sum(parts[1:], parts[0]) - 1) <= 0.01) & (p[F.col("choice")] + 0.00001 >= F.greatest(*parts))
    sure = F.col("confidence").between(0, 1) & (F.col("confidence") >= least) & F.col("choice").isin(*rules.CHOICES[:2])
    rows = answers.withColumn("_ok", F.coalesce(fits & sure, F.lit(False)))
    needed = F.sort_array(F.collect_set(F.when(F.col("choice") == "NEEDED", F.col("label"))))
    out = rows.groupBy(Q).agg(F.bool_and("_ok").alias("_ok"), F.count_distinct("label").alias("_n"), F.count("*").alias("_all"), needed.alias("needed"), F.min("confidence").alias("confidence"))
    out = out.withColumn("valid", F.col("_ok") & (F.col("_n") == labels) & (F.col("_all") == labels) & (F.size("needed") > 0))
    return out.select(Q, "valid", F.when(F.col("valid"), F.col("confidence")).alias("confidence"), F.when(F.col("valid"), F.col("needed")).alias("needed"))


def question_terms(questions: DataFrame, question: str = "question") -> DataFrame:
    """question_id, pos, term: Latin terms, then the Han letters that are left when phrases that tell nothing are cut."""
    text = F.coalesce(F.col(question), F.lit(""))
    latin = F.regexp_extract_all(text, F.lit(f"({rules.QUESTION_TERM})"), F.lit(1))
    han = F.regexp_replace(text, r"[^\p{IsHan}]", " ")
    for phrase in (*rules.STOP_TERMS, *rules.STOP_PHRASES):
        han = F.replace(han, F.lit(phrase), F.lit(" "))
    parts = F.transform(F.split(han, r"\s+"), lambda x: F.regexp_replace(F.regexp_replace(x, "^[请把给]", ""), "[有吗呢]$", ""))
    terms = F.array_distinct(F.concat(latin, F.filter(parts, lambda x: F.length(x) >= 2)))
    return questions.select(Q, F.posexplode(terms).alias("pos", "term"))


def loose(text: Column) -> Column:
    """Lower case without blanks and punctuation."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), rules.CATALOG_LOOSE, "")


def discover_catalog(questions: DataFrame, terms: DataFrame, catalog: DataFrame, n: int) -> DataFrame:
    """question_id, paper_id, score, rank: the ``n`` catalog rows (paper_id, text, publish_year) that hold most terms.

    A term of four or more letters counts twice; a question without terms takes the latest papers. Distinct terms meet
    the catalog by their rarest character gram, so no question is compared with every row.
    """
    asked = questions.select(Q).distinct()
    listed = terms.select(Q, loose(F.col("term")).alias("term")).where("term <> ''").join(asked, Q, "left_semi").distinct()
    rows = catalog.select("paper_id", "publish_year", loose(F.col("text")).alias("text"))
    held = contained_terms(rows, listed.select("term"), "paper_id", "text")
    worth = F.when(F.length("term") >= 4, 2.0).otherwise(1.0)
    scored = listed.join(held, "term").groupBy(Q, "paper_id").agg(F.round(F.sum(worth), 8).alias("score"))
    year = F.round(1.0 + F.coalesce(F.col("publish_year") / 10000, F.lit(0.0)), 8)
    latest = rows.select("paper_id", year.alias("score")).orderBy(F.desc("score"), "paper_id").limit(n).collect()  # n rows
    rest = asked.join(listed, Q, "left_anti")
    if latest:
        kind = rows.schema["paper_id"].dataType
        some = F.array(*[F.struct(F.lit(r["paper_id"]).cast(kind).alias("paper_id"), F.lit(r["score"]).alias("score")) for r in latest])
        scored = scored.unionByName(rest.select(Q, F.explode(some).alias("r")).select(Q, "r.paper_id", "r.score"))
    return topk(scored, n, (Q,), "paper_id")


def discovery_terms(questions: DataFrame, question: str = "question", keywords: tuple[str, ...] = ("keyword_terms", "keyword_query")) -> DataFrame:
    """question_id, pos, term: keywords, Latin terms, known terms and terms of graphs, none generic, the first ones.

    Keyword columns that ``questions`` lacks count as empty.
    """
    text = F.coalesce(F.col(question), F.lit(""))
    parts = [F.split(F.coalesce(F.col(c), F.lit("")), rules.TERM_SPLIT) for c in keywords if c in questions.columns]
    latin = F.regexp_extract_all(text, F.lit(f"({rules.LATIN_TERM})"), F.lit(1))
    known = F.filter(_labels(rules.KNOWN_TERMS), lambda x: F.lower(text).contains(F.lower(x)))
    graph = F.when(text.contains(rules.GRAPH_WORD), _labels(rules.GRAPH_TERMS)).otherwise(_labels(()))
    every = F.transform(F.concat(*parts, latin, known, graph), trim_all)
    kept = F.array_distinct(F.filter(every, lambda x: (F.length(x) >= 2) & ~F.lower(x).isin(*rules.GENERIC_TERMS)))
    return questions.select(Q, F.posexplode(F.slice(kept, 1, rules.MAX_TERMS)).alias("pos", "term"))
