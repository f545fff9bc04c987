"""Knowledge units and reproduction facts: keys, conflicts, catalogs, topics, feedback, specs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom import rules
from paperloom.functions.text import collapse, trim_all


def mapped(column: Column, pairs, default) -> Column:
    """The value of the first pair whose key (or one of whose keys) the column equals."""
    out = None
    for key, value in pairs:
        test = column.isin(*value) if isinstance(value, tuple) else column == key
        result = key if isinstance(value, tuple) else value
        out = F.when(test, result) if out is None else out.when(test, result)
    return out.otherwise(default)


def join_nonblank(*columns: str) -> Column:
    """Trimmed values that are not blank, one a line."""
    parts = F.filter(F.array(*[trim_all(F.col(c).cast("string")) for c in columns]), lambda x: x.isNotNull() & (x != ""))
    return F.array_join(parts, "\n")


KEY_COLUMNS = ("knowledge_type", "subject_text", "predicate_text", "object_value")
GROUP_COLUMNS = ("knowledge_type", "subject_text", "predicate_text")


def normalized_key() -> Column:
    return F.sha2(join_nonblank(*KEY_COLUMNS), 256)


def loose(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), rules.LOOSE, "")


def tier_rank(tier: Column) -> Column:
    return mapped(F.upper(F.coalesce(tier, F.lit(""))), rules.TIERS, 1)


def family(kind: Column) -> Column:
    return mapped(kind, rules.FAMILIES, kind)


def split_tags(value: Column) -> Column:
    """Distinct tags of two or more characters, brackets and outer quotes gone."""
    bare = F.replace(F.replace(F.coalesce(value, F.lit("")), F.lit("["), F.lit("")), F.lit("]"), F.lit(""))
    tags = F.transform(F.split(bare, rules.TAG_SPLIT), lambda x: F.regexp_replace(trim_all(x), "^[\"']|[\"']$", ""))
    return F.array_distinct(F.filter(tags, lambda x: F.length(x) >= 2))


def units_from_profiles(profiles: DataFrame) -> DataFrame:
    """Five typed units of a profile and one for each keyword; blank values are dropped."""
    fields = (
        ("RESEARCH_PROBLEM", "addresses", "research_problem"), ("METHOD", "uses_method", "method_summary"),
        ("EXPERIMENT_SETTING", "evaluates_with", "experiment_summary"), ("CONTRIBUTION", "contributes", "key_contributions"),
        ("LIMITATION", "has_limitation", "limitations"),
    )
    unit = lambda kind, verb, value: F.struct(F.lit(kind).alias("knowledge_type"), F.lit(verb).alias("predicate_text"), value.alias("object_value"))
    typed = F.array(*[unit(k, v, F.col(c)) for k, v, c in fields])
    words = F.transform(split_tags(F.col("keywords")), lambda x: unit("KEYWORD", "has_keyword", x))
    rows = profiles.select("paper_id", F.col("title").alias("subject_text"), F.explode(F.concat(typed, words)).alias("u"))
    return rows.select("paper_id", "subject_text", "u.*").where(F.coalesce(trim_all(F.col("object_value")), F.lit("")) != "")


def section_unit_type(section: Column) -> Column:
    s = F.upper(F.coalesce(section, F.lit("")))
    out = F.when(s.contains("METHOD"), "METHOD").when(s.contains("EXPERIMENT"), "EXPERIMENT_SETTING").when(s.contains("RESULT"), "RESULT")
    out = out.when(s.contains("LIMIT"), "LIMITATION").when(s.contains("CONCLUSION"), "CONCLUSION").when(s.contains("INTRO") | s.contains("ABSTRACT"), "BACKGROUND")
    return out.otherwise("CONCLUSION")


def match_evidence(units: DataFrame, chunks: DataFrame) -> DataFrame:
    """Units with chunk_id and tier: the first chunk of their section whose normalised text holds the quote.

    Units meet only chunks of their own paper and section.
    """
    c = chunks.select("paper_id", "section_type", "chunk_id", "chunk_index", loose(F.col("content")).alias("text"))
    u = units.withColumn("quote", loose(F.col("quote")))
    found = u.where("quote <> ''").join(c, ["paper_id", "section_type"]).where(F.col("text").contains(F.col("quote")))
    found = found.groupBy("unit_id").agg(F.min_by("chunk_id", "chunk_index").alias("chunk_id"))
    return u.join(found, "unit_id", "left").withColumn("tier", F.when(F.col("chunk_id").isNotNull(), "SILVER").otherwise("BRONZE"))


def dedupe_units(units: DataFrame) -> DataFrame:
    """The first unit (smallest id) of each paper and key."""
    rows = units.withColumn("normalized_key", normalized_key())
    order = Window.partitionBy("paper_id", "normalized_key").orderBy("unit_id")
    return rows.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def flag_conflicts(units: DataFrame) -> DataFrame:
    """Units that can conflict, with conflict_group and has_conflict: several values for one subject and predicate."""
    able = F.col("knowledge_type").isin(*rules.CONFLICT_TYPES) & F.col("extraction_method").isin("LLM", "USER") & (F.col("verification_status") != "REJECTED")
    rows = units.where(able).withColumns({"conflict_group": F.sha2(join_nonblank(*GROUP_COLUMNS), 256), "value": loose(F.col("object_value"))})
    group = rows.groupBy("paper_id", "conflict_group").agg((F.count_distinct("value") > 1).alias("has_conflict"))
    return rows.join(group, ["paper_id", "conflict_group"])


def topic_label(units: DataFrame) -> Column:
    fits = lambda c: (F.length(c) >= 2) & (F.length(c) <= rules.TOPIC_LABEL_CHARS)
    value, subject = trim_all(F.col("object_value")), trim_all(F.col("subject_text"))
    return F.when(fits(value), value).when(F.col("extraction_method").isin("LLM", "USER") & fits(subject), subject)


def topics(units: DataFrame, kind: str | None, limit: int) -> DataFrame:
    """knowledge_type, label, papers, units: groups by normalised label, most units first."""
    rows = units.where("verification_status <> 'REJECTED'")
    rows = rows.where(F.col("knowledge_type") == kind) if kind else rows.where(F.col("knowledge_type").isin(*rules.TOPIC_TYPES))
    rows = rows.withColumn("label", topic_label(rows)).where("label IS NOT NULL").withColumn("k", loose(F.col("label")))
    out = rows.groupBy("knowledge_type", "k").agg(F.min_by("label", "unit_id").alias("label"), F.count_distinct("paper_id").alias("papers"), F.count("*").alias("units"))
    return out.orderBy(F.desc("units"), "label", "knowledge_type").limit(max(1, min(limit, 200))).drop("k")


def select_units(units: DataFrame, types: tuple[str, ...], n: int) -> DataFrame:
    """unit_id, paper_id, pos: the best unit of each family first, then the best of the rest, up to the limit."""
    rows = units.where("verification_status <> 'REJECTED'")
    if types:
        rows = rows.where(F.col("knowledge_type").isin(*types))
    families = {next((f for f, members in rules.FAMILIES if t in members), t) for t in types}
    limit = max(max(1, min(n, 20)), len(families))
    order = [F.desc(tier_rank(F.col("confidence_level"))), F.desc(mapped(F.col("extraction_method"), rules.METHOD_PRIORITY, 0)), F.asc("unit_id")]
    lead = F.row_number().over(Window.partitionBy("paper_id", family(F.col("knowledge_type"))).orderBy(*order)) == 1 if types else F.lit(False)
    rows = rows.withColumn("lead", lead)
    pos = F.row_number().over(Window.partitionBy("paper_id").orderBy(F.desc("lead"), *order))
    return rows.withColumn("pos", pos).where(F.col("pos") <= limit).select("unit_id", "paper_id", "pos")


def list_units(units: DataFrame, sections: DataFrame, key: str = "unit_id") -> DataFrame:
    """Units that are not rejected, with their section's title, by type, section and id."""
    rows = units.where("verification_status <> 'REJECTED'").join(sections.select(key, "section_title"), key, "left")
    return rows.orderBy("knowledge_type", "section_title", key)


def extraction_batches(summaries: DataFrame, chunks: DataFrame, size: int = 3, n_chunks: int = 4, chars: int = 7000) -> DataFrame:
    """paper_id, batch, members, material: summaries (paper_id, section_id, summary, key_points), ``size`` to a batch, each
    with its section's first chunks (section_id, chunk_index, content), cut."""
    order = Window.partitionBy("section_id").orderBy("chunk_index")
    first = chunks.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n_chunks)
    texts = first.groupBy("section_id").agg(F.sort_array(F.collect_list(F.struct("_n", "content"))).alias("_cs"))
    rows = summaries.withColumn("n", F.row_number().over(Window.partitionBy("paper_id").orderBy("section_id"))).join(texts, "section_id", "left")
    told = F.concat_ws("\n", "summary", "key_points", F.array_join("_cs.content", "\n"))
    rows = rows.select("paper_id", F.floor((F.col("n") - 1) / size).alias("batch"), F.struct("n", told.alias("t")).alias("r"))
    out = rows.groupBy("paper_id", "batch").agg(F.count("*").alias("members"), F.sort_array(F.collect_list("r")).alias("rs"))
    return out.select("paper_id", "batch", "members", F.substring(F.array_join("rs.t", "\n"), 1, chars).alias("material"))


def catalog_listing(papers: DataFrame, catalogs: DataFrame) -> DataFrame:
    """paper_id, title, status of every paper; NOT_BUILT where there is no catalog row (paper_id, status)."""
    return papers.join(catalogs.select("paper_id", "status"), "paper_id", "left").select("paper_id", "title", F.coalesce("status", F.lit("NOT_BUILT")).alias("status"))


def build_catalog(units: DataFrame) -> DataFrame:
    """paper_id, tags by group (first seen order, limited), units, verified, text of the first 30 units, status.

    A catalog without a method is PARTIAL.
    """
    live = units.where("verification_status <> 'REJECTED'")
    groups = (
        ("domains", ("RESEARCH_DOMAIN", "KEYWORD"), 12), ("tasks", ("RESEARCH_TASK", "RESEARCH_PROBLEM"), 12), ("methods", ("METHOD", "MODEL_COMPONENT"), 16),
        ("datasets", ("DATASET",), 12), ("metrics", ("METRIC",), 12),
    )
    tags = live.select("paper_id", "unit_id", "knowledge_type", F.posexplode(split_tags(F.col("object_value"))).alias("pos", "tag"))
    tags = tags.withColumn("tag", F.substring("tag", 1, rules.TOPIC_LABEL_CHARS))
    kind = reduce(lambda e, g: e.when(F.col("knowledge_type").isin(*g[1]), g[0]), groups, F.when(F.lit(False), ""))
    firsts = tags.withColumn("grp", kind).where("grp IS NOT NULL").groupBy("paper_id", "grp", "tag").agg(F.min(F.struct("unit_id", "pos")).alias("at"))
    most = reduce(lambda e, g: e.when(F.col("grp") == g[0], g[2]), groups, F.when(F.lit(False), 0))
    ranked = firsts.withColumn("n", F.row_number().over(Window.partitionBy("paper_id", "grp").orderBy("at"))).where(F.col("n") <= most)
    listed = ranked.groupBy("paper_id").agg(
        *[F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("grp") == g, F.struct("n", "tag")))), lambda x: x["tag"]), "; ").alias(g) for g, _, _ in groups]
    )
    counts = live.groupBy("paper_id").agg(F.count("*").alias("units"), F.count_if(F.col("verification_status").isin("CONFIRMED", "CORRECTED")).alias("verified"))
    first = live.withColumn("n", F.row_number().over(Window.partitionBy("paper_id").orderBy("unit_id"))).where(F.col("n") <= 30)
    line = F.concat_ws(" ", "knowledge_type", "subject_text", "predicate_text", "object_value")
    texts = first.groupBy("paper_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", line.alias("t")))), lambda x: x["t"]), "\n").alias("catalog_text"))
    out = counts.join(texts, "paper_id").join(listed, "paper_id", "left")
    return out.withColumn("status", F.when(F.coalesce("methods", F.lit("")) != "", "COMPLETED").otherwise("PARTIAL"))


def apply_feedback(events: DataFrame) -> DataFrame:
    """unit_id, status, tier, object_value: the state after all events in order of time, then id.

    A correction's value holds until the next correction; a rejection or confirmation keeps it.
    """
    last = events.groupBy("unit_id").agg(
        F.max_by("action", F.struct("ts", "event_id")).alias("action"),
        F.max_by("object_value", F.when(F.col("object_value").isNotNull(), F.struct("ts", "event_id"))).alias("object_value"),
    )
    status = mapped(F.col("action"), (("CONFIRM", "CONFIRMED"), ("REJECT", "REJECTED"), ("CORRECT", "CORRECTED")), F.lit(None))
    return last.select("unit_id", status.alias("status"), F.when(F.col("action") == "REJECT", "BRONZE").otherwise("GOLD").alias("tier"), "object_value")


def feedback_audit(events: DataFrame) -> DataFrame:
    """event_id, unit_id, before, after: the value before and after every event."""
    order = Window.partitionBy("unit_id").orderBy("ts", "event_id")
    after = F.last("object_value", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    before = F.last("object_value", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return events.select("event_id", "unit_id", "action", before.alias("before"), after.alias("after"))


#: What a correction may change.
CORRECTED = ("subject_text", "predicate_text", "object_value", "value_unit", "applicable_condition")


def _valid(events: DataFrame) -> DataFrame:
    """Events that count, their fields null where they change nothing: a correction needs a value."""
    fields = {c: F.when((F.col("action") == "CORRECT") & (trim_all(F.col(c)) != ""), trim_all(F.col(c))) for c in CORRECTED}
    rows = events.withColumns(fields)
    return rows.where(F.col("action").isin("CONFIRM", "REJECT") | ((F.col("action") == "CORRECT") & F.col("object_value").isNotNull()))


def corrected_units(units: DataFrame, events: DataFrame) -> DataFrame:
    """``units`` after all ``events`` (event_id, unit_id, action, ts and the fields of ``CORRECTED``), in order of time, then id.

    A confirmation or rejection sets status and tier; a correction also overwrites the fields that it names, which hold
    until the next correction, and makes the unit a user's. normalized_key and conflict_group follow from what the unit
    says then. Units without a valid event keep what they have; fields that ``units`` lacks start as null.
    """
    when, own = F.struct("ts", "event_id"), [c for c in CORRECTED if c in units.columns]
    last = _valid(events).groupBy("unit_id").agg(
        F.max_by("action", when).alias("_action"), F.max(F.col("action") == "CORRECT").alias("_corrected"), *[F.max_by(c, F.when(F.col(c).isNotNull(), when)).alias(f"_{c}") for c in CORRECTED]
    )
    rows = units.join(last, "unit_id", "left")
    status = mapped(F.col("_action"), (("CONFIRM", "CONFIRMED"), ("REJECT", "REJECTED"), ("CORRECT", "CORRECTED")), F.col("verification_status"))
    changed = {c: F.coalesce(f"_{c}", *([c] if c in own else [])) for c in CORRECTED}
    changed |= {
        "verification_status": status,
        "confidence_level": F.when(F.col("_action") == "REJECT", "BRONZE").when(F.col("_action").isNotNull(), "GOLD").otherwise(F.col("confidence_level")),
        "extraction_method": F.when(F.col("_corrected"), "USER").otherwise(F.col("extraction_method")),
    }
    rows = rows.withColumns(changed).drop("_action", "_corrected", *[f"_{c}" for c in CORRECTED])
    return rows.withColumns({"normalized_key": normalized_key(), "conflict_group": F.sha2(join_nonblank(*GROUP_COLUMNS), 256)})


def correction_audit(units: DataFrame, events: DataFrame) -> DataFrame:
    """event_id, unit_id, action, field, before, after: what every event changed, status and tier included."""
    rows = _valid(events).join(units.select("unit_id", "verification_status", "confidence_level", *[F.col(c).alias(f"_{c}") for c in CORRECTED if c in units.columns]), "unit_id")
    order = Window.partitionBy("unit_id").orderBy("ts", "event_id")
    so_far, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    status = mapped(F.col("action"), (("CONFIRM", "CONFIRMED"), ("REJECT", "REJECTED"), ("CORRECT", "CORRECTED")), F.lit(None))
    tier = F.when(F.col("action") == "REJECT", "BRONZE").otherwise("GOLD")
    field = lambda name, before, after: F.struct(F.lit(name).alias("field"), before.alias("before"), after.alias("after"))
    told = [field("verification_status", F.coalesce(F.lag(status).over(order), "verification_status"), status), field("confidence_level", F.coalesce(F.lag(tier).over(order), "confidence_level"), tier)]
    for c in CORRECTED:
        first = F.col(f"_{c}") if f"_{c}" in rows.columns else F.lit(None).cast("string")
        told.append(field(c, F.coalesce(F.last(c, ignorenulls=True).over(ahead), first), F.coalesce(F.last(c, ignorenulls=True).over(so_far), first)))
    rows = rows.select("event_id", "unit_id", "action", F.array(*told).alias("told"))
    return rows.select("event_id", "unit_id", "action", F.inline("told")).where("NOT before <=> after")


def refreshed(stored: DataFrame, units: DataFrame, events: DataFrame, build) -> DataFrame:
    """A table derived by ``build`` from units, such as ``build_catalog`` or ``flag_conflicts``, after ``events``.

    Only papers of units with a valid event are built again, from ``corrected_units``; the rows of all others are those
    of ``stored``. The papers' ids are few beside the units; they are found by a join on the events' units.
    """
    touched = units.join(_valid(events).select("unit_id").distinct(), "unit_id", "left_semi").select("paper_id").distinct()
    own = units.join(touched, "paper_id", "left_semi")
    fresh = build(corrected_units(own, events.join(own.select("unit_id"), "unit_id", "left_semi")))
    return stored.join(touched, "paper_id", "left_anti").unionByName(fresh.select(*stored.columns))


# --- facts


def mine_hyperparameters(chunks: DataFrame) -> DataFrame:
    """paper_id, chunk_id, section_type, fact_type, fact_key, fact_value, unit, excerpt, confidence: every match of the parameter patterns."""
    s = F.upper(F.coalesce("section_type", F.lit("")))
    rows = chunks.where(~F.col("is_reference") & ~F.col("is_noise") & (s.contains("METHOD") | s.contains("EXPERIMENT") | s.contains("IMPLEMENT") | s.contains("MODEL")))
    total = lambda parts, n: F.aggregate(F.slice(parts, 1, n), F.lit(0), lambda a, x: a + F.length(x))

    def matches(name: str, pattern: str) -> Column:
        values, whole, between = (F.regexp_extract_all("content", F.lit(pattern), F.lit(1)), F.regexp_extract_all("content", F.lit(pattern), F.lit(0)), F.split("content", pattern))

        def row(value: Column, i: Column) -> Column:
            start = total(between, i + 1) + total(whole, i)  # characters before the match
            first = F.greatest(start - rules.EXCERPT_BEFORE, F.lit(0))
            size = start - first + F.length(F.get(whole, i)) + rules.EXCERPT_AFTER
            return F.struct(F.lit(name).alias("k"), value.alias("v"), F.substring(F.col("content"), first + 1, size).alias("e"))

        return F.transform(values, row)

    found = F.flatten(F.array(*[matches(*p) for p in rules.PARAMETERS]))
    rows = rows.select("paper_id", "chunk_id", "section_type", F.explode(found).alias("f"))
    unit = mapped(F.col("f.k"), tuple((u, (k,)) for k, u in rules.PARAMETER_UNITS), F.lit(None))
    return rows.select(
        "paper_id", "chunk_id", "section_type", F.lit("HYPERPARAMETER").alias("fact_type"), F.col("f.k").alias("fact_key"), F.col("f.v").alias("fact_value"), unit.alias("unit"), F.col("f.e").alias("excerpt"), F.lit(rules.FACT_CONFIDENCE).alias("confidence")
    )


def _plain(column: str) -> Column:
    return F.lower(collapse(F.coalesce(F.col(column), F.lit(""))))


def logical_key() -> Column:
    return F.concat_ws("|", _plain("fact_type"), _plain("fact_key"))


def merge_facts(facts: DataFrame) -> DataFrame:
    """One row for each paper, key and value: the most certain source (smallest on ties), how many support it and which."""
    rows = facts.where((trim_all(F.col("fact_key")) != "") & (trim_all(F.col("fact_value")) != "")).withColumns({"logical": logical_key(), "value": _plain("fact_value")})
    return rows.groupBy("paper_id", "logical", "value").agg(F.max_by("chunk_id", F.struct("confidence", -F.col("chunk_id"))).alias("chunk_id"), F.max("confidence").alias("confidence"), F.count("*").alias("support"), F.array_sort(F.collect_set("chunk_id")).alias("sources"))


def fact_conflicts(merged: DataFrame) -> DataFrame:
    """Merged facts with conflict_group where a paper has several values for a key."""
    several = merged.groupBy("paper_id", "logical").agg((F.count_distinct("value") > 1).alias("several"))
    group = F.when(F.col("several"), F.concat(F.lit("conflict-"), F.substring(F.sha2("logical", 256), 1, 16)))
    return merged.join(several, ["paper_id", "logical"]).withColumn("conflict_group", group).drop("several")


def fact_class(status: Column, confidence: Column, conflict: Column) -> Column:
    """trusted, review, inferred or conflict."""
    sure = status.isin("USER_CONFIRMED", "CROSS_CHECKED") | ((status == "EXTRACTED") & (confidence >= rules.TRUSTED_CONFIDENCE))
    return F.when(conflict.isNotNull(), "conflict").when(status == "MODEL_INFERRED", "inferred").when(F.coalesce(sure, F.lit(False)), "trusted").otherwise("review")


def critical_coverage(facts: DataFrame) -> DataFrame:
    """paper_id, coverage, missing: the share of critical groups with trusted facts, and the others' names in order."""
    group = F.when(F.lit(False), "")
    for name, types in rules.CRITICAL_GROUPS:
        group = group.when(F.col("fact_type").isin(*types), name)
    have = facts.groupBy("paper_id").agg(F.collect_set(F.when(F.col("class") == "trusted", group)).alias("have"))
    every = F.array(*[F.lit(n) for n, _ in rules.CRITICAL_GROUPS])
    missing = F.array_sort(F.array_except(every, "have"))
    n = len(rules.CRITICAL_GROUPS)
    return have.select("paper_id", F.round((n - F.size(missing)) / n, 4).alias("coverage"), F.array_join(missing, ",").alias("missing"))


def provenance_coverage(facts: DataFrame) -> DataFrame:
    """paper_id, coverage: the share of facts that name their source, page and evidence."""
    whole = F.col("source_kind").isNotNull() & F.col("page_number").isNotNull() & F.col("evidence_text").isNotNull()
    return facts.groupBy("paper_id").agg(F.round(F.avg(whole.cast("double")), 4).alias("coverage"))


def readiness(coverage: Column, conflicts: Column, missing: Column) -> Column:
    return F.when(coverage == 0, "NOT_READY").when(conflicts > 0, "NEEDS_REVIEW").when(missing != "", "PARTIAL").otherwise("READY")


def conflict_candidates(facts: DataFrame) -> DataFrame:
    """paper_id, conflict_group, fact_key (of the first fact), candidates: the facts of every conflict, in order of page, then id."""
    row = F.struct("page_number", "fact_id", "fact_key", "fact_value", "verification_status", "confidence")
    rows = facts.where(trim_all(F.col("conflict_group")) != "").groupBy("paper_id", "conflict_group").agg(F.sort_array(F.collect_list(row)).alias("candidates"))
    return rows.select("paper_id", "conflict_group", F.col("candidates")[0]["fact_key"].alias("fact_key"), "candidates")


def safe_defaults(missing: Column, conflicts: Column) -> Column:
    """array<string>: what a reader of a spec is told, from the names of missing groups (as ``critical_coverage`` lists
    them) and the number of conflicts."""
    lacks = F.split(F.coalesce(missing, F.lit("")), ",")
    test = {"always": F.lit(True), "conflicts": conflicts > 0}
    return F.filter(F.array(*[F.when(test.get(k, F.array_contains(lacks, k)), text) for k, text in rules.SAFE_DEFAULTS]), lambda x: x.isNotNull())


def spec_revision(facts: DataFrame, version: str) -> DataFrame:
    """paper_id, revision: a hash over the paper's facts in order of id."""
    row = F.struct("fact_id", F.concat_ws("|", F.col("fact_id").cast("string"), "fact_value", "verification_status").alias("line"))
    rows = facts.groupBy("paper_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return rows.select("paper_id", F.sha2(F.concat(F.lit(version + "\n"), F.array_join("rows.line", "\n")), 256).alias("revision"))
