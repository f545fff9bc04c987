"""Fusion of retrieval routes and ranking of papers by their evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom import rules
from paperloom.functions.text import has_any, trim_all
from paperloom.operators.lexical import topk

Q = "question_id"


def source_key() -> Column:
    return F.concat_ws(":", "source_type", "chunk_id")


def ranked_routes(hits: DataFrame) -> DataFrame:
    """Hits with their rank inside question and route, by score, then hit id."""
    order = Window.partitionBy(Q, "route").orderBy(F.desc("score"), "hit_id")
    return hits.withColumn("rank", F.row_number().over(order))


def rrf(routes: DataFrame, top: int, k: int = rules.RRF_K) -> DataFrame:
    """question_id, key, rrf, rank. A key that a route lists twice counts with its last rank."""
    last = routes.groupBy(Q, "key", "route").agg(F.max("rank").alias("rank"))
    fused = last.groupBy(Q, "key").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 10).alias("rrf"))
    return topk(fused, top, (Q,), "key", "rrf")


#: What a hit shows, whatever it points to.
SHOWN = ("paper_id", "section_type", "section_title", "content")


def hydrate(hits: DataFrame, chunks: DataFrame, papers: DataFrame) -> DataFrame:
    """Hits with title, section_type, section_title and content.

    Hits of chunks take these from their chunk, and are dropped where it is a reference, noise or gone. Profiles and
    section summaries (source_type) carry their own paper_id, section and ``payload`` text; without a paper they are
    dropped. Titles come from ``papers``.
    """
    kind = F.lower("source_type")
    own = kind.isin("paper_profile", "section_summary")
    plain = [c for c in hits.columns if c not in (*SHOWN, "payload")]
    live = chunks.where(~F.coalesce("is_reference", F.lit(False)) & ~F.coalesce("is_noise", F.lit(False))).select("chunk_id", *SHOWN)
    rows = hits.where(~F.coalesce(own, F.lit(False))).select(*plain).join(live, "chunk_id").select(*plain, *SHOWN)
    section = lambda c: (F.when(kind == "section_summary", F.col(c)) if c in hits.columns else F.lit(None).cast("string")).alias(c)
    told = hits.where(own & F.col("paper_id").isNotNull()).select(*plain, "paper_id", section("section_type"), section("section_title"), F.coalesce("payload", F.lit("")).alias("content"))
    rows = rows.unionByName(told).join(papers.select("paper_id", "title"), "paper_id", "left")
    return rows.withColumn("title", F.coalesce("title", F.lit(rules.UNKNOWN_TITLE)))


def hybrid_retrieve(asked: DataFrame, rewritten: DataFrame, lexical: DataFrame, k: int) -> DataFrame:
    """question_id, key, rrf, rank from three routes (question_id, chunk_id, rank), each cut at 3 k, 30 at most.

    ``rewritten`` has rows only for questions whose rewriting says something else.
    """
    most, routes = min(3 * k, 30), None
    for name, rows in (("dense", asked), ("rewritten", rewritten), ("lexical", lexical)):
        rows = rows.where(F.col("rank") <= most).select(Q, F.col("chunk_id").alias("key"), F.lit(name).alias("route"), "rank")
        routes = rows if routes is None else routes.unionByName(rows)
    return rrf(routes, k)


def discover(routes: DataFrame, meta: DataFrame, questions: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """question_id, pos, paper_id, key: evidence for questions to the whole library.

    ``routes`` (question_id, route, source_type, chunk_id, score, rank) are fused inside each source type, each cut at
    3 k, 30 at most; the papers are ranked by the fused hits and by how many ``terms`` (question_id, term) these hold,
    cut by the question's phrase, and dealt. ``meta`` has chunk_id, paper_id, title, section_title and content.
    """
    most = min(3 * k, 30)
    rows = routes.where(F.col("rank") <= most).withColumn("key", source_key())
    fused = None
    for kind, _ in rules.TYPE_WEIGHTS:
        part = rrf(rows.where(F.col("source_type") == kind).select(Q, "key", "route", "rank"), most)
        part = part.select(Q, "key", F.col("rrf").alias("score"), F.lit(kind).alias("source_type"))
        fused = part if fused is None else fused.unionByName(part)
    hits = fused.withColumn("chunk_id", F.substring_index("key", ":", -1).cast("long")).withColumn("hit_id", F.col("chunk_id")).join(meta, "chunk_id")
    ranked = rank_papers(hits, most, term_coverage(hits, terms), reviews_to_demote(hits, questions))
    chosen = select_candidates(ranked, questions, k)
    order = F.row_number().over(Window.partitionBy(Q).orderBy("rank")).alias("rank")
    rows = judged(hits, terms)
    return round_robin(rows, chosen.select(Q, "paper_id", order), k)


def aggregate_by_paper(hits: DataFrame, top: int) -> DataFrame:
    """question_id, paper_id, title, hits, max_score, avg_score, best (the two best hits' ids, best first), score, rank:
    half by share of hits, half by best score.

    The title is the first one that is not blank, in order of hit id. Hits without a score come last.
    """
    named = F.when(trim_all(F.col("title")) != "", F.struct("hit_id", "title"))
    place = F.row_number().over(Window.partitionBy(Q, "paper_id").orderBy(F.desc_nulls_last("score"), "hit_id"))
    rows = hits.where("paper_id IS NOT NULL").withColumn("_place", place)
    per = rows.groupBy(Q, "paper_id").agg(
        F.coalesce(F.min(named)["title"], F.lit(rules.UNKNOWN_TITLE)).alias("title"),
        F.count("*").alias("hits"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("max_score"),
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("avg_score"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("_place") <= 2, F.struct("_place", "hit_id")))), lambda x: x["hit_id"]).alias("best"),
    )
    most = F.max("hits").over(Window.partitionBy(Q))
    per = per.withColumn("score", F.round(F.col("hits") / most * 0.5 + F.col("max_score") * 0.5, 8))
    return topk(per, max(top, 1), (Q,), "paper_id")


def term_coverage(hits: DataFrame, terms: DataFrame) -> DataFrame:
    """question_id, paper_id, coverage: share of the question's distinct terms that the paper's factual hits contain."""
    wanted = terms.select(Q, F.lower(F.trim("term")).alias("term")).where(F.length("term") >= 2).distinct()
    counts = wanted.groupBy(Q).agg(F.count("*").alias("n"))
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))))
    facts = hits.where(F.lower("source_type") != "paper_profile").select(Q, "paper_id", text.alias("text"))
    found = facts.join(wanted, Q).where(F.col("text").contains(F.col("term"))).select(Q, "paper_id", "term").distinct()
    return found.groupBy(Q, "paper_id").agg(F.count("*").alias("found")).join(counts, Q).select(Q, "paper_id", (F.col("found") / F.col("n")).alias("coverage"))


def is_review(title: Column) -> Column:
    return has_any(F.lower(title), rules.REVIEW_WORDS)


def reviews_to_demote(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """question_id, paper_id of the reviews (by title) among the hits of questions that do not ask for reviews."""
    asking = questions.where(is_review(F.coalesce("question", F.lit("")))).select(Q)
    return hits.where(is_review(F.col("title"))).select(Q, "paper_id").distinct().join(asking, Q, "left_anti")


def type_scores(hits: DataFrame) -> DataFrame:
    """question_id, paper_id, source_type, normalized: (best + second / 4) over the type's best, 1 at most."""
    h = hits.where("paper_id IS NOT NULL").withColumns({"source_type": F.lower("source_type"), "score": F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(0.0))})
    h = h.where(F.col("source_type").isin(*[t for t, _ in rules.TYPE_WEIGHTS]))
    h = h.withColumn("n", F.row_number().over(Window.partitionBy(Q, "paper_id", "source_type").orderBy(F.desc("score")))).where("n <= 2")
    two = h.groupBy(Q, "paper_id", "source_type").agg(
        F.max(F.when(F.col("n") == 1, F.col("score"))).alias("best"), F.coalesce(F.max(F.when(F.col("n") == 2, F.col("score"))), F.lit(0.0)).alias("second")
    )
    top = F.max("best").over(Window.partitionBy(Q, "source_type"))
    two = two.withColumn("top", top)
    return two.select(Q, "paper_id", "source_type", "top", F.least(F.lit(1.0), (F.col("best") + rules.SECOND_HIT_WEIGHT * F.col("second")) / F.when(F.col("top") > 0, F.col("top"))).alias("normalized"))


def rank_papers(hits: DataFrame, top: int, coverage: DataFrame | None = None, reviews: DataFrame | None = None) -> DataFrame:
    """question_id, paper_id, score, covered_types, coverage, rank.

    ``coverage`` as from ``term_coverage``; ``reviews`` lists (question_id, paper_id) to demote.
    """
    weight = reduce(lambda e, t: e.when(F.col("source_type") == t[0], t[1]), rules.TYPE_WEIGHTS, F.when(F.lit(False), 0.0))
    per = type_scores(hits).groupBy(Q, "paper_id").agg(F.coalesce(F.sum(F.when(F.col("top") > 0, weight * F.col("normalized"))), F.lit(0.0)).alias("base"), F.count_if(F.col("top") > 0).alias("covered_types"))
    per = per.join(coverage, [Q, "paper_id"], "left") if coverage is not None else per.withColumn("coverage", F.lit(0.0))
    per = per.join(reviews.select(Q, "paper_id", F.lit(True).alias("review")).distinct(), [Q, "paper_id"], "left") if reviews is not None else per.withColumn("review", F.lit(None).cast("boolean"))
    per = per.withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))
    score = F.col("base") + F.greatest(F.lit(0), F.col("covered_types") - 1) * rules.CROSS_TYPE_BONUS + F.col("coverage") * rules.COVERAGE_WEIGHT
    score = F.when(F.col("review"), F.greatest(F.lit(0.0), score - rules.REVIEW_PENALTY)).otherwise(score)
    ranked = per.withColumn("score", F.round(score, 8)).select(Q, "paper_id", "score", "covered_types", "coverage")
    return topk(ranked, top, (Q,), "paper_id")


def candidate_policy(question: Column) -> Column:
    """struct<name, least, most, share> by the question's phrase."""
    q = F.lower(F.coalesce(question, F.lit("")))
    row = lambda name, least, most, share: F.struct(F.lit(name).alias("name"), F.lit(least).alias("least"), F.lit(most).alias("most"), F.lit(share).alias("share"))
    unique, which, several = rules.POLICIES
    phrase, least, most, share = rules.TWO_WHICH
    twice = (F.length(q) - F.length(F.replace(q, F.lit(phrase), F.lit("")))) >= 2 * len(phrase)
    out = F.when(has_any(q, unique[1]), row(unique[0], *unique[2:])).when(twice, row("two", least, most, share))
    return out.when(has_any(q, which[1]), row(which[0], *which[2:])).when(has_any(q, several[1]), row(several[0], *several[2:])).otherwise(row("default", *rules.DEFAULT_POLICY))


def select_candidates(ranked: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """question_id, paper_id, rank: papers over the policy's share of the top score, between its least and most.

    A question for the only paper takes the one with the widest term coverage, then the best score.
    """
    rows = ranked.join(questions.select(Q, candidate_policy(F.col("question")).alias("p")), Q)
    whole = Window.partitionBy(Q)
    best = F.row_number().over(whole.orderBy(F.desc("coverage"), F.desc("score"), "paper_id"))
    most = F.least(F.col("p.most"), F.lit(rules.MAX_SELECTED), F.lit(k))
    rows = rows.withColumns({"top": F.max("score").over(whole), "best": best, "most": most})
    over = F.col("score") >= F.col("top") * F.col("p.share")
    keep = F.when(F.col("p.name") == "unique", F.col("best") == 1).otherwise((F.col("rank") <= F.col("most")) & (over | (F.col("rank") <= F.least("p.least", "most"))))
    return rows.where(keep).select(Q, "paper_id", "rank")


def background_only(title: Column, content: Column) -> Column:
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(content, F.lit(""))))
    return has_any(text, rules.BACKGROUND_MARKS) & ~has_any(text, rules.DIRECT_MARKS)


def judged(hits: DataFrame, terms: DataFrame) -> DataFrame:
    """Hits (with title, section_title and content) with background and matches, the number of the question's ``terms`` that they hold."""
    listed = terms.groupBy(Q).agg(F.collect_set("term").alias("terms"))
    text = F.lower(F.concat_ws(" ", "title", "section_title", "content"))
    matches = F.coalesce(F.size(F.filter("terms", lambda t: text.contains(F.lower(t)))), F.lit(0))
    return hits.join(listed, Q, "left").withColumns({"background": background_only(F.col("section_title"), F.col("content")), "matches": matches}).drop("terms")


def round_robin(hits: DataFrame, ranked: DataFrame, k: int, continue_rounds: bool = False) -> DataFrame:
    """question_id, pos, paper_id, key: evidence dealt over the ranked papers.

    First a profile (or else the best hit) of every paper, then its best factual hit not taken yet (direct before
    background, more term matches, summaries before raw, score), then in rounds each paper's next best hits. As in the
    source of these rules, dealing ends at the first round that adds nothing, unless ``continue_rounds``.
    Hits need key, score, source_type, background (boolean) and matches; ``ranked`` has question_id, paper_id, rank.
    """
    rows = hits.join(ranked.select(Q, "paper_id", F.col("rank").alias("paper_rank")), [Q, "paper_id"])
    best = Window.partitionBy(Q, "paper_id", "key").orderBy(F.desc_nulls_last("score"), "hit_id")
    rows = rows.withColumn("n", F.row_number().over(best)).where("n = 1").drop("n")
    paper = Window.partitionBy(Q, "paper_id")
    rows = rows.withColumn("place", F.row_number().over(paper.orderBy(F.desc_nulls_last("score"), "hit_id")) - 1)
    profile = F.lower("source_type") == "paper_profile"
    first = F.row_number().over(paper.orderBy(F.when(profile, 0).otherwise(1), "place"))
    rows = rows.withColumn("phase", F.when(first == 1, 1))
    kind = F.when(F.lower("source_type") == "section_summary", 2).otherwise(1)
    fact = F.row_number().over(paper.orderBy(F.when(profile | (F.col("phase") == 1), 1).otherwise(0), F.when(F.col("background"), 1).otherwise(0), F.desc("matches"), F.desc(kind), F.desc_nulls_last("score"), "hit_id"))
    rows = rows.withColumn("phase", F.coalesce("phase", F.when(~profile & (fact == 1), 2), F.lit(3)))
    rounds = rows.groupBy(Q, F.col("place")).agg(F.count_if(F.col("phase") == 3).alias("added"))
    # The first round without a new hit: the smallest place, gaps included, at which no row is of phase 3.
    empty = rounds.groupBy(Q).agg(F.coalesce(F.min(F.when(F.col("added") == 0, F.col("place"))), F.max("place") + 1).alias("stop"))
    rows = rows.join(empty, Q)
    if not continue_rounds:
        rows = rows.where((F.col("phase") < 3) | (F.col("place") < F.col("stop")))
    turn = F.when(F.col("phase") == 3, F.col("place")).otherwise(F.lit(0))
    order = Window.partitionBy(Q).orderBy("phase", turn, "paper_rank")
    return rows.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k).select(Q, "pos", "paper_id", "key")


def compare_runs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per question: papers and hits of two runs, and how many papers are only in the one or the other."""
    def side(df: DataFrame, s: str) -> DataFrame:
        return df.groupBy(Q).agg(F.collect_set("paper_id").alias(f"set_{s}"), F.count("*").alias(f"hits_{s}"), F.round(F.avg("score"), 8).alias(f"avg_{s}"))

    both = side(old, "old").join(side(new, "new"), Q, "full")
    none = F.array().cast("array<bigint>")
    a, b = F.coalesce("set_old", none), F.coalesce("set_new", none)
    return both.select(Q, F.size(a).cast("long").alias("papers_old"), F.size(b).cast("long").alias("papers_new"), "hits_old", "hits_new", "avg_old", "avg_new",
                       F.size(F.array_except(b, a)).cast("long").alias("gained"), F.size(F.array_except(a, b)).cast("long").alias("lost"))
