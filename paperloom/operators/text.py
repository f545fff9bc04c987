"""Text cleaning, sectioning and chunking over whole tables of papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom import rules
from paperloom.functions import text as T


def clean(papers: DataFrame, text: str = "text") -> DataFrame:
    return papers.withColumn(text, T.clean_text(F.col(text)))


def noise_profile(docs: DataFrame, text: str = "text") -> DataFrame:
    """rule, lines: how many lines meet each noise rule first."""
    lines = docs.select(F.explode(F.split(F.col(text), "\n")).alias("line"))
    return lines.withColumn("rule", T.noise_rule(F.col("line"))).where("rule IS NOT NULL").groupBy("rule").agg(F.count("*").alias("lines"))


def explode_lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    return docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "raw")).select(key, "pos", T.trim_all(F.col("raw")).alias("line"))


def sectionize(papers: DataFrame, key: str = "paper_id", text: str = "text") -> DataFrame:
    """key, section_index, section_title, section_type, content of cleaned papers.

    A heading opens a section and is not part of it; lines before the first one are the section "Unknown", if they have
    text. After a heading of references no line is a heading. A last section without text is dropped, unless it is the
    only one; so a paper without text has none. A filter on the text would be pushed below ``clean`` and run it twice. A
    paper's lines are windowed by paper, so no task holds more than its papers.
    """
    lines = explode_lines(papers, key, text)
    heading = (F.col("line") != "") & T.is_heading(F.col("line"))
    lines = lines.withColumn("h", heading).withColumn("refs", F.col("h") & (T.section_type_from_title(F.col("line")) == "REFERENCES"))
    whole, order = Window.partitionBy(key), Window.partitionBy(key).orderBy("pos")
    lines = lines.withColumn("done", F.max("refs").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    lines = lines.withColumn("h", F.col("h") & ~F.coalesce("done", F.lit(False)))
    lines = lines.withColumn("sec", F.sum(F.col("h").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("h"), F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    secs = lines.groupBy(key, "sec").agg(T.trim_all(body).alias("content"), F.max(F.when(F.col("h"), T.heading_title(F.col("line")))).alias("title"))
    some = F.sum(F.when((F.col("sec") > 0) | (F.col("content") != ""), 1).otherwise(0)).over(whole)
    secs = secs.withColumns({"last": F.max("sec").over(whole), "n": some})
    keep = (F.col("content") != "") | ((F.col("sec") > 0) & ((F.col("sec") < F.col("last")) | (F.col("n") == 1)))
    secs = secs.where(keep).withColumn("section_title", F.coalesce("title", F.lit("Unknown")))
    index = F.row_number().over(Window.partitionBy(key).orderBy("sec")) - 1
    return secs.select(key, index.alias("section_index"), "section_title", T.infer_section_type(F.col("section_title"), F.col("content")).alias("section_type"), "content")


def long_windows(text: Column, size: int = rules.MAX_CHARS, overlap: int = rules.OVERLAP_CHARS) -> Column:
    """array<string>: the text itself, or windows of ``size`` that overlap; trimmed, blank ones dropped."""
    n, step = F.length(text), size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int"))
    cut = F.transform(starts, lambda i: T.trim_all(F.substring(text, i * step + 1, F.lit(size))))
    return F.when(n <= size, F.array(T.trim_all(text))).otherwise(F.filter(cut, lambda x: x != ""))


def pack_paragraphs(content: Column, target: int = rules.TARGET_CHARS) -> Column:
    """array<string>: paragraphs put together up to ``target`` characters, a longer one alone; a fold over the section."""
    # Single spaces are left as they are, so a paragraph without other white space need not be searched for it.
    spaced = lambda x: T.has_any(x, ("  ", "\t", "\n", "\x0b", "\f", "\r"))
    parts = F.filter(F.transform(F.split(content, r"\n\s*\n"), lambda x: F.when(spaced(x), T.collapse(x)).otherwise(T.trim_all(x))), lambda x: x != "")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))
    flushed = lambda s: F.when(s["cur"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(s["cur"])))

    def step(s: Column, p: Column) -> Column:
        fits = F.length(s["cur"]) + F.length(p) + 2 <= target
        joined = F.when(s["cur"] == "", p).otherwise(F.concat(s["cur"], F.lit("\n\n"), p))
        return F.struct(
            F.when(fits, s["out"]).otherwise(F.concat(flushed(s), F.array(p))).alias("out"),
            F.when(fits, joined).otherwise(F.lit("")).alias("cur"),
        )

    return F.aggregate(parts, start, step, flushed)


def build_chunks(sections: DataFrame, titles: DataFrame, key: str = "paper_id") -> DataFrame:
    """Chunks of sections, numbered through the paper, with index text, sizes, flags and quality."""
    packed = sections.select("*", F.posexplode(F.flatten(F.transform(pack_paragraphs(F.col("content")), lambda x: long_windows(x)))).alias("part", "chunk"))
    rows = packed.where("chunk <> ''").join(titles.select(key, "title"), key)
    noise = (F.length("chunk") < rules.NOISE_CHARS) | (F.col("section_type") == "BACK_MATTER")
    header = F.concat(F.lit("Paper Title: "), "title", F.lit("\nSection Type: "), "section_type", F.lit("\nSection Title: "), "section_title", F.lit("\nContent:\n"), "chunk")
    return rows.select(
        key,
        (F.row_number().over(Window.partitionBy(key).orderBy("section_index", "part")) - 1).alias("chunk_index"),
        "section_index",
        "section_title",
        "section_type",
        F.col("chunk").alias("content"),
        header.alias("index_text"),
        T.token_estimate(F.col("chunk")).alias("token_count"),
        F.length("chunk").alias("char_count"),
        (F.col("section_type") == "REFERENCES").alias("is_reference"),
        noise.alias("is_noise"),
        F.when(noise, 0.2).otherwise(1.0).alias("quality_score"),
    )


def sections_from_chunks(chunks: DataFrame, keys=("paper_id", "section_index"), order: str = "chunk_index", chars: int = 500) -> DataFrame:
    """The preview of each section: its first chunk, white space collapsed, cut."""
    return chunks.groupBy(*keys).agg(F.substring(T.collapse(F.min_by("content", order)), 1, chars).alias("content_preview"), F.count("*").alias("n_chunks"))


def usable_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.where(~F.col("is_reference") & ~F.col("is_noise") & ~F.col("section_type").isin("REFERENCES", "BACK_MATTER") & (T.trim_all(F.col("content")) != ""))


def summarizable_chunks(chunks: DataFrame, min_chars: int = 20) -> DataFrame:
    out = usable_chunks(chunks).where(F.length(T.trim_all(F.col("content"))) >= min_chars)
    return out.where(~F.col("chunk_type").isin("table", "figure_caption")) if "chunk_type" in chunks.columns else out


def drop_low_value(chunks: DataFrame, min_chars: int = 80) -> DataFrame:
    """Without short chunks, lists of references, and chunks full of links."""
    low = F.lower(T.trim_all(F.col("content")))
    links = T.occurrences(low, "doi") + T.occurrences(low, "http")
    return chunks.where((F.length(low) >= min_chars) & ~low.rlike(r"^(references|reference|bibliography)") & (links < 3))


def asset_rows(found: DataFrame, kind: str, confidence: float, version: str, key: str = "page_id", text: str = "expression") -> DataFrame:
    """key, asset_type, confidence, content_hash, revision, pos: each content of a page once, where it first stands."""
    rows = found.select(key, F.lit(kind).alias("asset_type"), F.lit(confidence).alias("confidence"), F.sha2(text, 256).alias("content_hash"), "pos")
    rows = rows.groupBy(key, "asset_type", "confidence", "content_hash").agg(F.min("pos").cast("long").alias("pos"))
    return rows.withColumn("revision", F.sha2(F.concat_ws("|", F.lit(version), F.col(key).cast("string"), "asset_type", "content_hash"), 256))


CAPTION = r"(?im)^(fig(?:ure)?\.?|table)\s*([0-9]+)[.:]?\s*(.*)$"


def extract_captions(pages: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, asset_type, label, caption, pos: the first caption of each figure and table."""
    t = F.col(text)
    parts = F.arrays_zip(*[F.regexp_extract_all(t, F.lit(CAPTION), F.lit(i)).alias(n) for i, n in ((1, "kind"), (2, "no"), (3, "caption"))])
    rows = pages.select(key, F.posexplode(parts).alias("pos", "c"))
    kind = F.when(F.lower("c.kind") == "table", "TABLE").otherwise("FIGURE")
    rows = rows.select(key, "pos", kind.alias("asset_type"), F.concat(F.when(kind == "TABLE", "table").otherwise("figure"), "c.no").alias("label"), F.col("c.caption").alias("caption"))
    first = Window.partitionBy(key, "label").orderBy("pos")
    return rows.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def extract_equations(pages: DataFrame, key: str, text: str = "text", most: int = 12) -> DataFrame:
    """key, pos, expression: lines with a relation sign; the first ``most`` of a page count, then repeats go."""
    lines = explode_lines(pages, key, text)
    lines = lines.where(F.col("line").rlike("[=≈≤≥]") & (F.length("line") >= 8) & ~F.lower("line").contains("http"))
    lines = lines.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).where(F.col("n") <= most)
    again = F.row_number().over(Window.partitionBy(key, F.sha2("line", 256)).orderBy("pos"))
    return lines.withColumn("again", again).where("again = 1").select(key, "pos", F.col("line").alias("expression"))


def extract_algorithms(pages: DataFrame, key: str, text: str = "text", chars: int = 1200) -> DataFrame:
    """key, at, context: every line that names an algorithm or speaks of encoding, processing and decoding, with the text from there on."""
    parts = F.split(F.concat(F.lit("\n"), F.col(text)), rules.ALGORITHM_LINE)
    # The line end put before makes the lengths so far the place of each part but the first.
    places = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.aggregate(F.slice(parts, 1, i), F.lit(0).cast("long"), lambda a, x: a + F.length(x)))
    rows = pages.where(F.size(parts) > 1).select(key, F.col(text).alias("_t"), F.explode(F.slice(places, 1, F.size(parts) - 1)).alias("at"))
    return rows.select(key, "at", T.collapse(F.substring(F.col("_t"), F.col("at"), F.lit(chars))).alias("context"))


def nearby_text(text: Column, start: Column, chars: int) -> Column:
    return T.collapse(F.substring(text, start, F.lit(chars)))


def preview_text(text: Column, chars: int = 300) -> Column:
    """Control characters to spaces, white space collapsed, cut."""
    return F.substring(T.collapse(F.regexp_replace(text, r"[\x00-\x1f\x7f]", " ")), 1, chars)
