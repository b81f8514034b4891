"""Audits of page corpora (page_id, url, html)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TAG = r"(?is)<[^>]*>"


def visible_text(html: Column, marker: str | None = None) -> Column:
    """Text of a page: script and style blocks, elements with the marker attribute, and tags go; white space is squeezed."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>", " ")
    if marker:
        out = F.regexp_replace(out, rf"(?is)<(\w+)[^>]*\s{marker}\b[^>]*>.*?</\1>", " ")
    out = F.regexp_replace(out, TAG, " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def extract_links(pages: DataFrame) -> DataFrame:
    """Columns page_id, target and query: internal links, without fragment and query; anchors, scripts and outside ones go."""
    links = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'(?i)href="([^"]*)"'), F.lit(1))).alias("_h"))
    inside = links.where(~F.col("_h").rlike(r"(?i)^(https?:|//|mailto:|javascript:|data:|tel:|#)") & (F.trim("_h") != ""))
    return inside.select("page_id", F.regexp_replace("_h", r"[?#].*$", "").alias("target"), F.regexp_extract("_h", r"\?([^#]*)", 1).alias("query")).where("target <> ''")


def broken_links(links: DataFrame, known: DataFrame) -> DataFrame:
    """Columns target, links and pages of targets that aren't ``known`` (target)."""
    per = links.groupBy("target").agg(F.count(F.lit(1)).alias("links"), F.count_distinct("page_id").alias("pages"))
    return per.join(known, "target", "left_anti")


def link_patterns(links: DataFrame) -> DataFrame:
    """Columns base, pattern and pages: links by their path's first part and their query with the values masked."""
    base = F.regexp_extract("target", r"^(/?[^/]*)", 1)
    return links.groupBy(base.alias("base"), F.regexp_replace("query", r"=[^&]*", "=*").alias("pattern")).agg(F.count_distinct("page_id").alias("pages"))


def image_alt_audit(pages: DataFrame) -> DataFrame:
    """Columns page_id, line, src and verdict (missing, empty, ok) of images; templated sources are skipped."""
    parts = pages.select("page_id", F.posexplode(F.split("html", r"(?i)(?=<img\b)")).alias("_n", "_part"), F.col("html"))
    rows = parts.select("page_id", "_n", "_part", F.sum(F.length("_part") - F.length(F.replace("_part", F.lit("\n"), F.lit("")))).over(Window.partitionBy("page_id").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)).alias("_lines"))
    tags = rows.where(F.col("_part").rlike(r"(?i)^<img\b")).withColumn("_tag", F.regexp_extract("_part", r"(?is)^(<img\b[^>]*>?)", 1))
    src = F.regexp_extract("_tag", r'(?i)\ssrc="([^"]*)"', 1)
    verdict = F.when(~F.col("_tag").rlike(r"(?i)\salt\s*="), "missing").when(F.trim(F.regexp_extract("_tag", r'(?i)\salt="([^"]*)"', 1)) == "", "empty").otherwise("ok")
    return tags.where(~F.contains(src, F.lit("${"))).select("page_id", (F.coalesce("_lines", F.lit(0)) + 1).cast("long").alias("line"), src.alias("src"), verdict.alias("verdict"))


def metadata_audit(pages: DataFrame) -> DataFrame:
    """Columns page_id, has_title, has_description, has_og_title, has_canonical and duplicate (an earlier page has the title).

    Each title is met with its first page, so that neither pages without a title nor those of a common one are a group.
    """
    title = F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    has = lambda pattern: F.col("html").rlike(pattern)
    rows = pages.select("page_id", title.alias("_title"), has(r'(?i)<meta[^>]*name="description"').alias("has_description"), has(r'(?i)<meta[^>]*property="og:title"').alias("has_og_title"), has(r'(?i)<link[^>]*rel="canonical"').alias("has_canonical"))
    first = rows.where("_title <> ''").groupBy(F.col("_title").alias("_t")).agg(F.min("page_id").alias("_first"))
    both = rows.join(first, F.when(F.col("_title") != "", F.col("_title")) == F.col("_t"), "left")
    return both.select("page_id", (F.col("_title") != "").alias("has_title"), "has_description", "has_og_title", "has_canonical", F.coalesce(F.col("page_id") > F.col("_first"), F.lit(False)).alias("duplicate"))


def block_audit(pages: DataFrame, start: str, end: str, placeholder: str = "{}") -> DataFrame:
    """Columns page_id and verdict of the block between two tags: missing, blank, placeholder or ok."""
    block = F.regexp_extract("html", rf"(?is){start}(.*?){end}", 1)
    verdict = F.when(~F.col("html").rlike(rf"(?is){start}.*?{end}"), "missing").when(F.trim(block) == "", "blank").when(F.trim(block) == placeholder, "placeholder").otherwise("ok")
    return pages.select("page_id", verdict.alias("verdict"))


def scan_markers(docs: DataFrame, key: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """Columns key, marker, hits and lines: pattern hits by document, with the numbers of the first three lines hit."""
    lines = docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("_n", "_line"))
    marks = F.array(*[F.when(F.col("_line").rlike(p), F.lit(m)) for m, p in patterns.items()])
    rows = lines.select(key, F.col("_n"), F.explode(F.array_compact(marks)).alias("marker"))
    per = rows.groupBy(key, "marker").agg(F.count(F.lit(1)).alias("hits"), F.slice(F.sort_array(F.collect_list(F.col("_n") + 1)), 1, 3).alias("_l"))
    return per.select(key, "marker", "hits", F.array_join(F.col("_l").cast("array<string>"), ",").alias("lines"))


def term_exposure(pages: DataFrame, lexicon: DataFrame, gates: DataFrame) -> DataFrame:
    """Columns page_id, term and ch of lexicon terms (any number of words) in visible text that the page's gate doesn't cover."""
    from factloom.operators.gates import _hits

    texts = pages.select("page_id", visible_text(F.col("html")).alias("text"))
    hits = _hits(texts, "page_id", "text", lexicon).join(gates.select("page_id", "gate", "scrubbed"), "page_id", "left")
    covered = F.coalesce("scrubbed", F.lit(False)) | (F.coalesce("gate", F.lit(0)) >= F.col("ch"))
    return hits.where(~covered).select("page_id", "term", "ch")


def wiring_audit(pages: DataFrame, flags: dict[str, str]) -> DataFrame:
    """One row: pages, and the share that contains each flag's text."""
    return pages.agg(F.count(F.lit(1)).alias("pages"), *[F.avg(F.contains("html", F.lit(v)).cast("double")).alias(k) for k, v in flags.items()])


def parse_table(pages: DataFrame) -> DataFrame:
    """Columns page_id, row, number, title and positions: rows of a page's first table with a number first and 3 cells or more."""
    body = F.regexp_extract("html", r"(?is)<table[^>]*>(.*?)</table>", 1)
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all(body, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row", "_r"))
    cells = F.transform(F.regexp_extract_all("_r", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, TAG, "")))
    out = rows.withColumn("_c", cells).where((F.size("_c") >= 3) & F.get("_c", F.lit(0)).rlike(r"^\d+$"))
    numbers = F.filter(F.transform(F.split(F.get("_c", F.lit(2)), "[|,/]"), lambda x: F.trim(x).try_cast("int")), lambda x: x.isNotNull())
    return out.select("page_id", "row", F.get("_c", F.lit(0)).cast("int").alias("number"), F.get("_c", F.lit(1)).alias("title"), numbers.alias("positions"))
