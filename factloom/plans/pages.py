"""Audits of the pages table."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import pages as p
from factloom.plans.registry import query
from factloom.session import table

_LINKS = """raw AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)href="([^"]*)"', 1)) AS h FROM pages),
  links AS (SELECT page_id, regexp_replace(h, '[?#].*$', '') AS target, regexp_extract(h, '\\?([^#]*)', 1) AS query FROM raw WHERE NOT regexp_matches(h, '(?i)^(https?:|//|mailto:|javascript:|data:|tel:|#)') AND trim(h) <> '' AND regexp_replace(h, '[?#].*$', '') <> '')"""
_TEXT = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b[^>]*>.*?</(script|style)>', ' ', 'g'), '(?is)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g'))"""


@query("i1_extract_links", f"WITH {_LINKS} SELECT * FROM links")
def links(spark, sf_dir):
    return p.extract_links(table(spark, sf_dir, "pages"))


@query("i1_broken_links", f"WITH {_LINKS} SELECT target, count(*) AS links, count(DISTINCT page_id) AS pages FROM links WHERE target NOT IN (SELECT regexp_extract(url, 'https?://[^/]*(/[^?#]*)', 1) FROM pages UNION SELECT '/the') GROUP BY 1")
def broken(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    known = pages.select(F.regexp_extract("url", r"https?://[^/]*(/[^?#]*)", 1).alias("target")).union(spark.createDataFrame([("/the",)], "target string")).distinct()
    return p.broken_links(p.extract_links(pages), known)


@query("i2_link_patterns", f"WITH {_LINKS} SELECT regexp_extract(target, '^(/?[^/]*)', 1) AS base, regexp_replace(query, '=[^&]*', '=*', 'g') AS pattern, count(DISTINCT page_id) AS pages FROM links GROUP BY 1, 2")
def patterns(spark, sf_dir):
    return p.link_patterns(p.extract_links(table(spark, sf_dir, "pages")))


@query("i3_image_alt_audit", """WITH x AS (SELECT page_id, unnest([1, 2]) AS line, page_id % 3 AS k FROM pages) SELECT page_id, CAST(line AS BIGINT) AS line, CASE line WHEN 1 THEN '/a.png' ELSE '/b.png' END AS src, CASE WHEN line = 1 THEN 'missing' WHEN k = 0 THEN 'empty' ELSE 'ok' END AS verdict FROM x""")
def images(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    first = F.concat(F.lit('<p><img src="/a.png"></p>\n<img src="/b.png" alt="'), F.when(F.col("page_id") % 3 == 0, "").otherwise(F.col("url")), F.lit('"><img src="${x}" alt="">'))
    return p.image_alt_audit(pages.select("page_id", F.concat(first, "html").alias("html")))


@query("i4_metadata_audit", """WITH m AS (SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS t, html FROM pages)
  SELECT page_id, t <> '' AS has_title, regexp_matches(html, '(?i)<meta[^>]*name="description"') AS has_description, regexp_matches(html, '(?i)<meta[^>]*property="og:title"') AS has_og_title, regexp_matches(html, '(?i)<link[^>]*rel="canonical"') AS has_canonical, t <> '' AND row_number() OVER (PARTITION BY t ORDER BY page_id) > 1 AS duplicate FROM m""")
def metadata(spark, sf_dir):
    return p.metadata_audit(table(spark, sf_dir, "pages"))


@query("i5_block_audit", "SELECT page_id, CASE WHEN NOT regexp_matches(html, '(?is)<style>.*?</style>') THEN 'missing' WHEN trim(regexp_extract(html, '(?is)<style>(.*?)</style>', 1)) = '' THEN 'blank' WHEN trim(regexp_extract(html, '(?is)<style>(.*?)</style>', 1)) = 'p{margin:0}' THEN 'placeholder' ELSE 'ok' END AS verdict FROM pages")
def blocks(spark, sf_dir):
    return p.block_audit(table(spark, sf_dir, "pages"), "<style>", "</style>", "p{margin:0}")


@query("i6_scan_markers", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents), h AS (SELECT doc_id, n, 'shout' AS marker FROM l WHERE regexp_matches(line, '[A-Z]{6,}') UNION ALL SELECT doc_id, n, 'cell' FROM l WHERE regexp_matches(line, ' [|] '))
  SELECT doc_id, marker, count(*) AS hits, array_to_string(list_sort(list(n))[1:3], ',') AS lines FROM h GROUP BY 1, 2""")
def markers(spark, sf_dir):
    return p.scan_markers(table(spark, sf_dir, "documents"), "doc_id", "text", {"shout": "[A-Z]{6,}", "cell": " [|] "})


@query("i7_term_exposure", f"""WITH lex AS (SELECT unnest(['the', 'idiot', 'des', 'with']) AS term, unnest([5, 40, 60, 10]) AS ch), w AS (SELECT DISTINCT page_id, unnest(regexp_split_to_array(lower({_TEXT}), '[^\\p{{L}}\\p{{N}}]+')) AS term FROM pages)
  SELECT page_id, term, ch FROM w JOIN lex USING (term) WHERE NOT (page_id % 10 = 0 OR page_id % 50 >= ch)""")
def exposure(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    lexicon = spark.createDataFrame([("the", 5), ("idiot", 40), ("des", 60), ("with", 10)], "term string, ch int")
    return p.term_exposure(pages, lexicon, pages.select("page_id", (F.col("page_id") % 50).alias("gate"), (F.col("page_id") % 10 == 0).alias("scrubbed")))


@query("i8_wiring_audit", "SELECT count(*) AS pages, avg(CASE WHEN contains(html, '<script>') THEN 1.0::DOUBLE ELSE 0 END) AS library, avg(CASE WHEN contains(html, 'track(0)') THEN 1.0::DOUBLE ELSE 0 END) AS call FROM pages")
def wiring(spark, sf_dir):
    return p.wiring_audit(table(spark, sf_dir, "pages"), {"library": "<script>", "call": "track(0)"})


@query("b24_visible_text", f"SELECT page_id, {_TEXT} AS text FROM pages")
def visible(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", p.visible_text(F.col("html")).alias("text"))


@query("b25_parse_html_table", "SELECT conv_id AS page_id, CAST(1 AS INTEGER) AS row, CAST(turn AS INTEGER) AS number, role AS title, turn || ',7' AS positions FROM conversations")
def html_table(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    html = F.concat(F.lit("<table class=x><tr><th>n</th><th>t</th><th>p</th></tr><tr><td>"), "turn", F.lit("</td><td><b>"), "role", F.lit("</b></td><td>"), "turn", F.lit(" | x/ 7</td></tr></table><table></table>"))
    out = p.parse_table(c.select(F.col("conv_id").alias("page_id"), html.alias("html")))
    return out.withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ","))
