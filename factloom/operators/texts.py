"""Text to tables: markup, boxes, bracketed tables, attachments, posts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import clip, strip_markup


def parse_infobox(df: DataFrame, key: str, text: str, box: str, field_map: dict[str, list[str]], joined: tuple[str, ...] = (), cleaned: bool = False) -> DataFrame:
    """Columns key and one for each field of ``field_map`` (field -> keys of the box): the first non-empty key's value,
    or, for fields in ``joined``, all different ones. A box is found by its depth of braces. With ``cleaned``, values are freed of markup before they are chosen."""

    def fields(values: pd.Series) -> pd.Series:
        def one(s: str | None) -> dict[str, str]:
            start = (s or "").lower().find("{{" + box.lower())
            if start < 0:
                return {}
            depth, links, parts, at, i = 0, 0, [], start + 2, start
            while i < len(s):
                two = s[i : i + 2]
                if two == "{{":
                    depth, i = depth + 1, i + 2
                elif two == "}}":
                    depth, i = depth - 1, i + 2
                    if not depth:
                        parts.append(s[at : i - 2])
                        break
                elif two in ("[[", "]]"):
                    links, i = links + (1 if two == "[[" else -1), i + 2
                else:
                    if s[i] == "|" and depth == 1 and links <= 0:
                        parts.append(s[at:i])
                        at = i + 1
                    i += 1
            pairs = [p.partition("=") for p in parts[1:]]
            return {k.strip().lower(): v.strip() for k, sep, v in pairs if sep and v.strip()}

        return values.map(one)

    boxes = df.select(key, F.pandas_udf(fields, "map<string,string>")(F.col(text)).alias("_box"))
    raw = lambda k: F.try_element_at("_box", F.lit(k))
    value = lambda k: F.nullif(strip_markup(raw(k)), F.lit("")) if cleaned else raw(k)
    pick = lambda f, keys: F.concat_ws(" · ", F.array_distinct(F.array_compact(F.array(*[value(k) for k in keys])))) if f in joined else F.coalesce(*[value(k) for k in keys])
    return boxes.select(key, *[pick(f, keys).alias(f) for f, keys in field_map.items()])


def extract_mentions(df: DataFrame, key: str, text: str, heading: str = "Characters") -> DataFrame:
    """Columns key, name and kind: link targets in the bullets of a section, once each; the kind by keyword in the line."""
    section = F.regexp_extract(F.col(text), rf"(?s)==\s*{heading}\s*==\n(.*?)(?:\n==[^=]|$)", 1)
    lines = df.select(key, F.explode(F.split(section, "\n")).alias("_line")).where(F.ltrim("_line").startswith("*"))
    kind = F.coalesce(*[F.when(F.contains(F.lower("_line"), F.lit(k)), k) for k in ("flashback", "silhouette", "cover")], F.lit("full"))
    names = lines.select(key, kind.alias("kind"), F.explode(F.regexp_extract_all("_line", F.lit(r"\[\[([^\]|#]+)"), F.lit(1))).alias("_n"))
    return names.select(key, F.trim("_n").alias("name"), "kind").where(~F.contains("name", F.lit(":")) & (F.length("name") > 1)).distinct()


def unpivot_positional_tables(df: DataFrame, key: str, text: str, labels: tuple[str, ...]) -> DataFrame:
    """Columns key, name, field, value and refused of bracketed tables ``[a · b || c · d]``.

    Column-major: the first cell of the first row is ``name``, and cell i of each row belongs to name i; rows of
    another length are refused. Row-major: the header holds ``name`` elsewhere, and rows align from the right.
    Other labels than ``labels`` are dropped; other blocks are declined.
    """
    blocks = df.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(r"\[([^\[\]]*\|\|[^\[\]]*)\]"), F.lit(1))).alias("_b"))
    rows = blocks.withColumn("_r", F.transform(F.split("_b", r"\|\|"), lambda r: F.transform(F.split(r, " · "), lambda c: F.trim(c))))
    head = F.get("_r", F.lit(0))
    by_column = F.lower(F.get(head, F.lit(0))) == "name"
    at = F.array_position(F.transform(head, lambda c: F.lower(c)), "name")
    body = rows.where(by_column | (at > 0)).select(key, by_column.alias("_col"), head.alias("_head"), at.alias("_at"), F.posexplode(F.slice("_r", 2, 1 << 20)).alias("_n", "_row"))
    n, m = F.size("_head"), F.size("_row")
    cell = lambda name, field, value, refused: F.struct(name.alias("name"), F.lower(field).alias("field"), value.alias("value"), refused.alias("refused"))
    label = F.get("_row", F.lit(0))
    column_cells = F.when(n != m, F.array(cell(F.lit(None).cast("string"), label, F.lit(None).cast("string"), F.lit(True)))).otherwise(F.transform(F.slice("_row", F.lit(2), F.greatest(m - 1, F.lit(0))), lambda v, i: cell(F.get("_head", i + 1), label, v, F.lit(False))))
    name = F.get("_row", m - n + F.col("_at").cast("int") - 1)
    row_cells = F.filter(F.transform("_row", lambda v, i: cell(name, F.get("_head", n - m + i), v, F.lit(False))), lambda c: c["field"].isNotNull() & (c["field"] != "name"))
    out = body.select(key, F.inline(F.when(F.col("_col"), column_cells).otherwise(row_cells)))
    return out.where(F.col("field").isin(*labels))


def attribute_attachments(df: DataFrame, key: str, text: str) -> DataFrame:
    """Columns key, file, item and part: files go to the question or answer they stand in, or wait for the next question.

    Tokens are lines: ``Q:``, ``A:``, ``{|``, ``|}``, ``[[File:x]]`` and ``== header ==``. After a header, and in a
    table outside an item, a file is deferred to the next question.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        token = re.compile(r"^(Q:|A:|\{\||\|\}|==.*==)|\[\[File:([^\]|]+)", re.M)
        for batch in batches:
            out = []
            for k, s in zip(batch[key], batch[text]):
                item, part, table, waiting = 0, None, False, []
                for m in token.finditer(s or ""):
                    if m[2] is not None:
                        (waiting.append(m[2]) if part is None or (table and part == "header") else out.append((k, m[2], item, part)))
                    elif m[1] == "Q:":
                        item, part = item + 1, "question"
                        out += [(k, f, item, "deferred") for f in waiting]
                        waiting = []
                    elif m[1] == "A:":
                        part = "answer" if item else None
                    elif m[1] in ("{|", "|}"):
                        table = m[1] == "{|"
                    else:
                        part = None
            yield pd.DataFrame(out, columns=["doc", "file", "item", "part"]).astype({"item": "int64"})

    return df.select(key, text).mapInPandas(run, "doc long, file string, item long, part string")


def quality_gate(posts: DataFrame, moderated: Column, min_score: float, oldest: Column, min_length: int, longest: int = 200) -> DataFrame:
    """Columns id, score, reason and summary of posts (id, score, day, text): the first failing reason, null for survivors."""
    text = F.trim(F.coalesce("text", F.lit("")))
    reason = F.when(moderated, "moderated").when(F.col("score") < min_score, "score").when(F.col("day") < oldest, "age").when(F.length(text) < min_length, "text")
    return posts.select("id", "score", reason.alias("reason"), F.when(reason.isNull(), clip(F.col("text"), longest)).alias("summary"))


def score_filenames(targets: DataFrame, files: DataFrame, bonus: dict[str, int]) -> DataFrame:
    """Columns target, file and score: the best file of each target's page: lengths of shared tokens, then bonuses.

    ``targets`` has target and page, ``files`` file and page; a file without a shared token scores 0 whatever its bonus.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda w: w != ""))
    pairs = targets.join(files, "page").select("target", "file", F.array_intersect(words("target"), words("file")).alias("_w"))
    base = F.aggregate("_w", F.lit(0), lambda a, w: a + F.length(w))
    extra = sum((F.when(F.contains(F.lower("file"), F.lit(k)), v).otherwise(0) for k, v in bonus.items()), F.lit(0))
    scored = pairs.withColumn("score", F.when(base > 0, base + extra).otherwise(0))
    best = scored.groupBy("target").agg(F.min(F.struct((-F.col("score")).alias("s"), "file")).alias("_b"))
    return best.select("target", F.col("_b.file").alias("file"), (-F.col("_b.s")).cast("int").alias("score"))
