"""Column functions on names and short texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Zero-width and direction marks, word joiner, byte order mark.
INVISIBLE = "[\\u200B-\\u200F\\u202A-\\u202E\\u2060\\uFEFF]"


def strip_invisible(c: Column) -> Column:
    """Without characters that show nothing."""
    return F.regexp_replace(c, INVISIBLE, "")


@F.pandas_udf(StringType())
def fold(values: pd.Series) -> pd.Series:
    """Compatibility-decomposed text without combining marks; there is no such function in Spark."""
    import unicodedata

    return values.map(lambda s: s if s is None or s.isascii() else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)))


def slugify(c: Column) -> Column:
    """First line, folded, in lower case, other runs than of a-z and 0-9 as one hyphen; ``unknown`` if nothing is left."""
    slug = F.trim(F.regexp_replace(F.lower(fold(F.split_part(c, F.lit("\n"), F.lit(1)))), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(slug == "", "unknown").otherwise(slug)


def normalise_key(c: Column) -> Column:
    """Folded, in lower case, a-z and 0-9 only."""
    return F.regexp_replace(F.lower(fold(c)), "[^a-z0-9]", "")


def distinct_by(values: Column, key) -> Column:
    """An array without later items of an equal key, in order."""
    seen = F.array_distinct(F.transform(values, key))
    keys = F.transform(values, key)
    return F.transform(seen, lambda k: F.get(values, (F.array_position(keys, k) - 1).cast("int")))


def name_variants(c: Column) -> Column:
    """Looser forms in order: as it is; without brackets; before `` the ``; before a comma; the last word."""
    plain = F.trim(F.regexp_replace(c, r"\s*\([^)]*\)", ""))
    forms = F.array(F.trim(c), plain, F.trim(F.split_part(plain, F.lit(" the "), F.lit(1))), F.trim(F.split_part(plain, F.lit(","), F.lit(1))), F.element_at(F.split(plain, " "), -1))
    return distinct_by(F.filter(forms, lambda x: x != ""), F.lower)


def words(c: Column) -> Column:
    """Runs of letters and digits in lower case, in order."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def qualified_parts(c: Column, statuses: tuple[str, ...] = ("former", "sworn", "temporary", "alleged"), least: int = 3) -> Column:
    """Array of (name, status) of a list like ``Name (former); Other``; without a qualifier the status is current."""
    def part(x: Column) -> Column:
        inside = F.lower(F.trim(F.regexp_extract(x, r"\(([^)]*)\)\s*$", 1)))
        known = F.coalesce(*[F.when(F.contains(inside, F.lit(s)), s) for s in statuses], F.when(inside != "", inside), F.lit("current"))
        return F.struct(squeeze(F.regexp_replace(x, r"\s*\([^)]*\)\s*$", "")).alias("name"), known.alias("status"))

    return F.filter(F.transform(F.split(c, ";"), part), lambda p: F.length(p["name"]) >= least)


def relation_parts(c: Column, least: int = 2) -> Column:
    """Array of (name, relation) of a list like ``Name (brother); Other``; without brackets the relation is null."""
    def part(x: Column) -> Column:
        relation = F.lower(F.trim(F.regexp_extract(x, r"\(([^)]*)\)\s*$", 1)))
        return F.struct(squeeze(F.regexp_replace(x, r"\s*\([^)]*\)\s*$", "")).alias("name"), F.when(relation != "", relation).alias("relation"))

    return F.filter(F.transform(F.split(c, ";"), part), lambda p: F.length(p["name"]) >= least)


def credit_parts(c: Column, junk: tuple[str, ...] = ("unknown", "various", "n/a")) -> Column:
    """Array of credited names: split at ``;`` and ``·``, without role prefix, brackets and episode tails."""
    def part(x: Column) -> Column:
        x = F.regexp_replace(x, r"^\s*[^:;()]*:\s*", "")
        return squeeze(F.regexp_replace(F.regexp_replace(x, r"[(\[].*$", ""), r"(?i)\bep\. .*$", ""))

    return F.filter(F.transform(F.split(c, "[;·]"), part), lambda n: n.rlike(r"\p{L}") & ~F.lower(n).isin(*junk))


def owner_chain(c: Column) -> Column:
    """Array of (pos, owner, current) of a chain like ``A → B, from X → C (former)``; only the last link may be current."""
    links = F.split(c, "→")
    n = F.size(links)

    def part(x: Column, i: Column) -> Column:
        gone = F.lower(x).rlike(r"\((former|destroyed)[^)]*\)")
        owner = squeeze(F.regexp_replace(F.split_part(x, F.lit(","), F.lit(1)), r"\([^)]*\)", ""))
        return F.struct(i.alias("pos"), owner.alias("owner"), ((i == n - 1) & ~gone).alias("current"))

    return F.filter(F.transform(links, part), lambda p: p["owner"] != "")


def value_variants(c: Column) -> Column:
    """Ordered, distinct looser forms of a value: itself; without brackets; its parts, with and without; digits; no commas."""
    plain = lambda x: squeeze(F.regexp_replace(x, r"\([^)]*\)", ""))
    parts = F.split(c, r" · |; | , ")
    digits = F.regexp_replace(c, r"\D", "")
    forms = F.concat(F.array(F.trim(c), plain(c)), F.flatten(F.transform(parts, lambda x: F.array(F.trim(x), plain(x)))), F.array(F.when(F.length(digits) >= 3, digits), F.replace(F.trim(c), F.lit(","), F.lit(""))))
    return F.filter(F.array_distinct(F.array_compact(forms)), lambda x: x != "")


def position(c: Column) -> Column:
    """The number of ``Chapter N``; null where there is none, or it isn't above 0."""
    n = F.regexp_extract(c, r"Chapter (\d+)", 1).try_cast("int")
    return F.when(n > 0, n)


def loose_position(c: Column) -> Column:
    """The first run of one to four digits, if above 0."""
    n = F.regexp_extract(c, r"(\d{1,4})", 1).try_cast("int")
    return F.when(n > 0, n)


def position_list(c: Column, span: int = 200) -> Column:
    """Sorted distinct positions cited as numbers or ranges ``a-b``; ranges of ``span`` or more give their ends only."""
    def numbers(x: Column) -> Column:
        a, b = F.regexp_extract(x, r"^(\d+)", 1).cast("int"), F.regexp_extract(x, r"-(\d+)$", 1).try_cast("int")
        return F.when(b.isNull() | (b < a), F.array(a)).when(b - a < span, F.sequence(a, b)).otherwise(F.array(a, b))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(c, F.lit(r"(\d{1,4}(?:-\d{1,4})?)"), F.lit(1)), numbers))))


def largest_amount(c: Column, floor: int = 1000) -> Column:
    """The largest number, commas allowed, that isn't below ``floor``."""
    amounts = F.transform(F.regexp_extract_all(c, F.lit(r"(\d[\d,]*)"), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("long"))
    return F.array_max(F.filter(amounts, lambda x: x >= floor))


@F.pandas_udf(StringType())
def strip_markup(values: pd.Series) -> pd.Series:
    """Wiki markup as text. Templates nest, so they go innermost first until none is left."""
    import re

    inner, table = re.compile(r"\{\{[^{}]*\}\}"), re.compile(r"'{2,}|<[^>]*>|^=+\s*|\s*=+$", re.M)

    def plain(s: str | None) -> str | None:
        if s is None:
            return None
        s = re.sub(r"(?is)<ref\b[^>]*/>|<ref\b[^>]*>.*?</ref>|<!--.*?-->", "", s)
        while inner.search(s):
            s = inner.sub("", s)
        s = re.sub(r"(?i)\[\[(?:file|image):[^\[\]]*(?:\[\[[^\]]*\]\][^\[\]]*)*\]\]", "", s)
        s = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", r"\1", s)
        return " ".join(table.sub("", s).split())

    return values.map(plain)


@F.pandas_udf(StringType())
def flatten_tables(values: pd.Series) -> pd.Series:
    """Each ``{| ... |}`` block as ``[cell · cell || cell]``, the rest untouched."""
    import re

    def block(m: re.Match) -> str:
        rows = []
        for row in re.split(r"^\|-.*$", m[1], flags=re.M):
            cells = [re.sub(r"^[^|\[]*\|(?!\|)", "", c).strip() for line in re.findall(r"^[|!](?![-}])(.*)$", row, re.M) for c in re.split(r"\|\||!!", line)]
            if any(cells):
                rows.append(" · ".join(c for c in cells if c))
        return "[" + "  ||  ".join(rows) + "]"

    return values.map(lambda s: s if s is None else re.sub(r"\{\|(.*?)\|\}", block, s, flags=re.S))


def signature(c: Column, patterns: list[str], blocklist: tuple[str, ...]) -> Column:
    """The first pattern's capture that passes: 2 to 40 characters, with a letter, half digits at most, not blocked."""
    def valid(name: Column) -> Column:
        digits = F.length(F.regexp_replace(name, r"\D", ""))
        ok = F.length(name).between(2, 40) & name.rlike(r"\p{L}") & (digits * 2 <= F.length(name)) & ~F.lower(name).isin(*blocklist)
        return F.when(ok, name)

    return F.coalesce(*[valid(F.trim(F.regexp_extract(c, p, 1))) for p in patterns])


def credits_tail(c: Column, marker: str = r"\s*Translat(?:or|ion)s?:") -> Column:
    """Struct of the text before a trailing translator block, and the block's content (null where there is none)."""
    block = F.trim(F.regexp_extract(c, rf"(?s){marker}(.*)$", 1))
    body = F.regexp_replace(F.regexp_replace(c, rf"(?s){marker}.*$", ""), r"(?m)\s*\[\[[a-z]{2}:[^\]]*\]\]\s*$|\s*Volume \d+\s*$", "")
    return F.struct(F.trim(body).alias("body"), F.when(block != "", block).alias("credits"))


def sanitise(c: Column, markers: list[str], longest: int, token: str = "[marker]", suffix: str = "…") -> Column:
    """Without control characters, markers replaced by a visible token, cut at ``longest`` with a suffix."""
    out = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    for m in markers:
        out = F.regexp_replace(out, m, token.replace("$", r"\$"))
    return F.when(F.length(out) > longest, F.concat(F.substring(out, 1, longest), F.lit(suffix))).otherwise(out)


def clip(c: Column, longest: int) -> Column:
    """Squeezed text, cut at the last word that fits, with an ellipsis."""
    text = squeeze(c)
    return F.when(F.length(text) > longest, F.concat(F.regexp_replace(F.substring(text, 1, longest), r"\s+\S*$", ""), F.lit("…"))).otherwise(text)


def classify(c: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The label of the first rule whose pattern is found, else the default."""
    return F.coalesce(*[F.when(c.rlike(p), label) for p, label in rules], F.lit(default))


def rank(role: Column, ranks: list[tuple[str, int]], default: int = 60) -> Column:
    """Rank of a role's first part; a former role has the default's rank."""
    first = F.lower(F.trim(F.get(F.split(role, "[;·]"), F.lit(0))))
    return F.when(first.rlike(r"\b(former|ex)\b"), default).otherwise(F.coalesce(*[F.when(first.rlike(p), n) for p, n in ranks], F.lit(default)))


def priority(status: Column, priorities: dict[str, int], default: int = 60) -> Column:
    """The priority of a status, trimmed and in lower case; the default's for others and none."""
    low = F.lower(F.trim(status))
    return F.coalesce(*[F.when(low == s, n) for s, n in priorities.items()], F.lit(default))


def tags(text: Column, keywords: dict[str, str], count: Column, main: int = 100, recurring: int = 20) -> Column:
    """Tags of the keywords that a text contains, and one for the count: main, recurring or minor."""
    found = [F.when(F.contains(F.lower(text), F.lit(k)), tag) for k, tag in keywords.items()]
    return F.array_distinct(F.array_compact(F.array(*found, F.when(count >= main, "main").when(count >= recurring, "recurring").otherwise("minor"))))


def equivalent(a: Column, b: Column) -> Column:
    """Loosely equal: in lower case; without brackets, if something is left; or one's set of digit groups within the other's."""
    low = lambda c: squeeze(F.lower(c))
    bare = lambda c: squeeze(F.regexp_replace(F.lower(c), r"\([^)]*\)", ""))
    groups = lambda c: F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1))
    x, y = groups(a), groups(b)
    inside = (F.size(x) > 0) & (F.size(y) > 0) & ((F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0))
    return F.coalesce((low(a) == low(b)) | ((bare(a) != "") & (bare(a) == bare(b))) | inside, F.lit(False))


def equivalence_keys(c: Column) -> Column:
    """Keys of which values that are ``equivalent`` share one: as they are compared, without brackets, and each group of digits."""
    low = F.lower(c)
    bare = squeeze(F.regexp_replace(low, r"\([^)]*\)", ""))
    groups = F.transform(F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1)), lambda g: F.concat(F.lit("d"), g))
    return F.array_distinct(F.array_compact(F.concat(F.array(F.concat(F.lit("l"), squeeze(low)), F.when(bare != "", F.concat(F.lit("b"), bare))), groups)))


def entry_text(texts: list[Column], lists: list[Column]) -> Column:
    """All strings of an entry in one, lists laid out."""
    return F.concat_ws(" ", *texts, *[F.array_join(c, " ") for c in lists])
