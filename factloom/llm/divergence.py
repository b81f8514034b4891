"""Source divergence audit: how the words of each source differ from those of the others in its language.

Every group (lang, source) has a smoothed share of each term that its language keeps; two groups diverge by the sum of
(p - q)^2 / q over the terms, in whole numbers. The pairs are computed in a cube: a cell (group block, group block,
term block) gets the slices of two blocks of groups over one block of terms, computes the partial sums of their pairs,
and the partial sums are added along the terms. A cell holds at most about 2 x 16 groups by 4096 terms, however large
a source or a language is.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.session import ensure_checkpoint_dir, sent_if_small

#: Groups and terms of a block, on average.
GROUPS, TERMS = 16, 4096
#: Different terms that a task counts at once.
HELD = 1 << 19
UNIT = 1_000_000_000
#: UTF-8 bytes of terms, A-Z lower-cased; all others part terms.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """Columns lang, source, term, tf and df: occurrences, and documents with the term, in each group.

    Terms are runs of ASCII letters and of characters beyond ASCII, A-Z lower-cased. Each group also has a row for the
    empty term, with zeros, so that one without terms is known. Tasks add up what they read before anything is shuffled.
    Null texts, languages and sources count as empty; repeated rows count each; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (tf, df) in found.items():
                columns = pa.array([lang] * len(tf)), pa.array([source] * len(tf)), pa.array(list(tf), pa.binary()), pa.array(list(tf.values()), pa.int64()), pa.array([df[t] for t in tf], pa.int64())
                yield from pa.Table.from_arrays(columns, names=["lang", "source", "term", "tf", "df"]).to_batches(1 << 16)
            found.clear()

        for batch in batches:
            for text, lang, source in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (lang, source) not in found:
                    found[lang, source] = Counter({b"": 0}), Counter({b"": 0})
                tf, df = found[lang, source]
                held -= len(tf)
                words = text.translate(LETTERS).split()
                tf.update(words)
                df.update(set(words))
                held += len(tf)
                if held > HELD:
                    yield from flush()
                    held = 0
        yield from flush()

    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(blank("text").cast("binary").alias("text"), blank("lang").alias("lang"), blank("source").alias("source"))
    counted = rows.mapInArrow(run, "lang string, source string, term binary, tf long, df long")
    return counted.withColumn("term", F.col("term").cast("string")).groupBy("lang", "source", "term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def share(count: str, total: str) -> Column:
    """1 + floor(10^9 (count + 1) / total) in whole numbers, by long division in three steps, so that no product leaves 64 bits
    while ``total`` is below 9 * 10^15."""
    whole, left = "0", f"({count} + 1)"
    for _ in range(3):
        whole, left = f"({whole} * 1000 + ({left} * 1000) div ({total}))", f"(({left} * 1000) % ({total}))"
    return F.expr(f"CASE WHEN ({total}) > 0 THEN 1 + {whole} ELSE 1 END")


def _gap(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div {q}"


def _cell(key: tuple, table: pa.Table) -> pa.Table:
    """Partial divergences of the pairs of one cell, both ways, over the terms that occur there, and how many those are.

    Rows with an empty term give a group's share of a term that it lacks."""
    first, second = key[1].as_py(), key[2].as_py()
    column = lambda name: table.column(name).combine_chunks()
    head = pc.equal(column("term"), "").to_numpy(zero_copy_only=False)
    group = column("source").dictionary_encode()
    names, places, p = group.dictionary, group.indices.to_numpy(), column("p").to_numpy()
    terms = column("term").filter(pa.array(~head)).dictionary_encode()
    base, side = np.zeros(len(names), "i8"), np.zeros(len(names), "i8")
    base[places[head]], side[places[head]] = p[head], column("side").to_numpy()[head]
    shares = np.repeat(base[:, None], len(terms.dictionary), axis=1)
    shares[places[~head], terms.indices.to_numpy()] = p[~head]
    left = np.flatnonzero(side == 0)
    right = left if first == second else np.flatnonzero(side == 1)
    ones, others, values = [], [], []
    for a in left:
        if first == second:
            b = right[right != a]
            square = (shares[b] - shares[a]) ** 2
        else:
            b = right
            square = (shares[b] - shares[a]) ** 2
            ones.append(b), others.append(np.full(len(b), a)), values.append((square // shares[a]).sum(axis=1))
        ones.append(np.full(len(b), a)), others.append(b), values.append((square // shares[b]).sum(axis=1))
    ones, others, values = (np.concatenate([np.zeros(0, "i8"), *x]).astype("i8") for x in (ones, others, values))
    columns = [pa.array([key[0].as_py()] * len(ones), pa.string()), names.take(pa.array(ones)), names.take(pa.array(others)), pa.array(base[ones]), pa.array(base[others]), pa.array(values), pa.array(np.full(len(ones), shares.shape[1]))]
    return pa.Table.from_arrays(columns, names=["lang", "source", "item", "p0", "q0", "value", "terms"])


def audit(docs: DataFrame, least: int = 3, top: int = 200) -> DataFrame:
    """Columns lang, source, part, item, value and rank.

    Part ``pair`` has every other source of the language with the divergence from it, part ``term`` the ``top`` terms
    that the source uses more than its language does. A language keeps the terms that at least ``least`` of its
    documents have. Higher values rank first, ties by item in the order of UTF-8 bytes. A language that keeps no term
    has divergences of 0. Null texts, languages and sources count as empty ones; repeated rows count each; other columns
    are not read; an empty table gives no rows. Sums are exact as long as no language has 9 * 10^15 words.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    # a term has a row for each source at most, so that these windows are small, whatever the term
    of_term = Window.partitionBy("lang", "term")
    kept = term_counts(docs).withColumns({"docs": F.sum("df").over(of_term), "total": F.sum("tf").over(of_term), "first": F.row_number().over(of_term.orderBy("source")) == 1})
    kept = kept.where((F.col("docs") >= least) | (F.col("term") == "")).drop("df", "docs").checkpoint()

    word = F.col("term") != ""
    langs = kept.groupBy("lang").agg(F.count_if(word & F.col("first")).alias("v"), F.sum("tf").alias("n_lang"), F.count_if(~word).alias("groups"))
    langs = langs.withColumns({"blocks": F.ceil(F.col("groups") / GROUPS), "slices": F.greatest(F.lit(1).cast("long"), F.ceil(F.col("v") / TERMS))})
    groups = kept.groupBy("lang", "source").agg(F.sum("tf").alias("n")).join(sent_if_small(langs), "lang")
    groups = groups.withColumns({"block": F.pmod(F.xxhash64("source"), F.col("blocks")), "p0": share("0", "n + v")}).checkpoint()
    known = sent_if_small(groups)

    rows = kept.where(word).join(known, ["lang", "source"]).withColumn("p", share("tf", "n + v"))
    return _pairs(groups, rows, langs).unionByName(_terms(rows, top))


def _pairs(groups: DataFrame, rows: DataFrame, langs: DataFrame) -> DataFrame:
    """Each slice goes to the cells of its block with every block; so does a head row for each group in it."""
    heads = groups.select("lang", "source", "block", "blocks", F.lit("").alias("term"), F.col("p0").alias("p"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"))
    slices = rows.select("lang", "source", "block", "blocks", "term", "p", F.pmod(F.xxhash64("term"), F.col("slices")).alias("slice"))
    sent = slices.unionByName(heads).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cells = sent.select("lang", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "slice", (F.col("block") > F.col("other")).cast("int").alias("side"), "source", "term", "p")
    partial = cells.groupBy("lang", "i", "j", "slice").applyInArrow(_cell, "lang string, source string, item string, p0 long, q0 long, value long, terms long")
    whole = partial.groupBy("lang", "source", "item", "p0", "q0").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms")).join(sent_if_small(langs.select("lang", "v")), "lang")
    # terms that neither block has anywhere in the cell: all alike
    value = F.col("value") + (F.col("v") - F.col("terms")) * F.expr(_gap("p0", "q0"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return whole.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value")).withColumn("rank", F.row_number().over(order))


def _terms(rows: DataFrame, top: int) -> DataFrame:
    """The best terms of each group: first in parts of its terms, then of those, so that a large source is no single task."""
    rows = rows.withColumn("q", share("total", "n_lang + v")).where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(_gap("p", "q")).alias("value"))
    best = [F.desc("value"), F.col("item")]
    rows = rows.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(16)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(*best))).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*best))).where(F.col("rank") <= top)
    return rows.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
