"""Known forms (names, terms) found in texts as whole words, in any case and of any length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import words

#: Places of the bitmap of first words, which is sent with the plan: eight for each form, between 8 and 128 KB.
LEAST, MOST = 1 << 16, 1 << 20
#: Forms that are sent to every executor whole, and bytes of them; hashes of forms that are, of 8 bytes each.
WHOLE, WHOLE_BYTES, HASHES = 100_000, 32 << 20, 4_000_000


def _begins(known: DataFrame, n: int):
    """A test of words that holds for each word with which one of ``n`` forms begins, by a bitmap over hashes."""
    slots = min(MOST, max(LEAST, 1 << (8 * max(1, n) - 1).bit_length()))
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(slots)).cast("int")
    at = slot(F.get(F.split("_g", " "), F.lit(0)))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)))
    got = known.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).collect()  # at most slots / 64 rows
    bits = [0] * (slots // 64)
    for r in got:
        bits[r["word"]] = r["bits"]
    table = F.split(F.lit(",".join(map(str, bits))), ",").cast("array<long>")

    def test(c: Column) -> Column:
        return F.getbit(F.get(table, F.shiftright(slot(c), 6)), slot(c).bitwiseAND(F.lit(63))) == 1

    return test


def leaving_runs(texts: DataFrame, keys: tuple[str, ...], text: str, forms: DataFrame, form: str) -> tuple[DataFrame, DataFrame, bool]:
    """The runs of words (keys, _g) that may be a form, once for a text; the forms (_g); and whether these are few.

    Only words that may begin a form start a run, of the numbers of words that forms have. Runs then meet the hashes of
    the forms, which go to every executor as long as they are at most ``HASHES``: what is left is a hit but for clashes of
    64 bits. Beyond that, all runs that begin like a form are left. Few forms can be sent whole, so their runs aren't sifted.
    """
    known = forms.withColumn("_g", F.array_join(words(F.col(form)), " ")).where("_g <> ''")
    size = F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in known.columns])))), F.lit(0))
    n, many, lengths = known.agg(F.count(F.lit(1)), size, F.collect_set(F.size(F.split("_g", " ")))).first()
    few = n <= WHOLE and many <= WHOLE_BYTES
    w = F.col("_w")
    rows = texts.select(*keys, words(F.col(text)).alias("_w")).where(F.size("_w") > 0)
    begins = _begins(known, n)
    rows = rows.select("*", F.filter(F.transform(w, lambda x, i: F.when(begins(x), i + 1)), lambda i: i.isNotNull()).alias("_at")).where(F.size("_at") > 0)

    def of_words(k: int) -> Column:
        runs = F.transform("_at", lambda i: F.when(i + k - 1 <= F.size(w), F.array_join(F.slice(w, i, F.lit(k)), " ")))
        return F.filter(runs, lambda g: g.isNotNull())

    runs = rows.select(*keys, F.explode(F.array_distinct(F.concat(*map(of_words, sorted(lengths) or [1])))).alias("_g"))
    if not few and n <= HASHES:
        hashed = known.select(F.xxhash64("_g").alias("_h")).distinct()
        runs = runs.withColumn("_h", F.xxhash64("_g")).join(F.broadcast(hashed), "_h", "left_semi").drop("_h")  # counted above
    return runs, known, few


def find_forms(texts: DataFrame, keys: tuple[str, ...], text: str, forms: DataFrame, form: str) -> DataFrame:
    """The rows of ``forms`` met with the ``keys`` of each text that holds their ``form``; once for a text.

    Texts are never moved. Few forms are sent to where the texts are; of many, only their hashes, so that a run crosses
    the network when it is a hit. An equality join on the run decides in either case, and no form is too long. Forms
    without a letter or digit are never found. Forms are counted when this is called.
    """
    runs, known, few = leaving_runs(texts, keys, text, forms, form)
    return runs.join(F.broadcast(known) if few else known, "_g").drop("_g")
