"""Text evidence for claims: mentions, proximity, graded decisions, retrieval and search."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache, partial, reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from factloom.functions.text import equivalence_keys, equivalent, value_variants, words
from factloom.operators.hearing import CONFIRMED, JOKE, NEAR, NEAR_DODGED, NEAR_NEGATED, WIDE, WIDE_DODGED, WIDE_NEGATED, Judge, Rules, agreed, hear, negated, plain
from factloom.operators.hearing import whole_word as _whole
from factloom.operators.matching import find_forms
from factloom.session import ensure_checkpoint_dir, prepare, sent_if_small


def mentions(names: DataFrame, docs: DataFrame, key: str, text: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Columns name, key and ``carry``: documents that hold a name (name, form) as whole words, in any case."""
    forms = names.select("name", "form").distinct()
    return find_forms(docs, tuple(dict.fromkeys((key, *carry))), text, forms, "form").select("name", key, *[c for c in carry if c != key]).distinct()


def mention_index(names: DataFrame, docs: DataFrame, key: str, text: str, order: str, cap: int = 20, snippet: int = 160) -> DataFrame:
    """Columns name, key, rank and snippet: the first ``cap`` documents, in source order, that mention a name (name, form).

    Names shorter than 3 characters, or 4 without another form, are skipped. Only the ranked documents' texts are read again.
    """
    usable = names.join(names.groupBy("name").agg(F.count_distinct("form").alias("_forms")), "name").where(F.length("name") >= F.when(F.col("_forms") > 1, 3).otherwise(4))
    found = mentions(usable, docs, key, text, (order,))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy(order, key))).where(F.col("rank") <= cap).select("name", key, "rank")
    at = F.greatest(F.lit(1), F.instr(F.lower("_t"), F.lower(F.col("name"))) - snippet // 4)
    return ranked.join(docs.select(key, F.col(text).alias("_t")), key).select("name", key, "rank", F.substring(F.col("_t"), at, F.lit(snippet)).alias("snippet"))


def linkify(docs: DataFrame, key: str, text: str, names: DataFrame, link: str = "[[{}]]") -> DataFrame:
    """Columns key and text with names (form) wrapped as links, the longest form first; forms under 3 characters are skipped.

    Documents first meet the forms that they hold by join, so that a text is searched for these only.
    """
    met = mentions(names.where(F.length("form") >= 3).select(F.col("form").alias("name"), "form"), docs, key, text)
    own = met.groupBy(key).agg(F.sort_array(F.collect_set("name")).alias("_forms"))

    def wrap(texts: pd.Series, forms: pd.Series) -> pd.Series:
        def one(s: str | None, found) -> str | None:
            if s is None or found is None or not len(found):
                return s
            pattern = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(found, key=lambda n: (-len(n), n)))) + r")(?!\w)", re.I)
            return pattern.sub(lambda m: link.format(m[0]), s)

        return pd.Series([one(s, f) for s, f in zip(texts, forms)], dtype=object)

    rows = docs.select(key, F.col(text).alias("_t")).join(own, key, "left")
    return rows.select(key, F.pandas_udf(wrap, StringType())("_t", "_forms").alias("text"))


@lru_cache(1 << 16)
def _as_word(needle: str) -> str | None:
    """The needle in lower case, if it is one word of characters that have a single lower case."""
    return needle.lower() if needle and max(needle) <= "ÿ" and re.fullmatch(r"\w+", needle) else None


@lru_cache(8)
def _words_at(text: str) -> dict[str, list[tuple[int, int]]] | None:
    """Where a text has its words, in lower case; None if it has characters with more than a single lower case."""
    if text and max(text) > "ÿ":
        return None
    found = {}
    for m in re.finditer(r"\w+", text.lower()):
        found.setdefault(m[0], []).append(m.span())
    return found


def _find(text: str, needle: str) -> list[tuple[int, int]]:
    if (word := _as_word(needle)) is not None and (at := _words_at(text)) is not None:
        return at.get(word, [])
    return [m.span() for m in _whole(needle).finditer(text)] if needle else []


def proximity(text: str, name: str, value: str, window: int) -> tuple[int, int] | None:
    """The first occurrence of the value with the name within ``window`` characters of it, both as whole words."""
    names = _find(text, name)
    for a, b in _find(text, value):
        if any(s - b <= window and a - e <= window for s, e in names):
            return a, b
    return None


def digit_proximity(text: str, name: str, value: str, window: int) -> tuple[int, int] | None:
    """As ``proximity``, by the value's groups of two digits or more, the longest first."""
    for group in sorted(set(re.findall(r"\d{2,}", value)), key=lambda g: (-len(g), g)):
        if (hit := proximity(text, name, group, window)) is not None:
            return hit
    return None


def _dodged(text: str, hit: tuple[int, int], window: int, rules: Rules) -> bool:
    around = text.lower()[max(0, hit[0] - window) : hit[1] + window]
    return any(x in around for x in rules.dodge)


def _confirmed(question: str, answer: str, value: str, variants: list[str], rules: Rules) -> bool:
    return any(_find(question, v) for v in [value, *variants[1:3]]) and agreed(answer, rules)


def grade(question: str, answer: str, name: str, value: str, variants: list[str], rules: Rules) -> str | None:
    """What a statement is to the claim that ``name`` has ``value``: the value near the name, undodged, is 'contradict'
    if negated and else 'support'; then a confirmed question is 'support'; the wider window, undodged, is 'context'."""
    text = f"{question} / {answer}"
    if (hit := proximity(text, name, value, rules.near)) is not None and not _dodged(text, hit, rules.near, rules):
        return "contradict" if negated(text, hit[0], rules) else "support"
    if _confirmed(question, answer, value, variants, rules):
        return "support"
    if (hit := proximity(text, name, value, rules.wide)) is not None and not _dodged(text, hit, rules.wide, rules):
        return "context"
    return None


def grade_seen(seen: int) -> str | None:
    """``grade`` of a name and value that are plain words, by what was seen of them."""
    if seen & NEAR and not seen & NEAR_DODGED:
        return "contradict" if seen & NEAR_NEGATED else "support"
    return "support" if seen & CONFIRMED else "context" if seen & WIDE and not seen & WIDE_DODGED else None


def evaluate(question: str, answer: str, name: str, value: str, variants: list[str], rules: Rules) -> tuple[str, str, str] | None:
    """(tier, intent, rule) of a statement as evidence that ``name`` has ``value``; None where it is rejected or silent.

    In order: the value near the name, unless dodged or negated, which ends the matter; a question that holds it and
    an answer that opens with agreement, undodged; the wider window; variants there, undodged; digit groups there.
    """
    text = f"{question} / {answer}"
    dodged = lambda a, b, w: _dodged(text, (a, b), w, rules)
    said = lambda tier, kind, rule: (tier, "joke" if any(x in answer.lower() for x in rules.joke) else kind, rule)
    if (hit := proximity(text, name, value, rules.near)) is not None:
        return None if dodged(*hit, rules.near) or negated(text, hit[0], rules) else said("canon", "serious", "near")
    if _confirmed(question, answer, value, variants, rules):
        return said("canon", "confirmation", "confirmed")
    if (hit := proximity(text, name, value, rules.wide)) is not None:
        return None if dodged(*hit, rules.wide) or negated(text, hit[0], rules) else said("likely", "serious", "wide")
    for v in variants:
        if (hit := proximity(text, name, v, rules.wide)) is not None and not dodged(*hit, rules.wide):
            return said("likely", "serious", "variant")
    if (hit := digit_proximity(text, name, value, rules.wide)) is not None and not dodged(*hit, rules.wide):
        return said("likely", "ambiguous", "digits")
    return None


def evaluate_seen(seen: int) -> tuple[str, str, str] | None:
    """``evaluate`` of a name and value that are plain words, by what was seen of them."""
    said = lambda tier, kind, rule: (tier, "joke" if seen & JOKE else kind, rule)
    if seen & NEAR:
        return None if seen & (NEAR_DODGED | NEAR_NEGATED) else said("canon", "serious", "near")
    if seen & CONFIRMED:
        return said("canon", "confirmation", "confirmed")
    if seen & WIDE:
        return None if seen & (WIDE_DODGED | WIDE_NEGATED) else said("likely", "serious", "wide")
    return None


def proximity_matches(pairs: DataFrame, window: int, around: int = 80, digits: bool = False) -> DataFrame:
    """The pairs (text, name, value) with ``at`` and ``snippet`` of the first hit; null where there is none.

    ``name`` may be an array of forms, of which any will do. With ``digits``, a value that isn't found is looked for by its digit groups.
    """

    @F.pandas_udf("struct<at:int,snippet:string>")
    def hits(text: pd.Series, name: pd.Series, value: pd.Series) -> pd.DataFrame:
        def one(t, names, v):
            for look in (proximity, *[digit_proximity] * digits):
                if hits := [h for n in names if n and (h := look(t, n, v, window)) is not None]:
                    return min(hits)
            return None

        found = [one(t, [n] if isinstance(n, str) else n, v) if t and n is not None and v else None for t, n, v in zip(text, name, value)]
        return pd.DataFrame({"at": pd.array([f[0] if f else None for f in found], dtype="Int32"), "snippet": [t[max(0, f[0] - around) : f[1] + around] if f else None for t, f in zip(text, found)]})

    return pairs.withColumn("_h", hits("text", "name", "value")).select(*pairs.columns, "_h.at", "_h.snippet")


def evaluate_evidence(pairs: DataFrame, rules: Rules) -> DataFrame:
    """The pairs (question, answer, name, value) that are evidence, with tier, intent and rule."""
    columns = pairs.columns
    rows = pairs.withColumn("_v", value_variants(F.col("value")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [evaluate(q or "", a or "", n or "", v or "", list(w) if w is not None else [], rules) for q, a, n, v, w in zip(batch["question"], batch["answer"], batch["name"], batch["value"], batch["_v"])]
            kept = [o is not None for o in out]
            grades = pd.DataFrame([o for o in out if o], columns=["tier", "intent", "rule"], dtype=object)
            yield pd.concat([batch.loc[kept, columns].reset_index(drop=True), grades], axis=1)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return rows.mapInPandas(run, f"{fields}, tier string, intent string, rule string")


def _candidates(claims: DataFrame, statements: DataFrame) -> DataFrame:
    """Columns statement_id, name, value and variants: each different name and value of the claims with the statements that mention
    the name, and may hold a form of the value or one of its digit groups; no rule finds evidence in others. Some stand twice.

    What names and forms the statements hold is found once. A claim then takes the shorter list, of its name's
    statements or of its value's; those of a value are held against the name's by an equality join: a frequent name meets only
    what may speak of its value. ``variants`` is null where the value is its only one. Texts are not moved.
    """
    ensure_checkpoint_dir(claims.sparkSession)
    forms = value_variants(F.col("value"))
    raw = F.concat(forms, F.regexp_extract_all("value", F.lit(r"(\d{2,})"), F.lit(1)))
    plain = lambda c: F.array_join(words(c), " ")
    c = claims.select("name", "value").distinct().select("name", "value", plain(F.col("name")).alias("_n"), F.filter(F.array_distinct(F.transform(raw, plain)), lambda v: v != "").alias("_v"), F.when(forms != F.array("value"), forms).alias("variants"))
    terms = c.select(F.explode(F.array_append("_v", F.col("_n"))).alias("term")).where("term <> ''").distinct()
    text = statements.select("statement_id", F.concat_ws(" / ", "question", "answer").alias("_text"))
    posted = find_forms(text, ("statement_id",), "_text", terms, "term").select("term", "statement_id").checkpoint()
    counts = posted.groupBy("term").agg(F.count(F.lit(1)).alias("_k"))
    named = c.join(counts.select(F.col("term").alias("_n"), F.col("_k").alias("_named")), "_n")
    valued = c.select("name", "value", F.explode("_v").alias("term")).join(counts, "term").groupBy("name", "value").agg(F.sum("_k").alias("_valued"))
    sized = named.join(valued, ["name", "value"])
    kept = ("statement_id", "name", "value", "variants")
    by_name = sized.where("_named <= _valued").withColumnRenamed("_n", "term").join(posted, "term").select(*kept)
    by_value = sized.where("_named > _valued").withColumn("term", F.explode("_v")).join(posted, "term").select(*kept, "_n")
    return by_name.union(by_value.join(posted.withColumnRenamed("term", "_n"), ["_n", "statement_id"], "left_semi").select(*kept))


def _heard(claims: DataFrame, statements: DataFrame, judge: Callable[[str, str, str, str, list[str]], tuple | None], fields: tuple[str, ...]) -> DataFrame:
    """Columns name, value, statement_id, ordinal and ``fields``, as ``judge`` gives them: what statements are to the claims' different
    names and values.

    A statement's text comes to its task once, before the names and values that it may speak of.
    """
    prepare(claims.sparkSession)
    said = statements.select("statement_id", "ordinal", "question", "answer", F.lit(0).alias("_side"))
    rows = said.unionByName(_candidates(claims, statements).withColumn("_side", F.lit(1)), allowMissingColumns=True)
    names = ["statement_id", "_side", "ordinal", "question", "answer", "name", "value", "variants"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, texts, last = None, [], None
        for batch in batches:
            out = []
            for key, side, ordinal, question, answer, name, value, variants in zip(*(batch.column(n).to_pylist() for n in names)):
                if side == 0:
                    texts = texts if at == key else []
                    at, last = key, None
                    texts.append((ordinal, question or "", answer or ""))
                elif at == key and last != (name, value):
                    last = name, value
                    for ordinal, question, answer in texts:
                        if (got := judge(question, answer, name, value, [value] if variants is None else variants)) is not None:
                            out.append((name, value, key, ordinal, *got))
            columns = list(zip(*out)) or [()] * (4 + len(fields))
            kinds = [pa.string(), pa.string(), batch.schema.field("statement_id").type, batch.schema.field("ordinal").type, *[pa.string()] * len(fields)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["name", "value", "statement_id", "ordinal", *fields])

    kind = {f.name: f.dataType.simpleString() for f in statements.schema.fields}
    dealt = rows.select(*names).repartition("statement_id").sortWithinPartitions("statement_id", "_side", "name", "value")
    return dealt.mapInArrow(run, f"name string, value string, statement_id {kind['statement_id']}, ordinal {kind['ordinal']}, " + ", ".join(f"{f} string" for f in fields))


def _told(claims: DataFrame, statements: DataFrame, judge: Judge) -> DataFrame:
    """Columns name, value, the judge's fields and _k: of how many statements they are what these are to the claims' different names and
    values, with ordinal and statement_id of the first if the judge has a rank. A name and value may have several rows.

    Names and values that are plain words are heard with all others at once (``hear``); each of the rest meets the statements
    that mention it.
    """
    ensure_checkpoint_dir(claims.sparkSession)
    pairs = claims.where(F.col("name").isNotNull() & F.col("value").isNotNull()).select("name", "value").distinct().select("name", "value", plain(F.col("name"), F.col("value")).alias("_plain")).checkpoint()
    words, others = pairs.agg(F.count_if("_plain"), F.count_if(~F.col("_plain"))).first()
    columns = ["name", "value", *judge.fields, "_k", *["ordinal", "statement_id"] * (judge.rank is not None)]
    found = []
    if words:
        low = pairs.where("_plain").select("name", "value", F.lower("name").alias("_n"), F.lower("value").alias("_w"))
        heard = hear(low.select(F.col("_n").alias("name"), F.col("_w").alias("value")).distinct(), words, statements, judge)
        found.append(low.join(heard.withColumnsRenamed({"name": "_n", "value": "_w"}), ["_n", "_w"]).select(*columns))
    if others or not words:
        found.append(_heard(pairs.where(~F.col("_plain")), statements, judge.whole, judge.fields).withColumn("_k", F.lit(1).cast("long")).select(*columns))
    return reduce(DataFrame.unionByName, found)


def verify_claims(claims: DataFrame, statements: DataFrame, rules: Rules, strict: bool = False) -> DataFrame:
    """Columns claim_id, statement_id, tier, intent and rule: the best evidence for each claim (claim_id, name, value).

    Candidates are the statements that mention the name. The earliest canon statement wins, else the earliest likely
    one; ``strict`` keeps canon only. Claims of the same name and value are graded once.
    """
    ensure_checkpoint_dir(claims.sparkSession)
    claims = claims.select("claim_id", "name", "value").checkpoint()
    judge = Judge(rules, partial(evaluate, rules=rules), evaluate_seen, ("tier", "intent", "rule"), lambda got: 0 if got[0] == "canon" else 1)
    graded = _told(claims, statements, judge)
    if strict:
        graded = graded.where("tier = 'canon'")
    best = graded.groupBy("name", "value").agg(F.min(F.struct(F.when(F.col("tier") == "canon", 0).otherwise(1).alias("_t"), "ordinal", "statement_id", "tier", "intent", "rule")).alias("_b"))
    return claims.join(best, ["name", "value"]).select("claim_id", "_b.statement_id", "_b.tier", "_b.intent", "_b.rule")


def top_subjects(observations: DataFrame, subject: str, n: int) -> DataFrame:
    """Columns name and observations of the ``n`` most observed subjects, ties by name."""
    per = observations.where(F.col(subject).isNotNull()).groupBy(F.col(subject).alias("name")).agg(F.count(F.lit(1)).alias("observations"))
    return per.orderBy(F.desc("observations"), "name").limit(n)


def verified_facts(best: DataFrame, claims: DataFrame, page: Column) -> DataFrame:
    """Columns claim_id, name, predicate, value, tier, intent and sources of what ``verify_claims`` found (best).

    Two sources each: the statement with its rule, and the record (``page`` of the claim, its predicate as field) with
    the value as it was, by which a later change shows.
    """
    both = best.join(claims, "claim_id")
    none = F.lit(None).cast("string")
    source = lambda kind, item, rule, page, field, value: F.struct(F.lit(kind).alias("type"), item.alias("item_id"), rule.alias("match_type"), page.alias("page"), field.alias("field"), value.alias("value_at_verify"))
    said = source("statement", F.col("statement_id").cast("string"), F.col("rule"), none, none, none)
    record = source("record", none, none, page, F.col("predicate"), F.col("value"))
    return both.select("claim_id", "name", "predicate", "value", "tier", "intent", F.array(said, record).alias("sources"))


def changed_since(facts: DataFrame, records: DataFrame) -> DataFrame:
    """Columns claim_id, then and now of facts whose record (page, field, value) has another value than their snapshot."""
    source = facts.select("claim_id", F.explode("sources").alias("_s")).where("_s.type = 'record'")
    both = source.select("claim_id", F.col("_s.page").alias("page"), F.col("_s.field").alias("field"), F.col("_s.value_at_verify").alias("then")).join(records, ["page", "field"])
    return both.where(~F.col("then").eqNullSafe(F.col("value"))).select("claim_id", "then", F.col("value").alias("now"))


def curation_queue(best: DataFrame, claims: DataFrame, ledger: DataFrame) -> DataFrame:
    """Columns claim_id, evidence_id, name, predicate, value and rule: ambiguous evidence that the ledger (claim_id, evidence_id) hasn't decided."""
    open_ = best.where("intent = 'ambiguous'").withColumnRenamed("statement_id", "evidence_id").join(ledger.select("claim_id", "evidence_id"), ["claim_id", "evidence_id"], "left_anti")
    return open_.join(claims, "claim_id").select("claim_id", "evidence_id", "name", "predicate", "value", "rule")


def apply_decisions(queue: DataFrame, facts: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The queue without decided items, and the facts with approved likely ones lifted to canon.

    ``ledger`` has claim_id, evidence_id, decision and ordinal; its last row for a pair counts.
    """
    last = ledger.groupBy("claim_id", "evidence_id").agg(F.max_by("decision", "ordinal").alias("decision"))
    approved = last.where("decision = 'approve'").select("claim_id").distinct().withColumn("_ok", F.lit(True))
    lifted = facts.join(approved, "claim_id", "left")
    up = F.coalesce("_ok", F.lit(False)) & (F.col("tier") == "likely")
    return queue.join(last, ["claim_id", "evidence_id"], "left_anti"), lifted.withColumn("approved", up).withColumn("tier", F.when(F.col("approved"), "canon").otherwise(F.col("tier"))).drop("_ok")


def prove_claims(claims: DataFrame, facts: DataFrame, statements: DataFrame, rules: Rules) -> DataFrame:
    """Columns claim_id, support, contradict, verdict, tier and context of claims (claim_id, name, predicate, value).

    Facts of the same name and predicate support with an equivalent value, else contradict. Every statement that
    mentions the name counts as ``grade`` has it, as of tier canon if it supports or contradicts; context is counted
    up to 8 and gives no verdict. A canon contradiction settles it; then canon support, any support, unknown.
    A value meets the facts' values that share a key of ``equivalent`` with it; all others contradict, and are counted as what is left.
    """
    ensure_checkpoint_dir(claims.sparkSession)
    claims = claims.select("claim_id", "name", "predicate", "value").checkpoint()
    f = facts.groupBy("name", "predicate", F.col("value").alias("_v")).agg(F.count(F.lit(1)).alias("_k"), F.count_if(F.col("tier") == "canon").alias("_sure")).checkpoint()
    asked = claims.select("name", "predicate", "value").distinct()
    key = lambda c: F.explode(equivalence_keys(F.col(c))).alias("_key")
    met = asked.select("name", "predicate", "value", key("value")).join(f.select("name", "predicate", "_v", "_k", "_sure", key("_v")), ["name", "predicate", "_key"])
    same = met.drop("_key").distinct().where(equivalent(F.col("value"), F.col("_v"))).groupBy("name", "predicate", "value").agg(F.sum("_k").alias("_f_s"), F.sum("_sure").alias("_f_cs"))
    all_ = f.groupBy("name", "predicate").agg(F.sum("_k").alias("_f"), F.sum("_sure").alias("_f_sure"))
    n = lambda side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col("_k"))), F.lit(0))

    def side(question: str, answer: str, name: str, value: str, variants: list[str]) -> tuple[str] | None:
        return (got,) if (got := grade(question, answer, name, value, variants, rules)) is not None else None

    told = _told(claims, statements, Judge(rules, side, lambda seen: (got,) if (got := grade_seen(seen)) is not None else None, ("side",)))
    told = told.groupBy("name", "value").agg(n("support").alias("_ts"), n("contradict").alias("_tc"), F.least(n("context"), F.lit(8).cast("long")).alias("_context"))
    both = claims.join(all_, ["name", "predicate"], "left").join(same, ["name", "predicate", "value"], "left").join(told, ["name", "value"], "left").na.fill(0, ["_f", "_f_sure", "_f_s", "_f_cs", "_ts", "_tc", "_context"])
    c = {k: F.col(k) for k in ("_f", "_f_sure", "_f_s", "_f_cs", "_ts", "_tc")}
    all_ = both.select("claim_id", (c["_f_s"] + c["_ts"]).alias("support"), (c["_f"] - c["_f_s"] + c["_tc"]).alias("contradict"), (c["_f_cs"] + c["_ts"]).alias("_cs"), (c["_f_sure"] - c["_f_cs"] + c["_tc"]).alias("_cc"), F.col("_context").alias("context"))
    verdict = F.when(F.col("_cc") > 0, "contradicted").when(F.col("_cs") > 0, "confirmed").when(F.col("support") > 0, "likely").otherwise("unknown")
    tier = F.when(verdict == "contradicted", "disproven").when(verdict == "confirmed", "canon").when(verdict == "likely", "likely").otherwise("speculation")
    return all_.select("claim_id", "support", "contradict", verdict.alias("verdict"), tier.alias("tier"), "context")


def parse_claims(texts: DataFrame, names: DataFrame, predicates: list[tuple[str, str, str]]) -> DataFrame:
    """Columns text_id, name, predicate and value of texts (text_id, text): the longest known name, the first predicate.

    ``predicates`` are (name, keyword, pattern of the value); without a match the value is what follows the keyword,
    up to punctuation. Texts that lack a part give no row.
    """
    long = names.where(F.length("name") >= 3).select("name", F.col("name").alias("form"))
    met = mentions(long, texts, "text_id", "text").groupBy("text_id").agg(F.max(F.struct(F.length("name").alias("n"), "name")).alias("_n"))
    both = texts.join(met, "text_id")
    low = F.lower("text")
    value = lambda k, p: F.coalesce(F.when(F.regexp_extract("text", p, 1) != "", F.regexp_extract("text", p, 1)), F.trim(F.regexp_extract("text", rf"(?i){k}\s+([^.,;!?]*)", 1)))
    pick = F.coalesce(*[F.when(F.contains(low, F.lit(k)), F.struct(F.lit(n).alias("predicate"), value(k, p).alias("value"))) for n, k, p in predicates])
    return both.withColumn("_p", pick).where("_p is not null and _p.value <> ''").select("text_id", F.col("_n.name").alias("name"), "_p.predicate", "_p.value")


def retrieve_evidence(posts: DataFrame, statements: DataFrame, k: int = 5, stop: tuple[str, ...] = ("the", "and", "this", "that"), topics: DataFrame | None = None, heavy: int = 1_000_000, most: int = 6) -> DataFrame:
    """Columns post_id, statement_id, score and rank: statements by the post's keywords they hold, those of the question half more.

    Keywords are a post's (post_id, text) distinct capitalised words of 3 letters or more, less stop words, and the
    ``topics`` (term) that it holds, in any case and of any number of words. They meet what statements hold by equality.

    Up to ``most`` keywords that would make over ``heavy`` pairs each do not: by which of them they hold, and have in the
    question, statements fall into at most 3^most classes of equal scores, of which only the first ``k`` can be among a
    post's first ``k`` for these words alone. Each set of such words looks its ``k`` best up there, once for all posts.
    """
    held = lambda c: F.array_distinct(words(c))
    both = F.concat_ws(" ", "question", "answer")
    capital = F.transform(F.regexp_extract_all("text", F.lit(r"(\p{Lu}\p{L}{2,})"), F.lit(1)), F.lower)
    keys = posts.select("post_id", F.explode(F.array_distinct(capital)).alias("_w")).where(~F.col("_w").isin(*stop))
    s = statements.select("statement_id", "ordinal", held(F.col("question")).alias("_q"), held(both).alias("_all"))
    said = s.select("statement_id", "ordinal", F.explode("_all").alias("_w"), F.col("_q")).withColumn("_in_q", F.array_contains("_q", F.col("_w"))).drop("_q")
    if topics is not None:
        terms = topics.select("term", F.array_join(words(F.col("term")), " ").alias("_w")).distinct()
        keys = keys.union(find_forms(posts, ("post_id",), "text", terms, "term").select("post_id", "_w")).distinct()
        several = terms.where(F.contains("_w", F.lit(" ")))  # single words are there already
        asked = find_forms(statements, ("statement_id",), "question", several, "term").select("statement_id", "_w", F.lit(True).alias("_in_q")).distinct()
        found = find_forms(statements.select("statement_id", "ordinal", both.alias("_both")), ("statement_id", "ordinal"), "_both", several, "term").select("statement_id", "ordinal", "_w").distinct()
        said = said.unionByName(found.join(asked, ["statement_id", "_w"], "left").na.fill(False, ["_in_q"]))
    costs = said.groupBy("_w").agg(F.count(F.lit(1)).alias("_s")).join(keys.groupBy("_w").agg(F.count(F.lit(1)).alias("_p")), "_w")
    common = [r["_w"] for r in costs.where(F.col("_s") * F.col("_p") > heavy).orderBy(F.desc(F.col("_s") * F.col("_p")), "_w").limit(most).collect()]
    if common:
        ensure_checkpoint_dir(posts.sparkSession)
        place = F.array_position(F.array(*[F.lit(w) for w in common]), F.col("_w")).cast("int")
        bit = F.call_function("shiftleft", F.lit(1), place - 1)
        often = F.col("_w").isin(*common)
        masks = said.where(often).groupBy("statement_id", "ordinal").agg(F.bit_or(bit).alias("_all"), F.bit_or(F.when(F.col("_in_q"), bit).otherwise(0)).alias("_q")).checkpoint()
        sets = keys.where(often).groupBy("post_id").agg(F.bit_or(bit).alias("_set"))
        common_score = F.bit_count(F.col("_all").bitwiseAND(F.col("_set"))) + 0.5 * F.bit_count(F.col("_q").bitwiseAND(F.col("_set")))
        kinds = masks.withColumn("_n", F.row_number().over(Window.partitionBy("_all", "_q").orderBy("ordinal", "statement_id"))).where(F.col("_n") <= k)
        # both sides are bounded: k rows for each class, and 2^most sets
        tried = kinds.join(F.broadcast(sets.select("_set").distinct()), F.col("_all").bitwiseAND(F.col("_set")) != 0).withColumn("score", common_score)
        tried = tried.withColumn("_n", F.row_number().over(Window.partitionBy("_set").orderBy(F.desc("score"), "ordinal", "statement_id"))).where(F.col("_n") <= k)
        known = sets.join(tried.select("_set", "statement_id", "ordinal", "score"), "_set").select("post_id", "statement_id", "ordinal", "score")
        keys, said = keys.where(~often), said.where(~often)
    scored = keys.join(said, "_w").groupBy("post_id", "statement_id", "ordinal").agg((F.count(F.lit(1)) + 0.5 * F.count_if("_in_q")).alias("score"))
    if common:
        whole = scored.join(sets, "post_id", "left").join(masks.drop("ordinal"), "statement_id", "left")
        whole = whole.select("post_id", "statement_id", "ordinal", (F.col("score") + F.coalesce(common_score, F.lit(0.0))).alias("score"))
        scored = whole.unionByName(known).groupBy("post_id", "statement_id", "ordinal").agg(F.max("score").alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("post_id").orderBy(F.desc("score"), "ordinal")))
    return ranked.where(F.col("rank") <= k).select("post_id", "statement_id", "score", "rank")


def search(queries: DataFrame, catalogue: DataFrame, caps: dict[str, int], open_kinds: tuple[str, ...] = ("subject",), latest: int | None = None, small: int = 10_000) -> DataFrame:
    """Columns query_id, kind, item_id and rank: hits of a query's text in titles (kind, item_id, title, first) under its cutoff.

    Items past the cutoff, and those of other than open kinds without a first position, stay hidden. A kind gives its
    cap at most, in order of title. With ``latest``, a query that is a number from 1 to it, of four digits at most, also hits that position (kind
    ``position``). Equal texts under equal cutoffs are searched once, and their ranked hits given to each query (query_id, text,
    cutoff; its id is a key). Up to ``small`` of them are sent to the catalogue, where each title is held against them; more of
    them meet the titles by the three-letter parts of both, and shorter ones by themselves.
    """
    q = queries.withColumn("_t", F.lower(F.trim("text"))).where("_t <> ''")
    asked = q.select("_t", "cutoff").distinct()
    seen = F.coalesce(F.col("first") <= F.col("cutoff"), F.col("kind").isin(*open_kinds) & F.col("first").isNull())
    inside = F.contains(F.lower("title"), F.col("_t"))
    if asked.limit(small + 1).count() <= small:
        hits = catalogue.join(F.broadcast(asked), inside).where(seen)  # its size is counted
    else:
        part = lambda c, n: F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n)))
        title = F.lower("title")
        grams = F.flatten(F.array(*[F.when(F.length(title) >= n, part(title, n)).otherwise(F.array().cast("array<string>")) for n in (1, 2, 3)]))
        asked = sent_if_small(asked.withColumn("_g", F.substring("_t", 1, 3)))
        hits = catalogue.withColumn("_g", F.explode(F.array_distinct(grams))).join(asked, "_g").where(inside & seen)
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("_t", "cutoff", "kind").orderBy("title", "item_id"))).where(F.col("rank") <= max(5, *caps.values(), 0))
    cap = F.coalesce(*[F.when(F.col("kind") == k, n) for k, n in caps.items()], F.lit(5))
    ranked = ranked.where(F.col("rank") <= cap).select(F.col("_t").alias("_u"), F.col("cutoff").alias("_c"), "kind", "item_id", "rank")
    # neither side is known to be small
    found = q.join(ranked.hint("merge"), (F.col("_t") == F.col("_u")) & F.col("cutoff").eqNullSafe(F.col("_c"))).select("query_id", "kind", "item_id", "rank")
    if latest is None:
        return found
    number = F.when(F.col("_t").rlike(r"^\d{1,4}$"), F.col("_t").cast("long"))
    places = q.withColumn("_n", number).where(F.col("_n").between(1, latest))
    return found.unionByName(places.select("query_id", F.lit("position").alias("kind"), F.col("_n").cast(catalogue.schema["item_id"].dataType).alias("item_id"), F.lit(1).alias("rank")))


def build_cards(sources: dict[str, DataFrame], title: int = 120, tokens: int = 400) -> DataFrame:
    """Columns id, type, title, subtitle and tokens of sources (id, title, subtitle, text): typed cards put together."""
    out = None
    for kind, df in sources.items():
        cut = F.when(F.length("title") > title, F.concat(F.substring("title", 1, title), F.lit("…"))).otherwise(F.col("title"))
        rows = df.select(F.concat(F.lit(kind + ":"), F.col("id").cast("string")).alias("id"), F.lit(kind).alias("type"), cut.alias("title"), "subtitle", F.substring(F.lower(F.concat_ws(" ", "title", "subtitle", "text")), 1, tokens).alias("tokens"))
        out = rows if out is None else out.unionByName(rows)
    return out
