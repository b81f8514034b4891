"""Secret scans with DataFrame functions only: fixed patterns, and character Markov models for the rest.

First-order Markov models over characters, of random strings and of ordinary identifiers, are compared by the mean
log-likelihood ratio of a token. Tokens are of four classes (digits, capitals, small letters, mixed), since what is
ordinary in one is odd in another; each class has its own pair of models, trained from labelled samples, and its bars by length,
set on samples that were not trained on. The trained table has one weight for each class and pair of characters,
which bounds what comes to the driver and goes back as a literal.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds in their order, with pattern, the group whose length counts, and its least length.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = (("assign", ASSIGN, 2, 12), ("access", ACCESS, 0, 18), ("hex", HEX, 0, 16))

#: What may be a secret of no fixed form: long runs of the characters that encodings use, and what parts them.
SHORTEST = 20
TOKEN = rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}"
SEPARATORS = "[+/_=-]"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Classes by their letters: none, capitals only, small ones only, both. Lengths from which on a bar holds.
CLASSES, LENGTHS = 4, (20, 28, 40)
#: Documents that ordinary words are taken from, about; random strings and identifiers made for each form.
SAMPLE_DOCS, SAMPLE_MADE = 2000, 3000
#: Share of held-out random strings that a bar may leave out, and of held-out ordinary identifiers that it has to leave alone.
MISSED, SPARED = 0.02, 0.997

#: Words that identifiers are made of.
WORDS = """access account action active address agent alias align allow amount append apply archive array assert attribute
audio author backup balance bank base batch block body bound branch bridge browser buffer build bundle button cache
call cancel canvas capture card catalog category cell center chain change channel character check child chunk class clean
client clock clone close cloud code collection color column command comment commit compare complete component compute
config connect console constant container content context control convert copy count create current cursor custom data
database date debug decode default delete delta deploy detail device digest directory disable dispatch display document
domain double download draft driver dump dynamic edit element email empty enable encode engine entry error event example
exception execute export extension factory failure feature field file filter final flag folder font format frame function
generate global graph group handler hash header height history host icon image import include index input insert install
instance integer interface internal invoice item iterator keyboard label language layer layout length level library
limit line link list load local location lock logger login lookup machine manager mapping margin master match matrix
maximum member memory menu merge message method metric minimum mode model module monitor mount name network node
notify number object offset option order output owner package packet page parameter parent parse partition path pattern
payment pending permission pixel plugin point policy pool position prefix preview print priority process product profile
project property protocol provider proxy public query queue random range reader record reference region register release
remote remove render replace report request reset resolve resource response result retry return role rotate route
sample schedule schema scope screen script search section segment select sender sequence server service session setting
shadow shape share signal size snapshot socket sort source space split stack stage start state static status storage
stream string style submit summary switch symbol sync system table target task template test text theme thread threshold
timeout timestamp title toggle total trace track transfer transform transport trigger type update upload user utility
validate value variable vector version video view virtual visible volume warning watch weight widget width window worker
wrapper write""".split()


@dataclass(frozen=True)
class Model:
    """Weights log P(b | a, random) - log P(b | a, ordinary), at index (class * n + a) * n + b, and a bar for each class and length."""

    weights: tuple[float, ...]
    bars: tuple[tuple[float, ...], ...]
    alphabet: str = ALPHABET


def _no_shorter(pattern: str, least: int) -> str:
    """The pattern with its last run held to ``least`` characters in all; for patterns that are one run."""
    fixed = len(pattern.split("[")[0])
    return f"{pattern[:-1]}{{{least - fixed},}}"


#: Elements of an array that are folded at once, so that none is appended to beyond that; characters of a text's block.
FOLD, BLOCK = 64, 1024


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(values: Column, largest: bool = False) -> Column:
    """Running sums of an array of whole numbers, or running maxima.

    The array is cut into pieces of ``FOLD``; these are folded each, and raised by what the pieces before them come to, which
    is found by the same rule. So the cost follows the length of the array, up to millions of elements.
    """

    def fold(a: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            at = F.greatest(acc["at"], x) if largest else acc["at"] + x
            return F.struct(at.alias("at"), F.concat(acc["all"], F.array(at)).alias("all"))

        return F.aggregate(a, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")), step, lambda acc: acc["all"])

    def raised(pieces: Column, ends: Column) -> Column:
        before = F.slice(F.concat(F.array(F.lit(0)), ends), F.lit(1), F.size(pieces))
        return F.flatten(F.zip_with(pieces, before, lambda p, t: F.transform(p, lambda v: F.greatest(v, t) if largest else v + t)))

    def long(a: Column, deeper) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.size(a) - 1, F.lit(FOLD)), lambda i: fold(F.slice(a, i + 1, F.lit(FOLD))))
        return _let(cut, lambda pieces: raised(pieces, _let(F.transform(pieces, lambda p: F.element_at(p, -1)), deeper)))

    short = lambda a, otherwise: F.when(F.size(a) <= FOLD, fold(a)).otherwise(otherwise(a))
    return _let(values, lambda a: short(a, lambda a: long(a, lambda t: short(t, lambda t: long(t, fold)))))


def _span(start: Column, order: Column, kind: Column, end: Column, value: Column) -> Column:
    return F.struct(start.alias("start"), order.alias("order"), kind.alias("kind"), end.alias("end"), value.alias("value"))


def match_spans(text: Column, kind: str, order: int, pattern: str, group: int | None, least: int) -> Column:
    """Array of (start, order, kind, end, value) of the pattern's leftmost non-overlapping matches, in code points.

    Matches whose group is shorter than ``least`` are used up, but dropped; without a group the pattern itself
    holds them to that length.
    """
    # A run that is too short holds no longer one, so runs can be asked for at full length at once.
    used = _no_shorter(pattern, least) if group == 0 else pattern
    found = F.regexp_extract_all(text, F.lit(used), F.lit(0))

    def placed(hits: Column) -> Column:
        sizes = F.zip_with(F.slice(F.split(text, used, -1), F.lit(1), F.size(hits)), hits, lambda gap, hit: F.length(gap) + F.length(hit))
        return F.zip_with(hits, _running(sizes), lambda hit, end: _span(end - F.length(hit), F.lit(order), F.lit(kind), end, F.regexp_extract(hit, used, group) if group else hit))

    none = F.array().cast("array<struct<start:int,order:int,kind:string,end:int,value:string>>")
    return F.when(text.rlike(used), F.filter(_let(found, placed), lambda s: F.length(s["value"]) >= least)).otherwise(none)


def labelled_samples(docs: DataFrame, docs_bound: int = SAMPLE_DOCS, made: int = SAMPLE_MADE) -> DataFrame:
    """Labelled samples (token, label, n): 1 for random strings, 0 for ordinary identifiers, n to tell what is held out.

    Random strings are digests of running numbers in base 10, 26 and 36 (of either case) and 64. Ordinary identifiers are joined
    from three words, of ``WORDS`` and of about ``docs_bound`` documents (those whose ids' hashes are below a bar set by
    their number), in the ways that names are written: in small letters or capitals with separators, camel case, paths,
    with and without a number; and numbers as they are written: padded, counted up, dates.
    """
    spark = docs.sparkSession
    digest = F.sha2(F.col("id").cast("string"), 256)
    n = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1 << 20)).cast("int")
    base = lambda to: F.concat(*[F.conv(F.substring(digest, 1 + 15 * k, 15), 16, to) for k in range(4)])
    size = lambda k: F.lit(SHORTEST) + n(k) % 24
    cut = lambda c, k: F.substring(c, F.lit(1), size(k))
    binary = F.base64(F.unhex(digest))
    letters = F.translate(base(26), "0123456789ABCDEFGHIJKLMNOP", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    random = F.array(cut(base(10), 1), cut(base(36), 2), F.lower(cut(base(36), 3)), cut(binary, 4), cut(F.translate(binary, "+/=", "-_x"), 5), cut(F.translate(binary, "+/=", "abC"), 6), cut(letters, 21), F.lower(cut(letters, 22)))
    rows = spark.range(made).select("id", F.explode(random).alias("token"), F.lit(1).alias("label"))

    def written(words: Column, number: Column) -> Column:
        """The ways that three words are written as one name."""
        low, up, camel_words = F.transform(words, F.lower), F.transform(words, F.upper), F.transform(words, F.initcap)
        camel = F.array_join(camel_words, "")
        one, joined = number.cast("string"), lambda w, sep: F.array_join(w, sep)
        return F.array(
            joined(low, "_"), joined(low, "-"), joined(low, "/"), joined(low, ""), F.concat(joined(low, "_"), F.lit("_"), one), F.concat(joined(low, "-"), F.lit("-v"), one),
            joined(up, "_"), F.concat(joined(up, "_"), F.lit("_"), one), joined(up, ""), F.concat(joined(up, "-"), one),
            F.concat(joined(low, "_"), F.lit("="), joined(low, "_")), F.concat(joined(low, "_"), F.lit("="), joined(up, "_")), F.concat(F.lit("/"), joined(low, "/")), F.concat(F.lit("_"), joined(up, "__")), F.concat(F.lit("_"), camel),
            F.concat(F.get(camel_words, F.lit(0)), F.lit("/"), F.get(camel_words, F.lit(1)), F.lit("_"), F.get(low, F.lit(2))), F.concat(F.get(up, F.lit(0)), F.get(camel_words, F.lit(1)), F.get(camel_words, F.lit(2))), 
            camel, F.concat(F.lower(F.substring(camel, 1, 1)), F.substring(camel, 2, 99)), F.concat(camel, one), F.concat(camel, F.lit("/"), joined(low, "_")), F.concat(joined(low, "/"), F.lit("/"), camel),
        )

    listed = F.split(F.lit(" ".join(WORDS)), " ")
    pick = lambda k: F.get(listed, n(k) % len(WORDS))
    named = spark.range(made).select("id", F.explode(written(F.array(pick(7), pick(8), pick(9)), n(10) % 2100)).alias("token"))
    padded = F.array(F.lpad(n(11).cast("string"), 20, "0"), F.lpad(n(12).cast("string"), 32, "0"), F.date_format(F.timestamp_seconds(n(13).cast("long") * 1500), "yyyyMMddHHmmssyyyyMMdd"), F.date_format(F.timestamp_seconds(n(14).cast("long") * 1500), "yyyy-MM-dd-HH-mm-ss"), F.concat_ws("-", n(15) % 100, n(16) % 100, n(17) % 1000, F.lit("00000000000")), F.repeat((n(18) % 10).cast("string"), 24), F.repeat(F.get(F.split(F.lit("- = _ / + x"), " "), n(19) % 6), F.lit(20) + n(20) % 40))
    numbers = spark.range(made).select("id", F.explode(padded).alias("token"))
    share = min(1.0, docs_bound / max(1, docs.count()))
    few = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < int(share * (1 << 32)))
    found = few.select(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[A-Za-z]{3,}"), F.lit(0)).alias("w"))
    # each document gives what begins at every 16th word, so that long ones don't outweigh the rest by much more
    three = found.select(F.posexplode(F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - 2)), lambda i: i % 16 == 1), lambda i: F.slice("w", i, F.lit(3)))).alias("i", "w")).where(F.size("w") == 3)
    corpus = three.select(F.xxhash64("w").alias("id"), F.explode(written(F.col("w"), F.col("i"))).alias("token"))
    ordinary = named.union(numbers).union(corpus).select("id", "token", F.lit(0).alias("label"))
    return rows.unionByName(ordinary).select("token", "label", F.pmod(F.xxhash64("id", "label"), F.lit(4)).cast("int").alias("n"))


def token_class(token: Column) -> Column:
    """0 without letters, 1 with capitals only, 2 with small ones only, 3 with both."""
    return F.when(token.rlike("[A-Z]"), F.when(token.rlike("[a-z]"), 3).otherwise(1)).when(token.rlike("[a-z]"), 2).otherwise(0)


def _length_class(token: Column) -> Column:
    return F.coalesce(*[F.when(F.length(token) >= LENGTHS[i], i) for i in range(len(LENGTHS) - 1, -1, -1)], F.lit(0))


def train_markov(samples: DataFrame, alphabet: str = ALPHABET, smoothing: float = 0.5, missed: float = MISSED, spared: float = SPARED) -> Model:
    """A model from labelled samples (token, label, n): trained where n isn't 0, its bars set where n is 0.

    A bar leaves the share ``missed`` of the random held-out tokens of its class and length below it, and at least the share
    ``spared`` of the ordinary ones: where both are far apart, what lies between is left alone. At most
    2 * CLASSES * len(alphabet)^2 counts come to the driver. Classes without samples get even weights, and no token of theirs
    passes; neither does one below a ratio of 0.
    """
    n = len(alphabet)
    kind = token_class(F.col("token"))
    pairs = samples.where((F.length("token") >= 2) & (F.col("n") != 0)).select("label", kind.alias("kind"), F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring(F.col("token"), i, F.lit(2)))).alias("pair"))
    counts = [[[[smoothing] * n for _ in range(n)] for _ in range(CLASSES)] for _ in range(2)]
    at = {c: i for i, c in enumerate(alphabet)}
    for row in pairs.where(F.col("pair").rlike(f"^[{_class(alphabet)}]{{2}}$")).groupBy("label", "kind", "pair").count().collect():
        counts[row["label"]][row["kind"]][at[row["pair"][0]]][at[row["pair"][1]]] += row["count"]
    logs = [[log(x / sum(line)) for table in label for line in table for x in line] for label in counts]
    weights = tuple(round(r - o, 4) for r, o in zip(logs[1], logs[0]))
    open_ = Model(weights, ((0.0,) * len(LENGTHS),) * CLASSES, alphabet)
    held = samples.where((F.col("n") == 0) & (F.length("token") >= SHORTEST))
    ratio = held.select("label", kind.alias("kind"), _length_class(F.col("token")).alias("size"), markov_ratio(F.col("token"), open_).alias("ratio"))
    at = lambda label, share: F.percentile(F.when(F.col("label") == label, F.col("ratio")), share)
    found = ratio.groupBy("kind", "size").agg(F.greatest(at(1, missed), at(0, spared)).alias("bar")).where("bar is not null")
    bars = {(r["kind"], r["size"]): r["bar"] for r in found.collect()}
    widest = {k: max((v for (c, _), v in bars.items() if c == k), default=float("inf")) for k in range(CLASSES)}
    return Model(weights, tuple(tuple(max(0.0, bars.get((k, i), widest[k])) for i in range(len(LENGTHS))) for k in range(CLASSES)), alphabet)


def _class(alphabet: str) -> str:
    return "".join("\\" + c if c in "-]^\\/+" else c for c in alphabet)


def _literal(values) -> Column:
    """An array of doubles as one constant."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def markov_ratio(token: Column, model: Model) -> Column:
    """Mean log-likelihood ratio of random against ordinary for each pair of characters of an ASCII token, by its class's models."""
    n = len(model.alphabet)
    place = F.split(F.lit(",".join(str(model.alphabet.find(chr(i))) for i in range(128))), ",").cast("array<int>")
    table = _literal(model.weights)
    chars = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.get(place, F.ascii(c)))
    # the class's place in the table goes along, so that it is found once for a token
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"), (token_class(token) * (n * n)).alias("first"))

    def step(acc: Column, c: Column) -> Column:
        known = (acc["last"] >= 0) & (c >= 0)
        return F.struct(c.alias("last"), (acc["sum"] + F.when(known, F.get(table, acc["first"] + acc["last"] * n + c)).otherwise(0.0)).alias("sum"), acc["first"].alias("first"))

    return F.aggregate(chars, start, step, lambda acc: acc["sum"]) / F.greatest(F.length(token) - 1, F.lit(1))


def is_random(token: Column, model: Model) -> Column:
    """True where the ratio passes the bar of the token's class and length."""
    bars = _literal([b for line in model.bars for b in line])
    return markov_ratio(token, model) > F.get(bars, token_class(token) * len(LENGTHS) + _length_class(token))


def _blocks(text: Column) -> Column:
    """The text in blocks of ``BLOCK`` characters, so that a place in it is found without reading what lies before."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def _part(blocks: Column, start: Column, end: Column) -> Column:
    """What stands from ``start`` to ``end`` in a text of these blocks."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor((end - 1) / BLOCK).cast("int")
    head = F.substring(F.get(blocks, first), start % BLOCK + 1, F.least(end - start, F.lit(BLOCK)))
    more = F.concat(head, F.array_join(F.slice(blocks, first + 2, last - first - 1), ""), F.substring(F.get(blocks, last), F.lit(1), end - last * BLOCK))
    return F.when(end <= start, "").when(first == last, head).otherwise(more)


def _rewritten(text: str, spans: str, write) -> Column:
    """The text with ``write(at, start, end, part)`` for each span in order of start, ``at`` being how far those before it reach, and
    what follows the last. Columns of the names ``text``, ``spans`` and ``_blocks``."""
    part = lambda a, b: _part(F.col("_blocks"), a, b)

    def whole(reached: Column) -> Column:
        before = F.slice(F.concat(F.array(F.lit(0)), reached), F.lit(1), F.size(reached))
        parts = F.zip_with(F.col(spans), before, lambda s, at: write(at, s["start"], s["end"], part))
        return F.concat(F.array_join(parts, ""), part(F.element_at(reached, -1), F.length(text)))

    return F.when(F.size(spans) == 0, F.col(text)).otherwise(_let(_running(F.transform(spans, lambda s: s["end"]), largest=True), whole))


def _blanked(at: Column, start: Column, end: Column, part) -> Column:
    """What is free before a span, and blanks for what it covers anew."""
    fresh = F.greatest(at, start)
    return F.concat(part(at, fresh), F.repeat(F.lit(" "), F.greatest(at, end) - fresh))


def _pieces(token: Column) -> Column:
    """The parts of a token between separators that are long enough, as spans of their own."""

    def placed(parts: Column) -> Column:
        ends = _running(F.transform(parts, lambda x: F.length(x) + 1))
        return F.zip_with(parts, ends, lambda x, to: _span(token["start"] + to - 1 - F.length(x), token["order"], token["kind"], token["start"] + to - 1, x))

    return F.filter(_let(F.split(token["value"], SEPARATORS, -1), placed), lambda s: F.length(s["value"]) >= SHORTEST)


def _scanned(docs: DataFrame, model: Model) -> DataFrame:
    """Columns row (all of the table's), text (null as empty), base, spans and _blocks (of texts with a span)."""
    text = F.col("text")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("base", F.array_sort(F.concat(*[match_spans(text, k, i, p, g, n) for i, (k, p, g, n) in enumerate(KINDS)])))
    rows = rows.withColumn("_blocks", F.when((F.size("base") > 0) | text.rlike(TOKEN), _blocks(text)))
    rows = rows.withColumn("free", _rewritten("text", "base", _blanked))
    rows = rows.withColumn("tokens", match_spans(F.col("free"), "markov", len(KINDS), TOKEN, None, SHORTEST)).drop("free")
    test = lambda t: is_random(t["value"], model)
    random = F.flatten(F.transform("tokens", lambda t: F.when(test(t), F.array(t)).otherwise(F.filter(_pieces(t), test))))
    return rows.withColumn("spans", F.when(F.size("tokens") == 0, F.col("base")).otherwise(F.array_sort(F.concat("base", random)))).drop("tokens")


def scan_secrets(docs: DataFrame, model: Model) -> DataFrame:
    """Columns doc_id, text, base and spans: arrays of (start, order, kind, end, value) in order of start, then kind.

    ``base`` has the matches of the fixed patterns, ``spans`` those and what the Markov models take for random in the
    rest (kind "markov"): runs of 20 or more characters, or else their parts of that length between separators. Null
    texts count as empty; a null doc_id stays null; repeated rows are scanned each; other columns are not read; an
    empty table gives no rows.
    """
    return _scanned(docs.select("doc_id", "text"), model).select("row.doc_id", "text", "base", "spans")


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, model: Model, mask: str = "[SECRET]") -> DataFrame:
    """The same rows and columns, with ``mask`` in ``text`` for each stretch that secrets cover; those that overlap
    share one. Texts without a secret, and null ones, stay as they are; other columns may have any names; an empty
    table gives no rows."""
    rows = _scanned(docs, model)

    def masked(at: Column, start: Column, end: Column, part) -> Column:
        return F.when((start < at) & (at > 0), "").otherwise(F.concat(part(at, start), F.lit(mask)))

    whole = _rewritten("text", "spans", masked)
    kept = F.when(F.size("spans") == 0, F.col("row.text")).otherwise(whole)
    return rows.select(*[kept.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def trained_model(spark: SparkSession, docs: DataFrame) -> Model:
    """The model from the default labelled samples of ``docs``."""
    return train_markov(labelled_samples(docs.select("doc_id", "text")))
