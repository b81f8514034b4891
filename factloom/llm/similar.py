"""Near-duplicates at a similarity: SimHash blocks and MinHash bands name candidates, the sets of shingles themselves decide.

This is the near-duplicate operator's form for a similarity of sets. Texts whose SimHash fingerprints differ in at most 2 bits
are brought together by that operator's pigeonhole blocks (``simhash.near_links``). Texts at Jaccard 0.8 differ in about 10 of
64 bits, and no blocks are left at that distance; those links are named by MinHash bands, so that none is lost.

Two sets with Jaccard similarity J have the same least element under a random order with probability J. A document has
``HASHES`` such least elements; ``BAND`` of them make a key, so that two documents share a given key with probability
J^BAND, and one of all keys with 1 - (1 - J^BAND)^keys: 0.998 at J = 0.8 with 16 keys, whatever the number of rows.
Documents with a key in common are then settled in two steps; of the pairs at exactly the similarity, the sketches named below lose
about 3 in 100,000, and of those above it fewer:

1. Each member of a key is held against the key's least member, which is linear in the group, and so are the ends of
   SimHash links. Verified links give components.
2. Keys whose members lie in more than one component are met again: every two members of different components are
   compared, in cells of bounded size that are dealt over tasks and hold their members' sets. Members of the key's
   largest component meet the others only, so a large family with few outsiders costs little. A cell compares where it
   stands and gives back a forest of its links, so that rows grow with the members, not with the pairs.

In cells, sketches (a byte of each least element) spare the pairs that lie 4 standard deviations under the similarity.
What remains, and every pair of step 1, is verified on both sets of shingles. Shingles are told by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from math import ceil, floor, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.components import connected_components
from factloom.llm.simhash import majority, near_links
from factloom.session import ensure_checkpoint_dir

#: Members of a cell's side, and the shingles of all of them, on average.
SMALL, SHINGLES = 256, 1 << 18
#: Least elements of a document, at least, and how many of them make a key.
HASHES, BAND = 128, 5
#: Pairs with a common end from which on its set is copied, once for so many pairs.
DEALT = 4096


def _digest(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def _shingles(data: bytes, shingle: int, digest) -> np.ndarray:
    """Hashes of the distinct shingles, in order; texts of fewer words are one shingle."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    parts = map(b" ".join, zip(*[words[i:] for i in range(shingle)])) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.fromiter(map(digest, parts), dtype="<u8"))


def _least(hashes: np.ndarray, n: int) -> np.ndarray:
    """The least of the hashes in each of n orders."""
    flip, odd = np.random.default_rng(42).integers(0, 1 << 64, (2, n, 1), dtype="u8")
    out = np.full(n, (1 << 64) - 1, dtype="u8")
    for i in range(0, len(hashes), 1 << 10):
        np.minimum(out, ((hashes[None, i : i + (1 << 10)] ^ flip) * (odd | np.uint64(1))).min(axis=1), out=out)
    return out


def _cells(batches: Iterator[pa.RecordBatch], similarity: float, bar: int) -> Iterator[pa.RecordBatch]:
    """From rows (key, lo, hi, side, comp, sketch, shingles) in order of cell: links (a, b) of components.

    Of a cell's links those are given that first join two of its components; the pairs are taken whole, so that every
    two components that a pair of the cell links are joined.
    """
    held, rows = None, []

    def flush() -> list[tuple[int, int]]:
        side, comp = (np.array([r[i] for r in rows], dtype="i8") for i in range(2))
        x = np.frombuffer(b"".join(r[2] for r in rows), dtype="u1").reshape(len(rows), -1)
        sets = [frozenset(r[3].tolist()) for r in rows]
        root, found = {c: c for c in comp.tolist()}, []

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        left, right = np.flatnonzero(side == held[1]), np.flatnonzero(side == held[2])
        for start in range(0, len(left), 32):
            part = left[start : start + 32]
            open_ = comp[part][:, None] != comp[right][None, :]
            if held[1] == held[2]:
                open_ &= part[:, None] < right[None, :]
            if not open_.any():
                continue
            like = np.count_nonzero(x[part][:, None, :] == x[right][None, :, :], axis=2)
            i, j = np.nonzero(open_ & (like >= bar))
            order = np.argsort(-like[i, j], kind="stable")
            for a, b in zip(part[i[order]].tolist(), right[j[order]].tolist()):
                ca, cb = find(int(comp[a])), find(int(comp[b]))
                if ca != cb:
                    inter = len(sets[a] & sets[b])
                    if inter >= similarity * (len(sets[a]) + len(sets[b]) - inter) - 1e-9:
                        root[max(ca, cb)] = min(ca, cb)
                        found.append((int(comp[a]), int(comp[b])))
        return found

    def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(2)], names=["a", "b"])

    for batch in batches:
        flat, bounds = batch.column(6).values.to_numpy(), batch.column(6).offsets.to_numpy()
        sets = [flat[s:e] for s, e in zip(bounds[:-1], bounds[1:])]
        for key, lo, hi, *row in zip(*[c.to_pylist() for c in batch.columns[:6]], sets):
            if (key, lo, hi) != held:
                if len(rows) > 1 and (found := flush()):
                    yield out(found)
                held, rows = (key, lo, hi), []
            rows.append(row)
    yield out(flush() if len(rows) > 1 else [])


def _dealt_cells(held: DataFrame, small: int, shingles: int) -> DataFrame:
    """Columns key, lo, hi, side, node and comp: the members (key, node, comp, n) of keys with several components, in
    cells of the sides lo and hi where any two members of different components meet once.

    Sides 0 to main - 1 hold the largest component of a large key, and the others follow; a small key is one side. A
    side has about ``small`` members at most, and ``shingles`` (the sum of n) in all of them.
    """
    parts = held.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("w"))
    split = parts.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.sum("m").alias("m"), F.sum("w").alias("w"), F.max(F.struct("m", "comp", "w")).alias("top")).where("parts > 1")
    sides = lambda m, w: F.greatest(F.ceil(m / small), F.ceil(w / shingles), F.lit(1)).cast("long")
    whole = (F.col("m") <= small) & (F.col("w") <= shingles)
    main = F.when(whole, F.lit(0)).otherwise(sides(F.col("top.m"), F.col("top.w")))
    others = F.when(whole, F.lit(1)).otherwise(sides(F.col("m") - F.col("top.m"), F.col("w") - F.col("top.w")))
    split = split.select("key", F.when(~whole, F.col("top.comp")).alias("top"), main.cast("long").alias("main"), others.cast("long").alias("others")).checkpoint()
    mains = F.coalesce(F.col("comp") == F.col("top"), F.lit(False))
    at = F.when(mains, F.pmod(F.xxhash64("node", "key"), F.greatest("main", F.lit(1)))).otherwise(F.col("main") + F.pmod(F.xxhash64("node", "key"), F.col("others")))
    first = F.when(mains, F.col("main")).otherwise(F.lit(0))
    dealt = held.join(split, "key").withColumn("side", at).withColumn("_to", F.explode(F.sequence(first, F.col("main") + F.col("others") - 1)))
    return dealt.select("key", F.least("side", "_to").alias("lo"), F.greatest("side", "_to").alias("hi"), "side", "node", "comp")


def _dealt(pairs: DataFrame, sets: DataFrame, end: str, other: str) -> DataFrame:
    """The pairs with the set of an end. The set of an end of very many pairs is copied, and these are dealt over the copies."""
    hot = F.broadcast(pairs.groupBy(end).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > DEALT).select(F.col(end).alias("_hot"), F.ceil(F.col("_n") / DEALT).alias("_copies")))  # one of DEALT pairs at most
    copies = F.coalesce("_copies", F.lit(1).cast("long"))
    p = pairs.join(hot, F.col(end) == F.col("_hot"), "left").withColumn("_salt", F.pmod(F.xxhash64(other), copies)).drop("_hot", "_copies")
    s = sets.join(hot, F.col("node") == F.col("_hot"), "left").select(F.col("node").alias(end), F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias("_salt"), F.col("shingles").alias(f"_{end}"))
    return p.join(s, [end, "_salt"]).drop("_salt")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b, ...) whose sets of shingles have the similarity."""
    both = _dealt(_dealt(pairs, sets, "a", "b"), sets, "b", "a")
    inter: Column = F.size(F.array_intersect("_a", "_b"))
    return both.where(inter >= F.lit(similarity) * (F.size("_a") + F.size("_b") - inter) - 1e-9).drop("_a", "_b")


def _simhash_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes (node, fp): those of a fingerprint with the least of it, and the least ones of two fingerprints
    that a block of the near-duplicate operator links."""
    least = nodes.groupBy("fp").agg(F.min("node").alias("least")).checkpoint()
    same = nodes.join(least, "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    end = lambda c: least.select(F.col("fp").alias(c), F.col("least").alias(f"_{c}"))
    near = near_links(least.select("fp")).join(end("a"), "a").join(end("b"), "b")
    return same.union(near.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")))


def _classes(docs: DataFrame, shingle: int, similarity: float, recall: float) -> DataFrame:
    """Columns doc_id, digest and comp of each row: the digest tells texts, comp is the class's number."""
    ensure_checkpoint_dir(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest(text).alias("digest"), text.cast("binary").alias("text"))
    keys = ceil(log(1 - recall) / log(1 - similarity**BAND))
    hashes = max(HASHES, BAND * keys)
    p = similarity + (1 - similarity) / 256
    bar = floor(hashes * p - 4 * sqrt(hashes * p * (1 - p)))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = partial(xxhash.xxh64_intdigest, seed=42)
        for batch in batches:
            prints, sketches, bands, sizes, fps = [], [], [], [], []
            for text in batch.column(2).to_pylist():
                found = _shingles(text, shingle, digest)
                least = _least(found, hashes)
                sizes.append(len(found))
                fps.append(majority(found))
                prints.append(xxhash.xxh3_128_digest(found.tobytes()))
                sketches.append(least.astype("u1").tobytes())
                bands += [xxhash.xxh64_intdigest(least[i * BAND : (i + 1) * BAND].tobytes(), seed=i) for i in range(keys)] if len(found) else [0] * keys
            values = pa.array(np.array(bands, dtype="u8").view("i8"))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype="i4") * np.int32(keys)), values)
            columns = [batch.column(0), batch.column(1), pa.array(prints, pa.binary()), pa.array(sketches, pa.binary()), lists, pa.array(sizes, pa.int64()), pa.array(fps, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "print", "sketch", "keys", "n", "fp"])

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = partial(xxhash.xxh64_intdigest, seed=42)
        for batch in batches:
            found = [_shingles(x, shingle, digest).view("i8") for x in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, found)]).astype("i4")
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, "i8"), *found])))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["node", "shingles"])

    # numbers of rows are fixed by the checkpoint; a node is the least number of the rows with one set of shingles
    signed = rows.mapInArrow(sign, "doc_id long, digest binary, print binary, sketch binary, keys array<long>, n long, fp long").withColumn("row", F.monotonically_increasing_id()).checkpoint()
    nodes = signed.groupBy("print").agg(F.min("row").alias("node"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys"), F.first("n").alias("n"), F.first("fp").alias("fp")).checkpoint()
    keyed = nodes.select("node", "n", F.explode("keys").alias("key"))
    groups = keyed.groupBy("key").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("m")).where("m > 1").checkpoint()
    stars = keyed.join(groups, "key").where("node <> a").select("a", F.col("node").alias("b"))
    stars = _simhash_pairs(nodes.select("node", "fp")).union(stars).distinct().checkpoint()
    met = stars.select(F.col("a").alias("row")).union(stars.select(F.col("b").alias("row"))).distinct()
    named = signed.join(met, "row").select(F.col("row").alias("node"), F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
    texts = rows.join(named, rows["doc_id"].eqNullSafe(named["_id"]) & (rows["digest"] == named["_digest"])).select("node", "text")
    sets = texts.dropDuplicates(["node"]).mapInArrow(shingles, "node long, shingles array<long>").checkpoint()
    roots = connected_components(_verified(stars, sets, similarity))
    first = nodes.select("print", "node", "n").join(roots, "node", "left").select("print", "node", "n", F.coalesce("root", "node").alias("comp")).checkpoint()

    held = keyed.drop("n").join(groups.where("m > 2").select("key"), "key").join(first.select("node", "comp", "n"), "node").select("key", "node", "comp", "n").checkpoint()
    dealt = _dealt_cells(held, SMALL, SHINGLES)
    kept = nodes.select("node", "sketch").join(sets, "node")
    cells = dealt.join(kept, "node").select("key", "lo", "hi", "side", "comp", "sketch", "shingles")
    cells = cells.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    joins = connected_components(cells.mapInArrow(lambda batches: _cells(batches, similarity, bar), "a long, b long"))
    last = first.join(joins.withColumnRenamed("node", "_node"), F.col("comp") == F.col("_node"), "left").select("print", F.coalesce("root", "comp").alias("comp"))
    return signed.select("doc_id", "digest", "print").join(last, "print").select("doc_id", "digest", "comp")


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, recall: float = 0.998) -> DataFrame:
    """Columns doc_id and component_id of each row: the smallest doc_id that it reaches over links of ``similarity`` or more.

    ``recall`` is the expected share of pairs at exactly that similarity that have a MinHash key in common; more similar ones
    meet more surely, and equal sets of shingles always. At 0 there are SimHash links only. No pair of lower similarity is a link. Null and empty texts
    are alike; rows with a null doc_id take the component of their text, and name none unless no other id is there;
    repeated rows are returned each; other columns are not read; an empty table gives no rows.
    """
    found = _classes(docs, shingle, similarity, recall)
    return found.join(found.groupBy("comp").agg(F.min("doc_id").alias("component_id")), "comp").select("doc_id", "component_id")


def distinct_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, recall: float = 0.998) -> DataFrame:
    """The rows and columns of ``docs``, one row for each class of ``similar_documents``: the one with the smallest doc_id.

    A class without ids keeps the text with the least digest. Different texts under one doc_id are told apart, and of
    rows with the same doc_id and text the first by the other columns stays. Null and empty texts are one class; other
    columns may have any names; an empty table gives no rows.
    """
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")
    kept = _classes(docs, shingle, similarity, recall).groupBy("comp").agg(F.min(first).alias("k")).select(F.col("k.doc_id").alias("_id"), F.col("k.digest").alias("_digest"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rest = [F.col(f"row.`{f.name}`") for f in docs.schema.fields if f.name != "text" and not f.dataType.simpleString().startswith(("map", "variant"))]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest(F.coalesce("text", F.lit(""))).alias("digest"), whole.alias("row"))
    met = rows.join(kept, rows["doc_id"].eqNullSafe(kept["_id"]) & (rows["digest"] == kept["_digest"]), "left_semi")
    number = F.row_number().over(Window.partitionBy("doc_id", "digest").orderBy(*rest))
    return met.withColumn("number", number).where("number = 1").select("row.*")
