"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint of 64 bits is cut into 4 blocks of 16. Two fingerprints that differ in at most 2 bits agree in at least
2 blocks, so they share one of the 6 keys made of two blocks; rows meet by key and are then verified. Keys that more
than ``SMALL`` fingerprints share are cut further: of the 8 nibbles outside the key's blocks, at least 6 agree, which
gives 28 keys of 56 bits. Such a key leaves 8 bits open, and so has at most 256 different fingerprints: no group is
ever compared whole beyond that, and none is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.components import connected_components
from factloom.session import ensure_checkpoint_dir

SMALL = 256
SEED = 42


def majority(hashes: np.ndarray) -> int:
    """Fingerprint of hashes, a signed long: a bit is 1 if it is set in over half of them."""
    ones = np.zeros(64, dtype="i8")
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14)]
        ones += np.unpackbits(part.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i4")
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def _fingerprint(data: bytes, shingle: int, digest) -> int:
    words = data.lower().split()  # bytes: A-Z only, and white space is 0x20 and 0x09 to 0x0D
    if not words:
        return 0
    if len(words) < shingle:
        hashes = np.array([digest(b" ".join(words))], dtype="<u8")
    else:
        hashes = np.fromiter(map(digest, map(b" ".join, zip(*[words[i:] for i in range(shingle)]))), dtype="<u8")
    return majority(hashes)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """Columns doc_id and fp, a signed long. A bit is 1 if it is set in over half of the shingles' XXH64 (seed 42),
    repeats included. Texts of fewer words are one shingle; without a word, or null, the fingerprint is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = partial(xxhash.xxh64_intdigest, seed=SEED)
        for batch in batches:
            out = [_fingerprint(x, shingle, digest) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _block(fp: Column, start: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def block_keys(fp: Column) -> Column:
    """The 6 keys: number of the pair of blocks, then the two blocks."""
    return F.array(*[F.lit(n << 32).cast("long").bitwiseOR(F.shiftleft(_block(fp, 16 * i, 16), 16)).bitwiseOR(_block(fp, 16 * j, 16)) for n, (i, j) in enumerate(combinations(range(4), 2))])


def finer_keys(fps: np.ndarray, key: int) -> np.ndarray:
    """The 28 keys of each fingerprint within ``key``: key, number, and 6 of the nibbles outside the key's blocks."""
    used = list(combinations(range(4), 2))[key >> 32]
    rest = [np.uint64(16 * b + 4 * k) for b in range(4) if b not in used for k in range(4)]
    out = np.empty((len(fps), 28), dtype="<u8")
    for m, chosen in enumerate(combinations(rest, 6)):
        bits = np.full(len(fps), (key << 29 | m << 24) & (1 << 64) - 1, dtype="<u8")
        for k, start in enumerate(chosen):
            bits |= (fps.view("<u8") >> start & np.uint64(15)) << np.uint64(4 * k)
        out[:, m] = bits
    return out.view("<i8")


def _forest(members: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges that join what is linked among at most a few hundred fingerprints: each to the least of its component."""
    bits = members.view("<u8")  # of signed numbers, the bits of the absolute value would be counted
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= distance
    label = np.arange(len(members))
    while True:
        low = np.where(near, label[None, :], len(members)).min(axis=1)
        if (low == label).all():
            return [(int(members[i]), int(members[j])) for i, j in enumerate(label) if i != j]
        label = low


def _links(batches: Iterator[pa.RecordBatch], distance: int, small: int) -> Iterator[pa.RecordBatch]:
    """From rows (key, fp) in order of key: links (a, b); for the members of larger groups, rows (fp, null, finer key)."""
    held_key, held, large = None, [], False

    def batch(edges: list[tuple[int, int]], later: list[tuple[np.ndarray, int]]) -> pa.RecordBatch:
        ends = np.array(edges, dtype="<i8").reshape(-1, 2)
        fps = [np.repeat(f, 28) for f, _ in later]
        keys = [finer_keys(f, k).ravel() for f, k in later]
        n = sum(map(len, fps))
        a, b = np.concatenate([ends[:, 0], *fps]), np.concatenate([ends[:, 1], np.zeros(n, "<i8")])
        key, is_link = np.concatenate([np.zeros(len(ends), "<i8"), *keys]), np.arange(len(a)) < len(ends)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=~is_link), pa.array(key, mask=is_link)], names=["a", "b", "key"])

    for rows in batches:
        edges, later = [], []
        keys, fps = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
        ends = np.append(starts[1:], len(keys))
        for n, (s, e) in enumerate(zip(starts.tolist(), ends.tolist())):
            if 0 < n < len(starts) - 1 and e - s == 1:
                continue  # alone with its key
            if (key := int(keys[s])) != held_key:
                if len(held) > 1:
                    edges += _forest(np.array(held), distance)
                held_key, held, large = key, [], False
            if large:
                later.append((fps[s:e], key))
            elif len(held) + e - s > small:
                later.append((np.array([*held, *fps[s:e].tolist()], dtype="<i8"), key))
                held, large = [], True
            else:
                held += fps[s:e].tolist()
        yield batch(edges, later)
    if len(held) > 1:
        yield batch(_forest(np.array(held), distance), [])


def near_links(nodes: DataFrame, distance: int = 2, small: int = SMALL) -> DataFrame:
    """Links (a, b) that connect what lies within ``distance`` (2 at most) among different fingerprints ``fp``."""
    if not 0 <= distance <= 2:
        raise ValueError("the blocks serve distances up to 2")
    schema = "a long, b long, key long"
    ensure_checkpoint_dir(nodes.sparkSession)
    keyed = nodes.select(F.explode(block_keys(F.col("fp"))).alias("key"), "fp").repartition("key").sortWithinPartitions("key", "fp")
    found = keyed.mapInArrow(lambda batches: _links(batches, distance, small), schema).checkpoint()
    later = found.where("b is null").select("key", F.col("a").alias("fp")).repartition("key").sortWithinPartitions("key", "fp")
    finer = later.mapInArrow(lambda batches: _links(batches, distance, 256), schema)
    return found.where("b is not null").select("a", "b").union(finer.select("a", "b"))


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """Columns doc_id, fp and component_id, the smallest doc_id that a document reaches over links.

    Equal fingerprints are one node, so that copies of any number cost one row each and no pair. Null and empty
    texts have fingerprint 0 and are linked like any other. Null doc_ids take the component of their text, and
    never name one unless no other id is there. Repeated rows are returned each; other columns are not read; an
    empty table gives no rows.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    prints = fingerprints(docs, shingle).checkpoint()
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(near_links(nodes.select("fp"), distance))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    label = named.join(least, "root").select("fp", "component_id")
    return prints.join(label, "fp").select("doc_id", "fp", "component_id")
