"""Order-preserving packing of documents into sequences, by dynamic programming over cut points.

The documents of a partition, in the order read, are one stream of tokens. A sequence is a window of the stream, and
a stream's best cuts have the least sum of padding and truncation penalties:

    f[j] = penalty[j] + min over i, with position[j] - position[i] <= capacity, of f[i] + capacity - (position[j] - position[i])

Since only f[i] + position[i] differs from one i to another, a monotone queue gives the minimum of the moving window,
so that each cut point is put in and taken out once.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.bpe import GPT, cut, quiet, token_bytes, vocabulary_path

LONG = 100_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def best_cuts(position: list[int], penalty: list[float], capacity: int) -> list[int]:
    """The chosen cuts, as indexes into ``position``; position[0] is the stream's start and the last its end.

    Positions rise, and lie at most ``capacity`` apart.
    """
    n = len(position)
    cost, back, queue = [0.0] * n, [0] * n, deque([0])
    for j in range(1, n):
        p = position[j]
        while position[queue[0]] < p - capacity:
            queue.popleft()
        i = back[j] = queue[0]
        c = cost[j] = cost[i] + capacity + penalty[j]  # cost[j] stands for f[j] + position[j]
        while queue and cost[queue[-1]] >= c:
            queue.pop()
        queue.append(j)
    cuts, j = [], n - 1
    while j:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


def cut_points(ids: np.ndarray, ends: np.ndarray, sentence_end: np.ndarray, sentence_penalty: float, token_penalty: float, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where the stream may be cut, its start and end included, with their penalties.

    They are the ends of documents (no penalty) and sentences; where those lie over a 16th of ``capacity`` apart (a
    gap), every quarter of a gap may be cut too, at ``token_penalty``.
    """
    gap = max(1, capacity // 16)
    step = max(1, gap // 4)
    penalty = np.full(len(ids) + 1, np.inf)
    penalty[1:][sentence_end[ids]] = sentence_penalty
    penalty[ends] = 0.0
    penalty[[0, len(ids)]] = 0.0
    at = np.flatnonzero(penalty < np.inf)
    wide = np.flatnonzero(np.diff(at) > gap)
    for a, b in zip(at[wide], at[wide + 1]):
        penalty[a + step : b : step] = token_penalty
    at = np.flatnonzero(penalty < np.inf)
    return at, penalty[at]


class Packer:
    """Packs one partition's documents as they come; holds a buffer of tokens and the sequence not yet closed."""

    def __init__(self, partition: int, capacity: int, sentence_end: np.ndarray, sentence_penalty: float, token_penalty: float):
        self.sequence, self.capacity = partition << 40, capacity
        self.options = sentence_end, sentence_penalty, token_penalty
        self.ids, self.docs, self.size = [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(ids)
        self.docs.append((doc_id, 0, len(ids)))
        self.size += len(ids)

    def close(self, last: bool) -> list[tuple]:
        """Pieces (doc_id, start, length, crc, doc_tokens, sequence_id, offset) of the sequences that are closed:
        all of them, or all but the buffer's last one, which goes on with the next documents."""
        if not self.size:
            return []
        ids = np.concatenate(self.ids)
        ends = np.cumsum([total - start for _, start, total in self.docs])
        at, penalty = cut_points(ids, ends, *self.options, self.capacity)
        cuts = at[best_cuts(at.tolist(), penalty.tolist(), self.capacity)]
        rest = np.zeros(0, ids.dtype), []
        if not last:
            cuts = cuts[:-1]
            done = int(cuts[-1]) if len(cuts) else 0
            open_doc = int(np.searchsorted(ends, done, "right"))
            doc_id, start, total = self.docs[open_doc]
            begun = done - int(ends[open_doc] - (total - start))
            rest = ids[done:], [(doc_id, start + begun, total), *self.docs[open_doc + 1 :]]
        out, data = [], memoryview(ids.tobytes())
        if len(cuts):
            marks = np.unique(np.concatenate([[0], cuts, ends[ends < cuts[-1]]]))
            doc, seq = np.searchsorted(ends, marks[:-1], "right").tolist(), np.searchsorted(cuts, marks[:-1], "right").tolist()
            first = np.concatenate([[0], cuts]).tolist()
            begins = np.concatenate([[0], ends]).tolist()
            for a, b, d, s in zip(marks[:-1].tolist(), marks[1:].tolist(), doc, seq):
                doc_id, start, total = self.docs[d]
                out.append((doc_id, start + a - begins[d], b - a, zlib.crc32(data[4 * a : 4 * b]), total, self.sequence + s, a - first[s]))
            self.sequence += len(cuts)
        self.ids, self.docs, self.size = [rest[0]] if len(rest[0]) else [], rest[1], len(rest[0])
        return out


def library_encoder(path: str):
    """Text -> ids as the ``tokenizers`` library gives them for its byte-level file ``path``, and the bytes of each token.

    Such a file's ids are its merges' ranks, by which tiktoken merges several times as fast to the same ids; the pattern
    is the one that byte-level files imply. Runs of over ``LONG`` characters without a place to cut, which tiktoken's pattern
    engine may refuse, are left to ``tokenizers`` with their text. Special strings become their ids, as is that library's default.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    plain, tokens = Tokenizer.from_file(path), token_bytes(path)
    added = {t.content: i for i, t in plain.get_added_tokens_decoder().items()}
    ranks = {t: i for i, t in enumerate(tokens) if i not in set(added.values())}
    fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def ids(text: str) -> list[int]:
        if len(text) > LONG and max(map(len, cut(text))) > LONG:
            return plain.encode(text, add_special_tokens=False).ids
        if any(s in text for s in added):
            return fast.encode(text, allowed_special="all")
        return fast.encode_ordinary(text)

    return ids, tokens


def pack(docs: DataFrame, capacity: int = 2048, vocabulary: str = GPT, end_id: int = 1, sentence_penalty: float = 8.0, token_penalty: float = 48.0, buffer_tokens: int = 1 << 19) -> DataFrame:
    """One row for each piece of a document in a sequence of at most ``capacity`` tokens.

    A document is its ids and then ``end_id``. Pieces say where they start in the document (start, length), the
    checksum of their ids, the document's tokens, the sequence and their place in it. Documents keep the order in
    which a partition of the table is read, so nothing is shuffled and a lost task is simply run again; sequences
    are numbered by partition and then in order. A partition leaves at most one sequence that could not be filled.

    Null texts count as empty: one token, the end id. Null doc_ids stay null; repeated rows are packed each; other
    columns are not read; an empty table gives no rows.
    """

    if capacity < 1:
        raise ValueError("a sequence holds one token at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quiet()
        encode, tokens = library_encoder(vocabulary_path(vocabulary))
        ends = np.array([t.rstrip(b" ")[-1:] in (b".", b"!", b"?", b"\n") for t in tokens])
        ends = np.concatenate([ends, np.zeros(max(0, end_id + 1 - len(ends)), bool)])
        packer = None
        for batch in batches:
            for doc_id, text, partition in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                packer = packer or Packer(partition, capacity, ends, sentence_penalty, token_penalty)
                packer.add(doc_id, np.array([*encode(text), end_id], dtype="<u4"))
                if packer.size >= buffer_tokens:
                    yield _batch(packer.close(False))
        if packer:
            yield _batch(packer.close(True))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.spark_partition_id().alias("part"))
    return rows.mapInArrow(run, SCHEMA)


def _batch(pieces: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*pieces)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[f.split()[0] for f in SCHEMA.split(", ")])
