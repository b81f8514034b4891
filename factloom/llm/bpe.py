"""Byte-level BPE over Arrow batches: encoding with offsets, decoding, and token counts.

Texts are cut at single spaces between two other characters before anything else is done. The pre-tokenizer's
pattern always begins a new piece there, so that each chunk has the same ids wherever it stands, and a worker keeps
those of the chunks it has met in a bounded table. Other runs of white space stay inside their chunk.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Chunks that a worker remembers; then it starts anew. About 200 bytes each.
CACHE = 400_000
MULTI, GPT = "byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json"


def vocabulary_path(name_or_path: str) -> str:
    """A file's place: a path as it stands, a bare name in the installed public tokenizers."""
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves; the others, in order, for the characters from U+0100.
    """
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(others)) for b in range(256)]


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


def tokenizer_from_ranks(path: str, pattern: str):
    """A tokenizer of the ``tokenizers`` library with the vocabulary, ranks and pattern of a tiktoken file.

    A merge of two tokens has the rank of the token that it makes. As in rank files, every pair whose join is in
    the vocabulary may merge, and a piece that is itself in the vocabulary is one token.
    """
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, char = load_ranks(path), byte_characters()
    text = {token: "".join(map(char.__getitem__, token)) for token in ranks}
    merges = [(text[token[:i]], text[token[i:]]) for token in sorted(ranks, key=ranks.__getitem__) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
    out = Tokenizer(models.BPE(vocab={text[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    out.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return out


def token_characters(path: str) -> list[str]:
    """The byte characters of each id, special tokens by those of their own bytes; of a tiktoken or a ``tokenizers`` file."""
    char = byte_characters()
    spell = lambda data: "".join(map(char.__getitem__, data))
    if path.endswith(".tiktoken"):
        named = {rank: spell(token) for token, rank in load_ranks(path).items()}
    else:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        named = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: spell(t["content"].encode()) for t in spec["added_tokens"]}
    return [named.get(i, "") for i in range(max(named, default=-1) + 1)]


def byte_reader() -> Callable[[str], bytes]:
    """Byte characters -> bytes, by the table of byte characters reversed."""
    table = np.zeros(512, dtype="u1")
    for b, c in enumerate(byte_characters()):
        table[ord(c)] = b
    return lambda text: table[np.frombuffer(text.encode("utf-16-le"), dtype="<u2")].tobytes()


def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id."""
    return list(map(byte_reader(), token_characters(path)))


#: A space beside other white space or at an end, and one that has neither: where texts are cut.
ODD, BETWEEN = re.compile(r" \s|\s |^ | $"), re.compile(r"(?<=\S) (?=\S)")


def cut(text: str) -> list[str]:
    """The text's chunks: what lies between single spaces that stand between two other characters."""
    return BETWEEN.split(text) if ODD.search(text) else text.split(" ")


class Chunked:
    """Values of whole texts joined from those of their chunks.

    ``many`` maps a list of strings to their values; it is told how many of them, from the first, begin with a space
    that no other white space follows. A chunk but a text's first one stands for itself with a space before it.
    """

    def __init__(self, many: Callable[[list[str], int], list], bound: int = CACHE):
        self.many, self.bound, self.known, self.first = many, bound, {}, {}

    def values(self, texts: list[str]) -> list[list]:
        """For each text, the values of its chunks in order."""
        known, first, new, heads = self.known, self.first, set(), {}
        for table in (known, first):
            if len(table) > self.bound:
                table.clear()
        chunked = list(map(cut, texts))
        for chunks in chunked:
            if chunks[0] not in first:
                heads[chunks[0]] = None
            new |= set(chunks[1:]).difference(known)
        if new or heads:
            names = sorted(new)
            values = self.many([*[" " + x for x in names], *heads], len(names))
            known.update(zip(names, values))
            first.update(zip(heads, values[len(names) :]))
        out = [[first[chunks[0]], *map(known.__getitem__, chunks[1:])] for chunks in chunked]
        for x in [*new, *heads]:  # long ones aren't met again, and would fill the memory
            if len(x) > 100:
                known.pop(x, None)
                first.pop(x, None)
        return out


def slices(texts: list[str], chars: int = 1_000_000) -> Iterator[list[str]]:
    """The texts in lists of about so many characters."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def encoder(tokenizer, lengths: np.ndarray, bound: int = CACHE // 2) -> Chunked:
    """Ids as little-endian unsigned 32-bit bytes, by the ``tokenizers`` library; ``lengths`` has the bytes of each token.

    Chunks that begin with a space are encoded many at once, as one text, and its ids are dealt out by their bytes.
    """

    def ids(texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def many(parts: list[str], spaced: int = 0) -> list[bytes]:
        out = []
        for chunks in slices(parts[:spaced], 1 << 16):
            found = ids(["".join(chunks)])[0]
            ends = np.searchsorted(np.cumsum(lengths[found]), np.cumsum([len(c.encode()) for c in chunks])) + 1
            data, ends = found.tobytes(), (4 * ends).tolist()
            out += [data[a:b] for a, b in zip([0, *ends], ends)]
        return out + [x.tobytes() for x in ids(parts[spaced:])] if len(parts) > spaced else out

    return Chunked(many, bound)


def quiet() -> None:
    """One thread for each worker: Spark deals out the cores."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def encode(docs: DataFrame, vocabulary: str = MULTI, pattern: str | None = None, offsets: bool = True) -> DataFrame:
    """Columns doc_id, ids and, if asked for, starts: each token's first character in the text, as an offset.

    ``vocabulary`` is a tiktoken rank file (path or name); ``pattern`` splits texts before merging. A token that
    holds part of a character starts at that character. Null texts count as empty, with no ids; rows with a null
    doc_id and repeated rows are encoded each; other columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quiet()
        import public_tokenizers

        path = vocabulary_path(vocabulary)
        lengths = np.array(list(map(len, token_characters(path))), dtype="i8")
        ids_of = encoder(tokenizer_from_ranks(path, pattern or public_tokenizers.PATTERN), lengths)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            at = 0
            for part in slices(texts):
                flat = [np.frombuffer(b"".join(v), dtype="<u4").astype("i4") for v in ids_of.values(part)]
                bounds = np.cumsum([0, *map(len, flat)], dtype="i4")
                columns = [keys.slice(at, len(part)), pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([*flat, np.zeros(0, "i4")])))]
                if offsets:
                    starts = [_starts(text, lengths[ids]) for text, ids in zip(part, flat)]
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([*starts, np.zeros(0, "i4")]).astype("i4"))))
                at += len(part)
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "starts"][: len(columns)])

    schema = "doc_id long, ids array<int>" + ", starts array<int>" * offsets
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def _starts(text: str, lengths: np.ndarray) -> np.ndarray:
    """Character offsets of tokens of so many bytes: characters begun before each token's first byte, its own included."""
    data = np.frombuffer(text.encode(), dtype="u1")
    begun = np.cumsum((data & 0xC0) != 0x80) - 1
    return begun[np.cumsum(lengths) - lengths].astype("i4") if len(lengths) else np.zeros(0, "i4")


def decode(encoded: DataFrame, vocabulary: str = MULTI, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep`` and bytes, from ids: their byte characters, read back through the reversed byte table.

    A text's characters are joined before they become bytes, and its bytes before they are read as text, so that
    characters split between tokens come out whole; ``to_text`` gives the string. Null ids give no bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, read = token_characters(vocabulary_path(vocabulary)), byte_reader()
        for batch in batches:
            lists = batch.column(0)
            flat, bounds = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            out = [read("".join(map(table.__getitem__, flat[a:b].tolist()))) for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out, pa.binary())], names=[*keep, "bytes"])

    rows = encoded.select(F.coalesce("ids", F.array().cast("array<int>")).alias("_token_ids"), *keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"{fields}, bytes binary")


def to_text(column) -> F.Column:
    """Decoded bytes as text; bytes that are no UTF-8 become replacement characters."""
    return F.decode(column, "UTF-8")


class Merges:
    """Merge rules of a ``tokenizers`` file, as integers: (left id, right id) -> rank and new id in one number."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.symbol = [vocab[c] for c in byte_characters()]
        self.pairs = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs[vocab[left] << 20 | vocab[right]] = rank << 20 | vocab[left + right]

    def count(self, word: bytes) -> int:
        """Tokens of a piece: its bytes less the merges, each of the lowest-ranked adjacent pair, leftmost first.

        A heap holds (rank, place) of the pairs; a linked list of the symbols finds a pair's neighbours. An entry
        whose pair has gone since is skipped when it comes up.
        """
        n = len(word)
        if n < 2:
            return n
        get, push, pop = self.pairs.get, heapq.heappush, heapq.heappop
        symbol = [self.symbol[b] for b in word]
        heap = [(rule >> 20) << 32 | i for i in range(n - 1) if (rule := get(symbol[i] << 20 | symbol[i + 1])) is not None]
        if not heap:
            return n
        heapq.heapify(heap)
        after, before, left = [*range(1, n), -1], [*range(-1, n - 1)], n
        while heap:
            entry = pop(heap)
            i = entry & 0xFFFFFFFF
            j = after[i]
            if j < 0 or symbol[i] < 0 or (rule := get(symbol[i] << 20 | symbol[j])) is None or rule >> 20 != entry >> 32:
                continue
            symbol[i], symbol[j] = rule & 0xFFFFF, -1
            k = after[i] = after[j]
            left -= 1
            if k >= 0:
                before[k] = i
                if (rule := get(symbol[i] << 20 | symbol[k])) is not None:
                    push(heap, (rule >> 20) << 32 | i)
            h = before[i]
            if h >= 0 and (rule := get(symbol[h] << 20 | symbol[i])) is not None:
                push(heap, (rule >> 20) << 32 | h)
        return left


def counter(vocabulary: str, pattern: str, bound: int = CACHE) -> Callable[[list[str]], list[int]]:
    """Token counts of whole texts by heap-and-linked-list merging; special strings count as one token each."""
    import regex

    merges, find, known = Merges(vocabulary_path(vocabulary)), regex.compile(pattern).findall, {}
    special = regex.compile("|".join(map(regex.escape, merges.specials))) if merges.specials else None

    def pieces(text: str) -> int:
        total = 0
        for word in find(text):
            if (n := known.get(word)) is None:
                if len(known) > bound:
                    known.clear()
                n = merges.count(word.encode())
                if len(word) <= 64:
                    known[word] = n
            total += n
        return total

    def one(text: str) -> int:
        if special is None or not special.search(text):
            return pieces(text)
        return sum(map(pieces, special.split(text))) + len(special.findall(text))

    chunks = Chunked(lambda parts, _: list(map(one, parts)), bound)
    return lambda texts: [sum(v) for part in slices(texts) for v in chunks.values(part)]


def count_tokens(docs: DataFrame, vocabulary: str = GPT, limit: int = 512, pattern: str | None = None) -> DataFrame:
    """Columns doc_id, n_bytes (UTF-8), n_tokens and over_limit, without making ids.

    Counts are those of the ``tokenizers`` library for its file ``vocabulary``, special strings inside texts as by
    its default. Null texts count as empty, with 0 tokens; rows with a null doc_id and repeated rows are counted
    each; other columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        count = counter(vocabulary, pattern or public_tokenizers.PATTERN)
        for batch in batches:
            n = pa.array(count(batch.column(1).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), n, pc.greater(n, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
