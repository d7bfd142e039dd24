"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's bytes are a linked list of parts. Each adjacent pair whose joined bytes are in the vocabulary
waits in the bucket of its merge rank, as the position of its first part. A bitmap in levels marks the
buckets that aren't empty, so the next rank is found by a find-first-set on each level. An entry whose pair
has changed since is stale and skipped. A merge costs at most two pushes, so a pre-token of n bytes takes about n
steps whatever its length, where a scan for the smallest rank would take n for each merge. Short pre-tokens lie
side by side in one array and share a queue, so a bucket holds the positions of many.

Encoding has no shuffle: a partition's texts go through Arrow, and words seen before are looked up. The rank
file is read by the driver, its size is checked, and it travels with the tasks.
"""

from __future__ import annotations

import base64
import itertools
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Most bytes of a rank file; it is sent to every task.
RANK_BYTES = 16 << 20
#: Bytes of pre-tokens merged at a time; one of more bytes has its lists in compact arrays.
LONG = 1 << 18
#: Characters of texts that are cut into words at a time.
STEP = 1 << 20
#: Words remembered by a task before the older ones go.
WORDS = 1 << 18
#: White space as the split pattern's \s has it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    """Token bytes and their ranks of a rank file: a base64 token and a number on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}


def read_rank_file(path: str) -> bytes:
    with open(path, "rb") as f:
        raw = f.read(RANK_BYTES + 1)
    if len(raw) > RANK_BYTES:
        raise ValueError(f"a rank file of more than {RANK_BYTES} bytes")
    return raw


class RankQueue:
    """Positions waiting in a bucket for each merge rank, the smallest rank found first.

    ``low`` holds a bit for each rank in words of 256 bits and ``top`` a bit for each word that isn't zero, so
    the next rank is a find-first-set on two levels. A bucket is put in order when it is taken.
    """

    def __init__(self, ranks: int):
        self.low, self.top = [0] * ((ranks >> 8) + 1), 0
        self.buckets: list[list[int] | np.ndarray | None] = [None] * (ranks + 1)

    def __bool__(self) -> bool:
        return self.top != 0

    def put(self, rank: int, positions: list[int] | np.ndarray) -> None:
        """Positions of a rank whose bucket is empty."""
        self.buckets[rank] = positions
        self.low[rank >> 8] |= _BIT[rank & 255]
        self.top |= 1 << (rank >> 8)

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets[rank]
        if bucket is None:
            self.put(rank, [position])
        elif type(bucket) is list:
            bucket.append(position)
        else:
            self.buckets[rank] = [*bucket.tolist(), position]

    def take(self) -> tuple[int, list[int]]:
        """The smallest rank and its positions, ascending; its bucket is empty then."""
        word = (self.top & -self.top).bit_length() - 1
        bits = self.low[word]
        rank = (word << 8) + (bits & -bits).bit_length() - 1
        bucket, self.buckets[rank] = self.buckets[rank], None
        self.low[word] = bits = bits & (bits - 1)
        if not bits:
            self.top &= self.top - 1
        if type(bucket) is not list:
            return rank, bucket.tolist()
        bucket.sort()
        return rank, bucket


class ByteBPE:
    """Encoder and decoder of one vocabulary. ``pattern`` splits a text into pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.table = {rank: token for token, rank in ranks.items()}
        self.queue = RankQueue(max(ranks.values(), default=0))
        pairs = np.full(1 << 16, -1, np.int32)
        for token, rank in ranks.items():
            if len(token) == 2:
                pairs[token[0] << 8 | token[1]] = rank
        self._pairs = pairs
        self._bytes = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        self._new: dict[str, tuple[int, ...]] = {}
        self._old: dict[str, tuple[int, ...]] = {}

    def merge(self, tokens: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of pre-tokens that aren't tokens as a whole.

        They lie in one array and share one queue. In each pre-token the adjacent pair of the smallest rank is
        merged first, the leftmost of equal ones. While a bucket is worked through, its rank gets no new
        positions, as a merged part never is the same bytes again; should a merge make a pair of a smaller
        rank, the rest of the bucket waits for that.
        """
        data = b"".join(tokens)
        ends = np.cumsum([len(t) for t in tokens])
        edge = bytearray(len(data) + 1)
        for at in (0, *ends.tolist()):
            edge[at] = 1
        get, queue = self.ranks.get, self.queue
        buckets, push = queue.buckets, queue.push
        part, after, before, pair = self._start(data, ends)
        while queue:
            rank, bucket = queue.take()
            for at, i in enumerate(bucket):
                if pair[i] != rank:
                    continue  # stale
                j = after[i]
                k = after[j]
                after[i], part[i], pair[j] = k, rank, -1
                lower = False
                if edge[k]:
                    pair[i] = -1
                else:
                    before[k] = i
                    pair[i] = q = get(data[i : after[k]], -1)
                    if q >= 0:
                        if type(b := buckets[q]) is list:
                            b.append(i)
                        else:
                            push(q, i)
                        lower = q < rank
                if not edge[i]:
                    p = before[i]
                    pair[p] = q = get(data[p:k], -1)
                    if q >= 0:
                        if type(b := buckets[q]) is list:
                            b.append(p)
                        else:
                            push(q, p)
                        lower |= q < rank
                if lower and at + 1 < len(bucket):
                    queue.put(rank, bucket[at + 1 :])
                    break
        out, i = [], 0
        for end in ends.tolist():
            ids = []
            while i < end:
                ids.append(part[i])
                i = after[i]
            out.append(tuple(ids))
        return out

    def _start(self, data: bytes, ends: np.ndarray):
        """Each byte as a part of its own, and the queue filled a rank at a time."""
        raw = np.frombuffer(data, np.uint8)
        pair = np.full(len(raw), -1, np.int32)
        pair[:-1] = self._pairs[raw[:-1].astype(np.int32) << 8 | raw[1:]]
        pair[ends - 1] = -1
        order = np.argsort(pair, kind="stable").astype(np.int32)
        order = order[np.searchsorted(pair[order], 0) :]
        kinds, start = np.unique(pair[order], return_index=True)
        for rank, positions in zip(kinds.tolist(), np.split(order, start[1:]), strict=False):
            self.queue.put(rank, positions)
        n = np.arange(-1, len(raw) + 1, dtype=np.int32)
        columns = (self._bytes[raw], n[2:], n[:-2], pair)
        return (c.tolist() for c in columns) if len(raw) <= LONG else (array("i", c.tobytes()) for c in columns)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts. A pre-token never holds white space behind other characters, so texts are cut into
        words with the space before them, and words are remembered whole."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        size = 0
        for at, text in enumerate(texts):
            for piece in pieces(text):
                held.append((at, _WORD(piece)))
                size += len(piece)
                if size >= STEP:
                    self._flush(held, out)
                    held, size = [], 0
        self._flush(held, out)
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]

    def _flush(self, held: list[tuple[int, list[str]]], out: list[list[np.ndarray]]) -> None:
        self._learn(set(itertools.chain.from_iterable(words for _, words in held)))
        ids_of = self._new.__getitem__
        for at, words in held:
            out[at].append(np.fromiter(itertools.chain.from_iterable(map(ids_of, words)), np.int32))

    def _learn(self, words: set[str]) -> None:
        """See to it that ``_new`` has the words; what it held before and isn't used again goes in time."""
        if len(self._new) >= WORDS:
            self._new, self._old = {}, self._new
        new = self._new
        fresh = self._recall([w for w in words if w not in new])
        # A word of letters is one pre-token.
        whole = {w for w in fresh if w.isalpha() or (w[0] == " " and w[1:].isalpha())}
        mixed = [(w, self.split(w)) for w in fresh if w not in whole]
        whole.update(self._recall([t for t in set(itertools.chain.from_iterable(x for _, x in mixed)) if t not in new]))
        todo = list(whole)
        new.update(zip(todo, self._encode(todo), strict=True))
        new.update((w, tuple(itertools.chain.from_iterable(map(new.__getitem__, tokens)))) for w, tokens in mixed if len(tokens) > 1)

    def _recall(self, words: list[str]) -> list[str]:
        """Take over what the older memory has; the words that it hasn't."""
        old = self._old
        if not old:
            return words
        self._new.update((w, old[w]) for w in words if w in old)
        return [w for w in words if w not in old]

    def _encode(self, tokens: list[str]) -> list[tuple[int, ...]]:
        raw = [t.encode() for t in tokens]
        out: list[tuple[int, ...] | None] = [None if (r := self.ranks.get(t)) is None else (r,) for t in raw]
        todo, size, at = [], 0, []
        for i, t in enumerate(raw):
            if out[i] is None:
                todo.append(t)
                at.append(i)
                size += len(t)
            if todo and (size >= LONG or i + 1 == len(raw)):
                for j, ids in zip(at, self.merge(todo), strict=True):
                    out[j] = ids
                todo, size, at = [], 0, []
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))


_BIT = [1 << i for i in range(256)]
_WORD = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall
_CUT = re.compile(f"[^{SPACE}](?=[{SPACE}])")


def pieces(text: str) -> Iterator[str]:
    """A text in parts of about ``STEP`` characters that end before white space, where pre-tokens end too."""
    at = 0
    while len(text) - at > 2 * STEP:
        cut = _CUT.search(text, at + STEP)
        if cut is None:
            break
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:]


def encode_texts(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` (array of int) for every row: the ids of its whole text, without special tokens.

    Each match of ``pattern`` is encoded on its own, by the ranks of ``rank_file``; a match that is a token as a
    whole is that token. Null and empty texts have no ids. Bytes that aren't UTF-8 count as the replacement
    character. Every row is kept, those without or with a repeated id too; columns other than the two don't matter.
    The vocabulary must hold all single bytes. What a task holds grows with its longest text.
    """
    raw = read_rank_file(rank_file)

    def encode(batches):
        bpe = ByteBPE(parse_ranks(raw), pattern)
        for b in slices(batches, 64):
            texts = b.column(1).cast(pa.binary()).to_pylist()
            ids = bpe.encode([(t or b"").decode(errors="replace") for t in texts])
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(encode, f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode_ids(tokens: DataFrame, rank_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, ids, decoded`` (binary) for every row: the bytes of its ids joined. A null list is empty; an id
    that the vocabulary doesn't have, or a null one, is an error."""
    raw = read_rank_file(rank_file)

    def decode(batches):
        bpe = ByteBPE(parse_ranks(raw), "")
        for b in slices(batches, 64):
            if b.column(1).flatten().null_count:
                raise ValueError("an id is null")
            out = [bpe.decode(ids.values.to_numpy().tolist() if ids.is_valid else []) for ids in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"])

    return tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(decode, f"doc_id {tokens.schema[id_col].dataType.simpleString()}, ids array<int>, decoded binary")


def ids_digest(ids: Column) -> Column:
    """Lower-case hex SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)


def op11_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    tokens = encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), ranks, public_tokenizers.PATTERN)
    back = decode_ids(tokens, ranks)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_digest(F.col("ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
