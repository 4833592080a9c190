"""Encoding of whole texts with a public byte-level BPE tokenizer, by content-defined chunk reuse.

Texts are cut into chunks where a rolling hash of the last bytes says so, hence at the same places in texts that share a passage. Every distinct
chunk is encoded once, wherever it occurs. At the joins of a text's chunks the ids may differ from those of the whole text; they are repaired by
re-encoding between the nearest places where both agree for certain: the tokenizer's pattern always breaks between a character that is not white space
and one that is, whatever lies before or behind, so ids up to such a place in the left chunk and from such a place in the right one
are those of the whole text. If a chunk has no such place, it joins the text to be re-encoded and the next chunk is looked at.

Texts are read once. A chunk's bytes are sent once by each task, and its other uses as references beside them; sorted by chunk, they meet its ids, and go with them to their texts. A
task that meets a chunk very often sends further references to parts of its own, in which the chunk is encoded again: no part grows with the number of texts.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public vocabulary files, readable by every executor, unless the session names another in spark.strandweave.tokenizers.
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"
#: The pattern that splits text before the merges of the rank files (a fixed value of the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Bytes of the shortest chunk (but a text's last) and of the longest; a hash has MASK_BITS zero bits once in 2**MASK_BITS places.
SHORTEST, LONGEST, MASK_BITS = 1024, 16384, 11
#: References to a chunk that a task sends to the part it shares with other tasks, and those it sends to each further part of its own.
SHARED, OWN = 16, 4096
#: Chunks whose uses a task remembers at once; it bounds memory, and forgetting one only sends its bytes again.
REMEMBERED = 2**18


@lru_cache(maxsize=4)
def encoder(folder: str = TOKENIZERS, name: str = BYTE_BPE_50K):
    import tiktoken

    with open(os.path.join(folder, name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _width(enc) -> str:
    return "<u2" if enc.n_vocab <= 65_536 else "<u4"


@lru_cache(maxsize=1)
def _gear() -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.blake2b(bytes([i]), digest_size=4).digest() for i in range(256)), dtype="<u4").copy()


def cut_places(data: np.ndarray) -> np.ndarray:
    """Where the hash of the 32 bytes that end at a place has its upper bits zero: the sum of the bytes' random values, each shifted by its distance, so a byte leaves after 32 steps."""
    h = _gear()[data]
    for shift in (1, 2, 4, 8, 16):
        h[shift:] += h[:-shift] << np.uint32(shift)
    return np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1


def chunk_ends(data: bytes, places: np.ndarray | None = None) -> list[int]:
    """Ends of the chunks of a text in UTF-8; no chunk ends within a character."""
    n = len(data)
    if n <= SHORTEST:
        return [n] if n else []
    places = cut_places(np.frombuffer(data, dtype=np.uint8)) if places is None else places
    ends, start = [], 0
    while n - start > SHORTEST:
        k = np.searchsorted(places, start + SHORTEST)
        end = int(places[k]) if k < len(places) else n
        end = min(end, start + LONGEST, n)
        while end < n and data[end] & 0xC0 == 0x80:
            end += 1
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def _digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


class Uses:
    """The parts to which a task sends its references to chunks."""

    def __init__(self, task: int):
        self.task, self.count = task, {}

    def part(self, digest: bytes) -> tuple[int, bool]:
        """The part of the next reference to a chunk, and whether the chunk's bytes must go there too. Part 0 is that of all tasks."""
        if len(self.count) >= REMEMBERED:
            self.count.clear()
        n = self.count.get(digest, 0)
        self.count[digest] = n + 1
        if n < SHARED:
            return 0, n == 0
        own, at = divmod(n - SHARED, OWN)
        return (self.task + 1) * 2**32 + own, at == 0


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    """Arrays of ids as a column of lists."""
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _breaks_before(left: bytes, right: bytes) -> bool:
    """Whether the pattern surely breaks between these: white space after a character that is none."""
    if right[:1] not in (b" ", b"\n", b"\r", b"\t") or not left:
        return False
    tail = left[-4:]
    for k in range(len(tail)):
        if tail[k] & 0xC0 != 0x80:
            try:
                return not tail[k:].decode("utf-8")[-1].isspace()
            except UnicodeDecodeError:
                return False
    return False


class Stitcher:
    """Joins the ids of a text's chunks to those of the whole text."""

    def __init__(self, enc):
        self.enc, self.word = enc, [enc.decode_single_token_bytes(i) for i in range(enc.n_vocab)]
        self.done: list[int] = []  # ids that are final
        self.open: list[list[int]] = []  # ids from the last sure break on, of one chunk or more

    def _sure(self, ids: list[int], at: int) -> bool:
        left = self.word[ids[at - 1]]
        for back in range(2, 5):  # a character may be spread over up to four ids
            if len(left) >= 4 or at < back or left[-1] < 0x80:
                break
            left = self.word[ids[at - back]] + left
        return _breaks_before(left, self.word[ids[at]])

    def _encoded(self, parts: list[list[int]]) -> list[int]:
        return self.enc.encode_ordinary(b"".join(self.word[i] for ids in parts for i in ids).decode("utf-8"))

    def add(self, ids: list[int]) -> None:
        if self.open:
            first = next((i for i in range(1, len(ids)) if self._sure(ids, i)), None)
            if first is None:  # encoded when a sure break comes, so that a text without any is encoded once more and not for each chunk
                self.open.append(ids)
                return
            ids = self._encoded([*self.open, ids[:first]]) + ids[first:]
        last = next((i for i in range(len(ids) - 1, 0, -1) if self._sure(ids, i)), 0)
        self.done += ids[:last]
        self.open = [ids[last:]]

    def finish(self) -> list[int]:
        out = self.done + (self.open[0] if len(self.open) == 1 else self._encoded(self.open))
        self.done, self.open = [], []
        return out


def encode_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str | None = None, name: str = BYTE_BPE_50K) -> DataFrame:
    """(key, ids ARRAY<INT>): the ids of every text by the tokenizer, without special tokens, the text taken as it is. Empty and null texts have an empty list.

    Every row comes out once: keys may repeat or be null. Other columns are ignored. Chunks travel once for encoding and their ids once to each text. A task that is made again must see its
    rows in the same order, as it does from files; rows that come out of a shuffle should be written first.
    """
    kind = dict(docs.dtypes)[key]
    folder = folder or docs.sparkSession.conf.get("spark.strandweave.tokenizers", TOKENIZERS)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        uses = Uses(context.partitionId() if context else 0)
        for b in batches:
            rows: list[tuple] = []
            for row, t in enumerate(b.column("t")):
                data = t.as_buffer().to_pybytes() if t.is_valid else b""
                ends = chunk_ends(data) or [0]
                pieces = [data[a:z] for a, z in zip([0, *ends], ends)]
                digests = [_digest(c) for c in pieces]
                of = digests[0] if len(digests) == 1 else _digest(b"".join(digests))  # stands for the text: rows of one key are told apart by it
                for k, (c, h) in enumerate(zip(pieces, digests)):
                    part, first = uses.part(h)
                    rows.append((row, of, k, len(pieces), h, part, c if first else None))
            row, of, k, n, h, part, chunk = zip(*rows) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(row, pa.int64())), pa.array(of, pa.binary()), pa.array(k, pa.int32()), pa.array(n, pa.int32()), pa.array(h, pa.binary()), pa.array(part, pa.int64()), pa.array(chunk, pa.binary())],
                ["id", "of", "k", "n", "h", "part", "chunk"],
            )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, before, ids = encoder(folder, name), None, b""
        small = _width(enc)  # ids travel as bytes, two each for vocabularies up to 65,536
        for b in batches:
            out = []
            for h, part, c in zip(b.column("h").to_pylist(), b.column("part").to_pylist(), b.column("chunk").to_pylist()):
                if (h, part) != before:  # sorted, bytes first: each distinct chunk of a part is encoded once
                    before, ids = (h, part), np.array(enc.encode_ordinary(c.decode("utf-8")), dtype=small).tobytes()
                out.append(ids)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "of", "k", "n")), pa.array(out, pa.binary())], ["id", "of", "k", "n", "ids"])

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stitcher, small = Stitcher(encoder(folder, name)), _width(encoder(folder, name))
        now, last, copies, whole, kinds = None, -1, 0, None, None

        def text() -> tuple[list, list]:
            ids = np.array(stitcher.finish(), dtype=np.int32) if whole is None else whole
            return [now[0]] * copies, [ids] * copies

        for b in batches:
            kinds = b.schema.field("id").type
            keys, out = [], []
            for i, of, k, n, ids in zip(*(b.column(c).to_pylist() for c in ("id", "of", "k", "n", "ids"))):
                if now is None or (i, of) != now:
                    if now is not None:
                        done = text()
                        keys, out = keys + done[0], out + done[1]
                    now, last, copies, whole = (i, of), -1, 0, None
                copies += k == 0
                if k != last:  # equal rows have equal chunks: the text is joined once and given as often as it is there
                    last = k
                    if n == 1:
                        whole = np.frombuffer(ids, dtype=small)
                    else:
                        stitcher.add(np.frombuffer(ids, dtype=small).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(keys, kinds), _lists(out)], ["id", "ids"])
        if now is not None:
            keys, out = text()
            yield pa.RecordBatch.from_arrays([pa.array(keys, kinds), _lists(out)], ["id", "ids"])

    source = docs.select(F.col(key).alias("id"), F.col(text).alias("t"))
    sent = source.mapInArrow(chunks, f"id {kind}, of binary, k int, n int, h binary, part bigint, chunk binary")
    encoded = sent.repartition("h", "part").sortWithinPartitions("h", "part", F.col("chunk").isNull()).mapInArrow(encode, f"id {kind}, of binary, k int, n int, ids binary")
    return encoded.repartition("id", "of").sortWithinPartitions("id", "of", "k").mapInArrow(stitch, f"id {kind}, ids array<int>").withColumnRenamed("id", key)
