"""Packing: token pieces into near-equal windows by Karmarkar-Karp multiway differencing.

A document's ids are cut into whole windows and one rest; rests are cut once more where they are over `max_piece`, so
that a window gets several. Rests gather in batches that nearly fill `windows` windows. Differencing starts with one partial
partition a piece (its size in one window, nothing in the others) and merges the two partial partitions with the
largest imbalances, the fullest window of one onto the emptiest of the other, until one partition is left. If a
window of it is over capacity, the window count rises by one and the differencing starts again. A task's last,
partly filled batch is cut to lengths that are powers of two, which need no padding.

Each task packs its own rows, as they stream by: no shuffle, memory bounded by a batch. Sequence ids are the partition's
number times 2**40 plus a count, so a task that runs again gives the same ids.

Defined cases: a null or empty text is the end id alone; a null or repeated doc_id is kept, rows being packed one by
one; other columns are ignored; an empty table gives an empty result. A string that spells an added token
of the vocabulary has that token's id, as the library has it by default.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary's own splitting always cuts: a run of other characters with one space before it, or white space.
CHUNK = regex.compile(r" ?[^\p{White_Space}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
TWO_SPACES = re.compile(r"\s\s")
# Fixed value: the public splitting pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Below this character all libraries agree on which are letters and digits; chunks beyond it go to the slower one.
SETTLED = "\u0250"
MAX_CACHED = 400_000
MAX_CACHED_CHARS = 64


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Known(dict):
    """Ids (little-endian, 4 bytes each) of words with `before` in front of them; emptied when `MAX_CACHED` are kept."""

    def __init__(self, of: ChunkEncoder, before: str):
        super().__init__()
        self.of, self.before = of, before

    def __missing__(self, word: str) -> bytes:
        found = self.of.ids(self.before + word)
        if len(word) <= MAX_CACHED_CHARS:
            if len(self) >= MAX_CACHED:
                self.clear()
            self[word] = found
        return found


class ChunkEncoder:
    """Ids of whole texts as bytes, 4 each, little-endian. Words that come again are looked up."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # the same vocabulary as ranks, for a faster library: ids of byte-level BPE are in the order of merges
        alphabet = byte_alphabet()
        ranks = {bytes(map(alphabet.__getitem__, t)): i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if all(c in alphabet for c in t) and t != "<|endoftext|>"}
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bare, self.spaced = _Known(self, ""), _Known(self, " ")
        self.newline = self.ids("\n")

    def ids(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        ids = self.fast.encode_ordinary(chunk) if chunk.isascii() or max(chunk) < SETTLED else self.tokenizer.encode(chunk, add_special_tokens=False).ids
        return self._packed(ids)

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        if any(t in text for t in self.added):
            return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if TWO_SPACES.search(text):
            # runs of white space: their last space may belong to the word that follows, as CHUNK has it
            return b"".join(self.spaced[c[1:]] if c[0] == " " else self.bare[c] for c in CHUNK.findall(text))
        out: list[bytes] = []
        spaced = self.spaced.__getitem__
        for line in text.split("\n"):
            first, *words = line.split(" ")
            out.append(self.bare[first])
            out.extend(map(spaced, words))
            out.append(self.newline)
        out.pop()
        return b"".join(out)


def differencing(sizes: list[int], m: int) -> list[list[int]]:
    """Indices of sizes for each of m windows, sums near-equal."""
    # a partial partition: (-imbalance, tie, [(sum, indices)] by falling sum); windows with nothing are left out
    heap = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tie = len(heap)
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        a = a + [(0, [])] * (m - len(a))
        b = b + [(0, [])] * (m - len(b))
        merged = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b), strict=True)]
        merged.sort(key=lambda w: -w[0])
        low = merged[-1][0]
        while merged and not merged[-1][1]:
            merged.pop()
        heapq.heappush(heap, (-(merged[0][0] - low), tie, merged))
        tie += 1
    return [indices for _, indices in heap[0][2]] if heap else []


def windows_of(sizes: list[int], capacity: int) -> list[list[int]]:
    """The fewest windows that hold what differencing makes near-equal."""
    m = max(1, -(-sum(sizes) // capacity))
    while True:
        found = differencing(sizes, m)
        if all(sum(sizes[i] for i in w) <= capacity for w in found):
            return found
        m += 1


class Packer:
    """Takes documents' ids one after the other and yields (sequence, piece, offset); a piece is (row, start, ids)."""

    def __init__(self, capacity: int, windows: int = 32, max_piece: int = 256, slack: int = 4):
        self.capacity, self.max_piece = capacity, max(1, min(max_piece, capacity))
        # a batch stops `slack` tokens a window short of full: differencing has that much room before the count rises
        self.batch_tokens = windows * max(1, capacity - slack)
        self.rests: list[tuple] = []
        self.total = self.sequence = 0

    def add(self, row, ids: bytes) -> Iterator[tuple]:
        at, n = 0, len(ids) // 4
        while n - at >= self.capacity:
            yield self._next(), (row, at, self.capacity, ids[4 * at : 4 * (at + self.capacity)]), 0
            at += self.capacity
        while at < n:
            end = min(n, at + self.max_piece, at + self.batch_tokens - self.total)
            self.rests.append((row, at, end - at, ids[4 * at : 4 * end]))
            self.total += end - at
            at = end
            if self.total == self.batch_tokens:
                yield from self._flush()

    def _next(self) -> int:
        self.sequence += 1
        return self.sequence - 1

    def _emit(self, pieces: Iterable[tuple]) -> Iterator[tuple]:
        sequence, offset = self._next(), 0
        for piece in pieces:
            yield sequence, piece, offset
            offset += piece[2]

    def _flush(self) -> Iterator[tuple]:
        rests, self.rests, self.total = self.rests, [], 0
        for window in windows_of([p[2] for p in rests], self.capacity):
            yield from self._emit(rests[i] for i in window)

    def finish(self) -> Iterator[tuple]:
        """The last batch: what whole windows leave over is cut off its end to powers of two."""
        left = self.total % self.capacity if self.total else 0
        if self.total >= self.capacity:
            left = min(self.total, left + self.capacity)  # one window more, for room
        tail: list[tuple] = []
        while left:
            size = min(1 << (left.bit_length() - 1), self.capacity)
            part: list[tuple] = []
            need = size
            while need:
                row, start, n, ids = self.rests.pop()
                if n > need:
                    self.rests.append((row, start, n - need, ids[: 4 * (n - need)]))
                    start, n, ids = start + n - need, need, ids[4 * (n - need) :]
                part.append((row, start, n, ids))
                need -= n
            tail += self._emit(part)
            left -= size
            self.total -= size
        if self.rests:
            yield from self._flush()
        yield from tail


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 0, windows: int = 32, max_piece: int = 256, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for)."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, packer = ChunkEncoder(tokenizer_path), Packer(capacity, windows, max_piece)
        base = TaskContext.get().partitionId() << 40
        end = struct.pack("<I", end_id)
        out: list[tuple] = []

        def take(found: Iterable[tuple]) -> None:
            for sequence, ((doc_id, n), start, length, ids), offset in found:
                out.append((doc_id, start, length, zlib.crc32(ids), n, base + sequence, offset, *([list(struct.unpack(f"<{length}I", ids))] if with_ids else [])))

        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
        for b in batches:
            for doc_id, text in zip(b["_id"].tolist(), b["_t"].tolist(), strict=True):
                ids = encoder.encode(text) + end
                take(packer.add((None if doc_id is None or doc_id != doc_id else doc_id, len(ids) // 4), ids))
            if out:
                yield _frame(out, names)
                out = []
        take(packer.finish())
        if out:
            yield _frame(out, names)

    kind = dict(docs.dtypes)["doc_id"]
    # ids of type long that may be null travel as text: pandas would make floats of them
    rows = docs.select(F.col("doc_id").cast("string").alias("_id"), F.coalesce(F.col("text"), F.lit("")).alias("_t"))
    schema = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if with_ids else "")
    return rows.mapInPandas(pack, schema).withColumn("doc_id", F.col("doc_id").cast(kind))


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    out["doc_id"] = out["doc_id"].astype(object)
    return out
