r"""Cross-tokenizer alignment: which tokens of a byte-level vocabulary (A) and of a piece vocabulary (B) cover the same bytes.

The ids of a batch's documents are laid end to end, so a token's end is one running sum of byte lengths for all of them. Both sides' ends are counted
once (bincount); a cut is where both occur, and every document's end is one. A token's group is the number of cuts before its end, so
groups, links and all per-document figures are differences of prefix sums. In a group all A tokens are linked with all B tokens.

How many documents hold an id pair linked is a matter of the whole corpus. A packet, the slice of a batch aligned at once, is stored
with its distinct pairs; these are summed by pair, each pair's sum goes back to the packets that hold it, and a packet's documents look their own
links up among the packet's pairs. What is shuffled is distinct pairs of packets, not links. Links of large groups are made from the distinct
ids of both sides and their counts, in blocks, never from all occurrences.

Texts are cut before white space that follows other characters, where no token of either side reaches over, and the ids of what lies between are kept
in a cache of bounded size. Both vocabularies are read by their libraries; special tokens' strings are plain text.

Defined cases: a text that is null or empty, or which the tokens don't spell (B writes the mark U+2581 as a space) has no tokens, and zeros; a null or repeated
doc_id is kept, each row being a document of its own in the counts; other columns are ignored; an empty table gives an empty result. A
single text must fit a task's memory with its ids.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import arrow_batches, shared_dir, stored
from rankweave.llm.packing import ChunkEncoder, byte_alphabet
from rankweave.llm.sentencepiece_bpe import MARK, PrefixTableBpe

# The characters with the property White_Space.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
MAX_CACHED = 100_000
MAX_CACHED_CHARS = 64
#: Rows of an Arrow batch; a batch of more text than this is aligned in several packets.
BATCH_ROWS, PACKET_CHARS = 400, 1_500_000
#: Groups with more links than this are made from distinct ids, in blocks of so many pairs.
MANY_LINKS, BLOCK = 256, 1 << 20


class PlainEncoder(ChunkEncoder):
    """A's ids, in which the strings of special tokens are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True


class Vocabularies:
    """Both sides' ids of texts, and what their ids stand for. A unit's ids are kept, 4 bytes each, until `MAX_CACHED` units are."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = PlainEncoder(path_a), PrefixTableBpe(path_b)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        if not self.b.dummy_prefix:
            raise ValueError("B must add a space before a text")
        alphabet = byte_alphabet()
        vocab = self.a.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(map(alphabet.__getitem__, token)) if all(c in alphabet for c in token) else token.encode("utf-8")
        self.bytes_b = self.b.table
        self.size_a, self.size_b = len(self.bytes_a), len(self.bytes_b)
        self.length_a, self.length_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        # an id in decimal with the sign that follows it: A's ids at 2 * id + sign (`,` or `|`), then B's at 3 * id + sign (`,`, `;` or none)
        signed = [f"{i}{x}" for i in range(self.size_a) for x in (",", "|")] + [f"{i}{x}" for i in range(self.size_b) for x in (",", ";", "")]
        self.signed_length = np.array([len(x) for x in signed], np.int64)
        wide = int(self.signed_length.max())
        self.signed = np.array([x.encode() for x in signed], f"S{wide}").view(np.uint8).reshape(-1, wide)
        # A's tokens never reach from other characters into white space; B's do where a piece has such a pair of characters
        white = set(map(chr, WHITE))
        inside = {y for p in self.b.ids for x, y in zip(p, p[1:], strict=False) if x != MARK and x not in white}
        self.after_mark = {p[i + 1] for p in self.b.ids for i in range(len(p) - 1) if p[i] == MARK}
        joined = {c for c in white if (MARK if c == " " else c) in inside}
        every, other = ("".join(map(re.escape, sorted(x))) for x in (white, joined))
        self.unit = re.compile(f"[{every}]*[^{every}]+" + (f"(?:[{other}][{every}]*[^{every}]*)*" if joined else "") + f"|[{every}]+")
        self.known: dict[str, tuple[bytes, bytes]] = {}

    def _ids(self, units: list[str]) -> list[tuple[bytes, bytes]]:
        """Of units without the mark: B's library puts a space before what it gets, which is the unit's own or is taken off again."""
        b = self.pieces.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        out = []
        for u, ids in zip(units, b, strict=True):
            if u[0] != " ":
                ids = ids[1:] if u[0] not in self.after_mark else self.b._encode_part(u.replace(" ", MARK))
            elif len(u) == 1:
                ids = self.b._encode_part(MARK)
            out.append((self.a.ids(u), struct.pack(f"<{len(ids)}I", *ids)))
        return out

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """Of each text the ids of space+text by A and of text by B."""
        cut = [self.unit.findall(" " + t) if t and MARK not in t else [] for t in texts]
        if len(self.known) >= MAX_CACHED:
            self.known.clear()
        known = self.known
        new = list(dict.fromkeys([u for units in cut for u in units if u not in known]))
        known.update(zip(new, self._ids(new), strict=True))
        out = []
        for units in cut:
            found = list(map(known.__getitem__, units))
            ids = b"".join([x for x, _ in found]), b"".join([y for _, y in found])
            out.append((b"", b"") if self.unknown and self.unknown in ids[1] and self.b.unk in np.frombuffer(ids[1], "<u4") else ids)
        for u in new:
            if len(u) > MAX_CACHED_CHARS:
                del known[u]
        return out

    @property
    def unknown(self) -> bytes:
        """B's unknown id, where it has one that a text can get: its surface isn't the text's."""
        return struct.pack("<I", self.b.unk) if not self.b.byte_ids and self.b.unk >= 0 else b""


class Aligned:
    """Groups and links of documents whose ids lie end to end. n_a, n_b: how many ids each document has."""

    def __init__(self, v: Vocabularies, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray):
        self.v, self.a, self.b, self.n_a, self.n_b = v, a, b, n_a, n_b
        ends_a, ends_b = np.cumsum(v.length_a[a]), np.cumsum(v.length_b[b])
        size = int(ends_a[-1]) + 1 if len(a) else 1
        cut = (np.bincount(ends_a, minlength=size) > 0) & (np.bincount(ends_b, minlength=size) > 0)
        cut[0] = False
        self.cuts = np.flatnonzero(cut)
        before = np.cumsum(cut)
        self.group_a, self.group_b = before[ends_a - 1], before[ends_b - 1]
        n = len(self.cuts)
        self.in_a, self.in_b = np.bincount(self.group_a, minlength=n), np.bincount(self.group_b, minlength=n)
        self.links = self.in_a * self.in_b
        # the documents' borders among ids, bytes and groups; prefix sums of links
        self.at_a, self.at_b = (np.concatenate([[0], np.cumsum(x)]) for x in (n_a, n_b))
        self.at_byte = np.concatenate([[0], ends_a])[self.at_a]
        self.at_group = before[self.at_byte]
        total = np.concatenate([[0], np.cumsum(self.links)])
        self.n_groups, self.n_links = np.diff(self.at_group), np.diff(total[self.at_group])

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, pair, links): a pair is A's id times B's size plus B's id; by document, then pair."""
        width = self.v.size_a * self.v.size_b
        doc_of_group = np.repeat(np.arange(len(self.n_a)), self.n_groups)
        start_a, start_b = np.cumsum(self.in_a) - self.in_a, np.cumsum(self.in_b) - self.in_b
        large = self.links > MANY_LINKS
        times = np.where(large, 0, self.in_b)[self.group_a]
        left = np.repeat(np.arange(len(self.a)), times)
        right = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times) + start_b[self.group_a[left]]
        ids_a, ids_b = self.a.astype(np.int64), self.b.astype(np.int64)
        key, n = np.unique(doc_of_group[self.group_a[left]] * width + ids_a[left] * self.v.size_b + ids_b[right], return_counts=True)
        keys, counts = [key], [n]
        for g in np.flatnonzero(large).tolist():
            x, cx = np.unique(ids_a[start_a[g] : start_a[g] + self.in_a[g]], return_counts=True)
            y, cy = np.unique(ids_b[start_b[g] : start_b[g] + self.in_b[g]], return_counts=True)
            step = max(1, BLOCK // len(y))
            for i in range(0, len(x), step):
                keys.append((doc_of_group[g] * width + x[i : i + step, None] * self.v.size_b + y).ravel())
                counts.append((cx[i : i + step, None] * cy).ravel())
        if len(keys) > 1:
            key, back = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.zeros(len(key), np.int64)
            np.add.at(n, back, np.concatenate(counts))
        return key // width, key % width, n

    def written(self) -> tuple[bytes, np.ndarray]:
        """The documents' groups as text, `a1,a2|b1;a3|b2,b3`, end to end; and the documents' borders in it."""
        sign_a, sign_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        sign_a[np.cumsum(self.in_a) - 1] = 1
        sign_b[np.cumsum(self.in_b) - 1] = 1
        sign_b[self.at_b[1:][self.n_b > 0] - 1] = 2
        code = np.empty(len(self.a) + len(self.b), np.int64)
        # a group's A ids, then its B ids: before an A id lie the B ids of earlier groups, before a B id the A ids of groups up to its own
        code[np.arange(len(self.a)) + (np.cumsum(self.in_b) - self.in_b)[self.group_a]] = 2 * self.a + sign_a
        code[np.arange(len(self.b)) + np.cumsum(self.in_a)[self.group_b]] = 2 * self.v.size_a + 3 * self.b + sign_b
        sizes = self.v.signed_length[code]
        letters = self.v.signed[code][np.arange(self.v.signed.shape[1]) < sizes[:, None]]
        return letters.tobytes(), np.concatenate([[0], np.cumsum(sizes)])[self.at_a + self.at_b]


_LOADED: dict[tuple[str, str], Vocabularies] = {}


def loaded(path_a: str, path_b: str) -> Vocabularies:
    """One pair of vocabularies a Python worker, with what it has cached."""
    if (path_a, path_b) not in _LOADED:
        _LOADED[path_a, path_b] = Vocabularies(path_a, path_b)
    return _LOADED[path_a, path_b]


def align_texts(v: Vocabularies, texts: list[str | None]) -> Aligned:
    made = v.encode(texts)
    a, b = (np.frombuffer(b"".join([m[i] for m in made]), "<u4").astype(np.int64) for i in (0, 1))
    n_a, n_b = (np.array([len(m[i]) // 4 for m in made], np.int64) for i in (0, 1))
    return Aligned(v, a, b, n_a, n_b)


def _slices(texts: list[str | None]) -> Iterator[slice]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= PACKET_CHARS:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def packets(docs: DataFrame, path_a: str, path_b: str, digests: bool = False) -> DataFrame:
    """A row for each slice of documents aligned at once, written to the shared folder: figures of its documents, which pairs they link how often, and its distinct pairs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = loaded(path_a, path_b)
        packet = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in _slices(batch["_t"].tolist()):
                ids, texts = batch["_id"].iloc[part].tolist(), batch["_t"].iloc[part].tolist()
                x = align_texts(v, texts)
                doc, pair, n = x.pairs()
                own, holders = np.unique(pair, return_counts=True)
                row = {"packet": packet, "doc_id": ids, "n_a": x.n_a, "n_b": x.n_b, "n_groups": x.n_groups, "n_links": x.n_links}
                if digests:
                    written, at = x.written()
                    row["groups_sha256"] = [hashlib.sha256(written[i:j]).hexdigest() if j > i else "" for i, j in zip(at, at[1:], strict=False)]
                else:
                    cut = np.searchsorted(x.cuts, x.at_byte, side="right")
                    row["a_ids"] = [x.a[i:j].tolist() for i, j in zip(x.at_a, x.at_a[1:], strict=False)]
                    row["b_ids"] = [x.b[i:j].tolist() for i, j in zip(x.at_b, x.at_b[1:], strict=False)]
                    row["cuts"] = [(x.cuts[i:j] - at).tolist() for i, j, at in zip(cut, cut[1:], x.at_byte, strict=False)]
                row |= {"starts": np.searchsorted(doc, np.arange(len(ids) + 1)), "place": np.searchsorted(own, pair).astype("<u4").tobytes(), "links": n.astype("<u4" if n.max(initial=0) < 2**32 else "<u8").tobytes(), "pair": own, "docs": holders}
                yield pd.DataFrame({k: [x] for k, x in row.items()})
                packet += 1

    more = "groups_sha256 array<string>" if digests else "a_ids array<array<int>>, b_ids array<array<int>>, cuts array<array<long>>"
    schema = f"packet long, doc_id array<string>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, {more}, starts array<long>, place binary, links binary, pair array<long>, docs array<long>"
    rows = docs.select(F.col("doc_id").cast("string").alias("_id"), F.col("text").cast("string").alias("_t"))
    with arrow_batches(docs.sparkSession, BATCH_ROWS):
        return stored(rows.mapInPandas(run, schema), shared_dir(docs.sparkSession, "alignment"))


def pair_counts(made: DataFrame, size_b: int) -> DataFrame:
    """(pair, a_id, b_id, n_docs, best): in how many documents of packets() a pair is linked; best if no other pair of its A id has more."""
    each = made.select(F.explode(F.arrays_zip("pair", "docs")).alias("x")).select("x.*")
    sums = each.groupBy("pair").agg(F.sum("docs").alias("n_docs")).withColumn("a_id", F.expr(f"pair div {size_b}"))
    # an A id has at most B's size of pairs
    most = sums.groupBy("a_id").agg(F.max("n_docs").alias("_most"))
    return sums.join(most, "a_id").select("pair", "a_id", F.expr(f"pair % {size_b}").alias("b_id"), "n_docs", (F.col("n_docs") == F.col("_most")).alias("best"))


def align_documents(docs: DataFrame, path_a: str, path_b: str, digests: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum) of each row, and a_ids, b_ids and cuts (byte offsets where both sides end) or, in their place, groups_sha256.

    Eager: the packets are written when it is called.
    """
    made = packets(docs, path_a, path_b, digests)
    pairs = stored(pair_counts(made, loaded(path_a, path_b).size_b).select("pair", "n_docs", "best"), shared_dir(docs.sparkSession, "pairs"))
    found = made.select(F.col("packet").alias("of"), F.posexplode("pair").alias("at", "pair")).join(pairs, "pair").select("of", "at", "n_docs", "best")
    whole = ["groups_sha256"] if digests else ["a_ids", "b_ids", "cuts"]

    def look_up(packet: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        row = packet.iloc[0]
        n_docs, best = np.zeros(len(known) + 1, np.int64), np.zeros(len(known) + 1, np.int64)
        n_docs[known["at"]], best[known["at"]] = known["n_docs"], known["best"]
        place = np.frombuffer(row["place"], "<u4")
        links = np.frombuffer(row["links"], "<u4" if len(row["links"]) == 4 * len(place) else "<u8").astype(np.int64)
        sums = [np.diff(np.concatenate([[0], np.cumsum(links * x[place])])[row["starts"]]) for x in (n_docs, best)]
        out = {k: list(row[k]) for k in ("doc_id", "n_a", "n_b", "n_groups", "n_links")} | {"n_best": sums[1], "count_sum": sums[0]} | {k: list(row[k]) for k in whole}
        return pd.DataFrame(out)

    more = "groups_sha256 string" if digests else "a_ids array<int>, b_ids array<int>, cuts array<long>"
    bare = made.drop("pair", "docs")
    out = bare.groupBy("packet").cogroup(found.groupBy("of")).applyInPandas(look_up, f"doc_id string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, {more}")
    return out.withColumn("doc_id", F.col("doc_id").cast(dict(docs.dtypes)["doc_id"]))
