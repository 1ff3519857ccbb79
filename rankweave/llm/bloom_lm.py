r"""LM scoring: a log-frequency Bloom filter of quantised n-gram counts, broadcast, and probabilities from repeated probes.

Counting covers all training texts. Words are counted exactly, in a stored table (word, c). Bigrams are counted by 64-bit hashes: each task
sends sorted, packed runs of (hash, count, class) per bucket, buckets merge them. A count c becomes its level 1 + floor(log_b c), and an n-gram
is put in the filter once for each level up to its own; reading probes level after level until one is missing, so a count is never read
too small, and read too large by a level with the filter's small error rate, its square by two, and so on.

The filter's size follows the number of entries up to `max_filter_bytes` (128 MB, for about 100 million entries), the bound of the broadcast. Beyond it the filter has the frequent
n-grams (the least count in it is the smallest for which all with that count fit, found from a histogram over all documents), and the others
stay in stored buckets of key ranges: texts are looked up in packets, the distinct keys of a packet that the filter lacks meet their
bucket in a join, and only levels come back. So every counted n-gram is known at any size; a stored one is read at its own level, by the
upper 48 bits of its key (among a billion stored ones, one unseen key in 2^18 meets another's). The
`head_words` most frequent words (bounded) are broadcast with their exact counts.

P(w | v) = max(c(vw) - D, 0) / c(v) + backoff(v) * (c(w) + 1) / (N + V + 1), where backoff(v) is one number for all v of a class (the
level of c(v); the rest in one class), the share of the class's tokens that its discounted bigrams leave over. A text is a sequence from
one end to the next.

`base_score` is exact: words outside the head are joined with the counts, in a table of their own rows, not through the filter.

Defined cases: a null or empty text is one end; a null doc_id has the fold of the empty text; a repeated row is scored, and counted, again;
without training texts N = V = 0 and every probability is 1; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import HashedWords, bytes_words, crc_fold, shared_dir, stored, text_or_empty

END = ""  # the end token: no word is empty
FLUSH_WORDS = 200_000
FLUSH_TOKENS = 500_000
LOOK_TOKENS = 50_000
BATCH_CHARS = 400_000
UNIGRAM = np.uint64(0x5851F42D4C957F2D)
GROUP_KEYS = 1_000_000
LOW = np.uint64(0xFFFFFFFF)
SPARE = np.uint64(16)  # lower bits of keys that look-ups leave out
CLASSES = 64
SEGMENTS = 64


#: The end token's hash: no word's hash polynomial gives it by more than chance.
END_HASH = np.uint64(0x0123456789ABCDEF)


def hash_words(words: list[str]) -> np.ndarray:
    """Of a list of tokens; no word holds a separator, so one text of them all can be hashed."""
    out = np.full(len(words), END_HASH, np.uint64)
    out[[i for i, w in enumerate(words) if w]] = HashedWords("\n".join(words)).hashes
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9FB21C651E98DF25)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def bigram_keys(h: np.ndarray) -> np.ndarray:
    """Keys of (h[i], h[i + 1])."""
    return _mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + _mix(h[1:]))


def level_of(c: np.ndarray, base: float) -> np.ndarray:
    return (1 + np.floor(np.log(np.maximum(c, 1)) / np.log(base) + 1e-9)).astype(np.int64)


def coarse(c: np.ndarray, base: float) -> np.ndarray:
    """Counts above 1000 become the least count of their level, so that a histogram of counts is short."""
    return np.where(c <= 1000, c, np.maximum(np.ceil(base ** (level_of(c, base) - 1) - 1e-9), 1001)).astype(np.int64)


def count_of_level(base: float, top: int = 128) -> np.ndarray:
    """The middle of the counts that have a level; 0 for level 0."""
    out = np.zeros(top + 1)
    for q in range(1, top + 1):
        low, high = np.ceil(base ** (q - 1) - 1e-9), np.ceil(base**q - 1e-9)
        out[q] = (low + max(high - 1, low)) / 2
    return out


class LogBloom:
    """Bits in segments (of a multiple of 8 bits, under 2**32); a key's range is its segment, so segments are built apart from each other."""

    def __init__(self, bits_per_segment: int, hashes: int, base: float, segments: int = SEGMENTS):
        self.size, self.k, self.base, self.segments = bits_per_segment, hashes, base, segments
        self.bits = np.zeros((segments, bits_per_segment // 8), np.uint8)
        self.counts = count_of_level(base)

    def places(self, keys: np.ndarray, level: int) -> Iterator[np.ndarray]:
        a = _mix(keys + np.uint64((level * 0xA0761D6478BD642F) & 0xFFFFFFFFFFFFFFFF))
        step = (a >> np.uint64(32)) | np.uint64(1)
        for _ in range(self.k):
            yield (((a & LOW) * np.uint64(self.size)) >> np.uint64(32)).astype(np.int64)
            a = a + step * np.uint64(0x9E3779B97F4A7C15)

    def segment(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(58)).astype(np.int64)

    def put(self, segment: int, keys: np.ndarray, levels: np.ndarray) -> None:
        row = self.bits[segment]
        for q in range(1, int(levels.max(initial=0)) + 1):
            for at in self.places(keys[levels >= q], q):
                np.bitwise_or.at(row, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Probes level after level, of the keys that had the one before."""
        out = np.zeros(len(keys), np.int64)
        live, segment, flat = np.arange(len(keys)), self.segment(keys), self.bits.ravel()
        for q in range(1, len(self.counts)):
            a = _mix(keys[live] + np.uint64((q * 0xA0761D6478BD642F) & 0xFFFFFFFFFFFFFFFF))
            step = ((a >> np.uint64(32)) | np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            for _ in range(self.k):  # most that are absent fail the first probes
                at = (((a & LOW) * np.uint64(self.size)) >> np.uint64(32)).astype(np.int64)
                fits = (flat[segment[live] * (self.size // 8) + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1 == 1
                live, a, step = live[fits], a[fits] + step[fits], step[fits]
            if not len(live):
                break
            out[live] = q
        return out


class HeadTable:
    """Exact counts of the head's words by hash: open addressing, looked up for many at once."""

    def __init__(self, words: list[str], counts: list[int]):
        self.size = 1 << max(4, (4 * len(words)).bit_length())
        self.keys, self.counts = np.zeros(self.size, np.uint64), np.zeros(self.size, np.int64)
        h, c = hash_words(words), np.array(counts, np.int64)
        at = (h & np.uint64(self.size - 1)).astype(np.int64)
        while len(h):  # of those that want the same free place one gets it, the others go one further
            first = np.zeros(len(h), bool)
            first[np.unique(at, return_index=True)[1]] = True
            first &= self.counts[at] == 0
            self.keys[at[first]], self.counts[at[first]] = h[first], c[first]
            h, c, at = h[~first], c[~first], (at[~first] + 1) & (self.size - 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The counts, 0 for words that aren't in the head."""
        out = np.zeros(len(h), np.int64)
        at, live = (h & np.uint64(self.size - 1)).astype(np.int64), np.arange(len(h))
        while len(live):
            c = self.counts[at]
            same = (self.keys[at] == h[live]) & (c > 0)
            out[live[same]] = c[same]
            go = (c > 0) & ~same
            live, at = live[go], (at[go] + 1) & (self.size - 1)
        return out


@dataclass
class LanguageModel:
    head: HeadTable
    total: int
    distinct: int
    discount: float
    backoff: np.ndarray  # by class
    filter: LogBloom | None
    least_count: int = 1
    rest: str | None = None  # the folder of the stored pairs, if any n-gram isn't in the filter
    buckets: int = SEGMENTS
    head_count: int = 1  # words from this count on are in the head, but for very long ones

    @staticmethod
    def word_class(c: np.ndarray) -> np.ndarray:
        """Of contexts: the level of their exact counts; words outside the head (0) share class 0."""
        return np.where(c > 0, np.minimum(CLASSES - 1, level_of(c, 2.0)), 0)


def tokens(text: str | None) -> list[str]:
    return [*(w.decode("utf-8", "surrogatepass") for w in bytes_words(text)), END]


def _word_counts(texts: DataFrame) -> DataFrame:
    def part(counts: Counter) -> pd.DataFrame:
        return pd.DataFrame({"w": [w.decode("utf-8", "surrogatepass") for w in counts], "n": list(counts.values())})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for x in batches:
            for t in x["_t"]:
                counts.update(bytes_words(t))
                counts[b""] += 1
                if len(counts) >= FLUSH_WORDS:
                    yield part(counts)
                    counts.clear()
        if counts:
            yield part(counts)

    return texts.select("_t").mapInPandas(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("c"))


def _pack_keys(keys: np.ndarray) -> bytes:
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack_keys(k: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(k, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _pack(keys: np.ndarray, counts: np.ndarray, kinds: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Sorted keys as differences, byte by byte of all: leading zeros stand together and compress."""
    wide = 8 if counts.max(initial=0) >> 32 else 4
    return _pack_keys(keys), counts.astype(f"<u{wide}").view(np.uint8).reshape(-1, wide).T.tobytes(), kinds.astype(np.uint8).tobytes()


def _unpack(k: bytes, c: bytes, kinds: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    wide = 8 * len(c) // max(1, len(k)) or 4
    counts = np.ascontiguousarray(np.frombuffer(c, np.uint8).reshape(wide, -1).T).view(f"<u{wide}").ravel()
    return _unpack_keys(k), counts.astype(np.int64), np.frombuffer(kinds, np.uint8)


def _summed(keys: np.ndarray, counts: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    by = np.argsort(keys, kind="stable")
    keys, counts, kinds = keys[by], counts[by], kinds[by]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts, kinds[first]


PACKED = "bucket long, k binary, c binary, kinds binary"
REST = "bucket long, k binary, level binary"


def _by_bucket(keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted keys; buckets are equal ranges of keys."""
    if not len(keys):
        return []
    at = np.floor(keys.astype(np.float64) / 2.0**64 * buckets).astype(np.int64).clip(0, buckets - 1)
    cuts = np.flatnonzero(np.diff(at)) + 1
    return [(int(at[i]), int(i), int(j)) for i, j in zip([0, *cuts], [*cuts, len(keys)], strict=True)]


def _bigram_counts(texts: DataFrame, shared_head, buckets: int) -> DataFrame:
    """Merged runs, one row a bucket; a bucket is a range of hashes that holds about GROUP_KEYS distinct ones at most."""

    def split(keys: np.ndarray, counts: np.ndarray, kinds: np.ndarray) -> pd.DataFrame:
        rows = [(b, *_pack(keys[i:j], counts[i:j], kinds[i:j])) for b, i, j in _by_bucket(keys, buckets)]
        return pd.DataFrame(rows, columns=["bucket", "k", "c", "kinds"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head = shared_head.value
        keys, kinds, contexts, open_tokens, n = [], [], [], 0, 0

        def classes() -> None:
            nonlocal contexts, open_tokens
            if contexts:
                kinds.append(LanguageModel.word_class(head.find(np.concatenate(contexts))).astype(np.uint8))
                contexts, open_tokens = [], 0

        def flush() -> pd.DataFrame:
            nonlocal keys, kinds, n
            classes()
            out = split(*_summed(np.concatenate(keys), np.ones(n, np.int64), np.concatenate(kinds)))
            keys, kinds, n = [], [], 0
            return out

        for b in batches:
            for t in b["_t"]:
                h = np.concatenate([[END_HASH], HashedWords(t).hashes, [END_HASH]])
                keys.append(bigram_keys(h))
                contexts.append(h[:-1])
                n += len(h) - 1
                open_tokens += len(h) - 1
                if open_tokens >= LOOK_TOKENS:
                    classes()
                if n >= FLUSH_TOKENS:
                    yield flush()
        if n:
            yield flush()

    def merge(key, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpack(*r) for r in zip(pdf["k"], pdf["c"], pdf["kinds"], strict=True)]
        merged = _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        return pd.DataFrame([(int(key[0]), *_pack(*merged))], columns=["bucket", "k", "c", "kinds"])

    return texts.select("_t").mapInPandas(count, PACKED).groupBy("bucket").applyInPandas(lambda k, p: merge(k, p), PACKED)


def train(docs: DataFrame, held_out: int = 2, folds: int = 7, head_words: int = 200_000, base: float = 1.5, bits_per_entry: int = 10, hashes: int = 5, max_filter_bytes: int = 1 << 27, discount: float = 0.75) -> tuple[LanguageModel, DataFrame]:
    """The model, and the table (w, c) of exact counts; documents of the held-out fold are not counted."""
    spark = docs.sparkSession
    root = shared_dir(spark, "lm")
    texts = docs.where(crc_fold(F.col("doc_id"), folds) != held_out).select(text_or_empty().alias("_t"))
    words = stored(_word_counts(texts), f"{root}/words")
    histogram = {r["c"]: r["n"] for r in words.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}  # distinct counts: about the square root of N
    total, distinct = sum(c * n for c, n in histogram.items()), sum(histogram.values())
    from_count, room = max(histogram, default=0) + 1, head_words
    for c in sorted(histogram, reverse=True):
        if histogram[c] > room:
            break
        from_count, room = c, room - histogram[c]
    rows = words.where((F.col("c") >= from_count) & (F.length("w") <= 64)).collect()
    head = HeadTable([r["w"] for r in rows], [r["c"] for r in rows])
    model = LanguageModel(head, total, distinct, discount, np.ones(CLASSES), None)
    if not total:
        return model, words
    shared_head = spark.sparkContext.broadcast(head)
    buckets = SEGMENTS * max(1, -(-total // (GROUP_KEYS * SEGMENTS)))  # so each lies within a segment
    pairs = stored(_bigram_counts(texts, shared_head, buckets), f"{root}/bigrams")

    # the filter's entries by count, and the tokens of each class
    def levels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in zip(b["k"], b["c"], b["kinds"], strict=True):
                _, c, kind = _unpack(*r)
                x = pd.DataFrame({"c": coarse(c, base), "kind": kind, "n": 1, "tokens": c, "entries": level_of(c, base)})
                yield x.groupby(["c", "kind"], as_index=False).sum()

    stats = pairs.select("k", "c", "kinds").mapInPandas(levels, "c long, kind int, n long, tokens long, entries long").groupBy("c", "kind").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"), F.sum("entries").alias("entries")).collect()
    tail = {c: n for c, n in histogram.items() if c < from_count}
    entries: Counter = Counter()
    for r in stats:
        entries[r["c"]] += r["entries"]
    for c, n in tail.items():
        entries[int(coarse(np.array([c]), base)[0])] += n * int(level_of(np.array([c]), base)[0])
    room, least = max_filter_bytes * 8 // bits_per_entry, max(entries, default=0) + 1
    for c in sorted(entries, reverse=True):
        room -= entries[c]
        if room < 0:
            break
        least = c
    kept = sum(n for c, n in entries.items() if c >= least)
    seen, saved = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in stats:
        seen[r["kind"]] += r["tokens"]
        saved[r["kind"]] += r["tokens"] - discount * r["n"]
    backoff = np.where(seen > 0, 1 - saved / np.maximum(seen, 1), 1.0).clip(1e-3, 1.0)
    per_segment = 8 * max(128, -(-kept * bits_per_entry // (8 * SEGMENTS)))
    bloom = LogBloom(per_segment, hashes, base)

    def filled(segment: int, keys: np.ndarray, levels: np.ndarray) -> tuple[int, bytes]:
        own = LogBloom(per_segment, hashes, base)
        own.put(segment, keys, levels)
        return segment, own.bits[segment].tobytes()

    def of_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for bucket, *r in zip(b["bucket"], b["k"], b["c"], strict=True):
                k, c, _ = _unpack(*r, b"")
                on = c >= least
                yield pd.DataFrame([filled(bucket * SEGMENTS // buckets, k[on], level_of(c[on], base))], columns=["segment", "bits"])

    def kept_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            h = _mix(hash_words(b["w"].tolist()) ^ UNIGRAM)
            yield pd.DataFrame({"segment": (h >> np.uint64(58)).astype(np.int32), "key": h.view(np.int64), "level": level_of(b["c"].to_numpy(), base).astype(np.int16)})

    def of_words(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([filled(int(key[0]), pdf["key"].to_numpy(np.int64).view(np.uint64), pdf["level"].to_numpy())], columns=["segment", "bits"])

    def together(key, pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in pdf["bits"]])
        return pd.DataFrame([(int(key[0]), bits.tobytes())], columns=["segment", "bits"])

    # what is kept fits in the filter, so a segment has a bounded share of it; a bucket's pairs are in one segment
    tail = words.where(((F.col("c") < from_count) | (F.length("w") > 64)) & (F.col("c") >= least)).mapInPandas(kept_words, "segment int, key long, level smallint")
    rows = tail.groupBy("segment").applyInPandas(lambda k, p: of_words(k, p), "segment int, bits binary")
    rows = rows.union(pairs.select("bucket", "k", "c").mapInPandas(of_pairs, "segment int, bits binary"))
    for r in rows.groupBy("segment").applyInPandas(lambda k, p: together(k, p), "segment int, bits binary").toLocalIterator():
        bloom.bits[r["segment"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    rest = f"{root}/bigrams" if min(entries) < least else None
    # the shuffles of the counts aren't read again: Spark deletes them when their frames are collected
    spark.sparkContext._jvm.System.gc()
    return LanguageModel(head, total, distinct, discount, backoff, bloom, least, rest, buckets, from_count), words


def _rest_counts(words: DataFrame, m: LanguageModel) -> DataFrame:
    """(bucket, keys, levels) of the n-grams that aren't in the filter."""
    least, buckets, base = m.least_count, m.buckets, m.filter.base

    def row(bucket: int, k: np.ndarray, c: np.ndarray) -> tuple[int, bytes, bytes]:
        return bucket, _pack_keys(k >> SPARE), level_of(c, base).astype(np.uint8).tobytes()

    def of_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for bucket, *r in zip(b["bucket"], b["k"], b["c"], strict=True):
                k, c, _ = _unpack(*r, b"")
                yield pd.DataFrame([row(bucket, k[c < least], c[c < least])], columns=["bucket", "k", "level"])

    def of_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            h, c = _mix(hash_words(b["w"].tolist()) ^ UNIGRAM), b["c"].to_numpy(np.int64)
            by = np.argsort(h)
            h, c = h[by], c[by]
            yield pd.DataFrame([row(x, h[i:j], c[i:j]) for x, i, j in _by_bucket(h, buckets)], columns=["bucket", "k", "level"])

    pairs = words.sparkSession.read.schema(PACKED).parquet(m.rest).select("bucket", "k", "c")
    tail = words.where(((F.col("c") < m.head_count) | (F.length("w") > 64)) & (F.col("c") < least))
    return pairs.mapInPandas(of_pairs, REST).union(tail.mapInPandas(of_words, REST))


@dataclass
class Looked:
    """What the head and the filter know of the tokens of some texts; each text begins with the end before it."""

    sizes: np.ndarray
    exact: np.ndarray
    word: np.ndarray  # levels of words outside the head and of the pair that ends at a token
    pair: np.ndarray
    open_words: np.ndarray  # tokens whose word, or pair, may be in the stored counts, and the keys
    open_pairs: np.ndarray
    word_keys: np.ndarray
    pair_keys: np.ndarray


def look_up(texts: list[str], m: LanguageModel) -> tuple[Looked, list[tuple[int, int, float, list[str]]]]:
    """And for each text (tokens, of them in the head, their base score, words outside the head)."""
    made = [HashedWords(t) for t in texts]
    sizes = np.array([len(w.hashes) + 2 for w in made])
    end = np.array([END_HASH])
    h = np.concatenate([x for w in made for x in (end, w.hashes, end)])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    exact = m.head.find(h)
    inside = exact > 0
    rare = np.flatnonzero(~inside)
    token = np.ones(len(h), bool)
    token[starts] = False  # the end before a text is its context only
    at = np.flatnonzero(token)
    word_keys, pair_keys = _mix(h[rare] ^ UNIGRAM), bigram_keys(h)[at - 1]
    word, pair = np.zeros(len(h), np.uint8), np.zeros(len(h), np.uint8)
    word[rare], pair[at] = m.filter.levels(word_keys), m.filter.levels(pair_keys)
    no_words, no_pairs = np.zeros(len(rare), bool), np.zeros(len(at), bool)
    if m.rest:
        # what the filter has reads at this level or above: below it, no key is in the filter
        floor = level_of(np.array([m.least_count]), m.filter.base)[0]
        no_words, no_pairs = word[rare] < floor, pair[at] < floor
        word[rare[no_words]] = pair[at[no_pairs]] = 0
    base = np.where(inside & token, np.log10((exact + 1) / (m.total + m.distinct + 1)), 0.0)
    known, base = np.add.reduceat(inside & token, starts, dtype=np.int64), np.add.reduceat(base, starts)
    outside: list[list[str]] = [[] for _ in texts]
    owner = np.searchsorted(starts, rare, side="right") - 1
    for i, d in zip((rare - starts[owner]).tolist(), owner.tolist(), strict=True):
        # the end may be outside too, where no training text has it: then it is no word
        outside[d].append(made[d].word(i - 1) if 0 < i <= len(made[d].hashes) else END) if i else None
    found = Looked(sizes, exact, word, pair, rare[no_words], at[no_pairs], word_keys[no_words], pair_keys[no_pairs])
    return found, [(int(n) - 1, int(k), float(b), o) for n, k, b, o in zip(sizes, known, base, outside, strict=True)]


def scores(x: Looked, m: LanguageModel) -> np.ndarray:
    """The model's score of each text."""
    starts = np.concatenate([[0], np.cumsum(x.sizes)[:-1]])
    token = np.ones(len(x.exact), bool)
    token[starts] = False
    counts = m.filter.counts
    used, pair = np.where(x.exact > 0, x.exact, counts[x.word]).astype(float), counts[x.pair]
    context = np.concatenate([[0.0], used[:-1]])
    back = np.where(context > 0, m.backoff[np.concatenate([[0], m.word_class(x.exact[:-1])])], 1.0)
    p = np.where(context > 0, np.maximum(pair - m.discount, 0) / np.maximum(context, 1), 0.0)
    score = np.log10(np.minimum(np.minimum(p, 1.0) + back * (used + 1) / (m.total + m.distinct + 1), 1.0)) * token
    return np.add.reduceat(score, starts)


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of about BATCH_CHARS characters."""
    for b in batches:
        ids, texts, size = [], [], 0
        for i, t in zip(b["_id"], b["_t"], strict=True):
            ids.append(i)
            texts.append(t)
            size += len(t)
            if size >= BATCH_CHARS:
                yield ids, texts
                ids, texts, size = [], [], 0
        if texts:
            yield ids, texts


SCORED = "_id string, n long, inside long, base double, outside array<string>"


def _scored_by_filter(docs: DataFrame, shared) -> DataFrame:
    """All n-grams are in the filter: rows with their scores, stored."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for ids, texts in _parts(batches):
            if m.total:
                found, rows = look_up(texts, m)
                score = scores(found, m)
            else:
                rows, score = [(len(HashedWords(t).hashes) + 1, 0, 0.0, []) for t in texts], 0.0
            yield pd.DataFrame({"_id": ids, **{c: [r[i] for r in rows] for i, c in enumerate(("n", "inside", "base", "outside"))}, "score": score})

    return stored(docs.mapInPandas(run, f"{SCORED}, score double").withColumn("_row", F.monotonically_increasing_id()), shared_dir(docs.sparkSession, "scored"))


def _scored_by_buckets(docs: DataFrame, shared, rest: DataFrame, packet_tokens: int) -> DataFrame:
    """Rows with their scores; what the filter lacks is looked up in the stored counts.

    A packet of texts sends its distinct open keys, sorted, to their buckets, and gets a level for each in the same order.
    """
    columns = ["_row", "_id", "n", "inside", "base", "outside", "packet", "bucket", "k", "state"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        packet, parts, n, row = TaskContext.get().partitionId() << 20, [], 0, 0

        def close() -> pd.DataFrame:
            keys = np.unique(np.concatenate([k for x in parts for k in (x.word_keys, x.pair_keys)]))
            for x in parts:
                x.word_keys, x.pair_keys = (np.searchsorted(keys, k).astype(np.uint32) for k in (x.word_keys, x.pair_keys))
            none = (None,) * 6
            rows = [(*none, packet, b, _pack_keys(keys[i:j] >> SPARE), None) for b, i, j in _by_bucket(keys, m.buckets)]
            return pd.DataFrame([*rows, (*none, packet, None, None, zlib.compress(pickle.dumps(parts), 1))], columns=columns)

        for ids, texts in _parts(batches):
            found, rows = look_up(texts, m)
            parts.append(found)
            n += len(found.exact)
            yield pd.DataFrame([((packet << 22) + row + i, d, *r, None, None, None, None) for i, (d, r) in enumerate(zip(ids, rows, strict=True))], columns=columns)
            row += len(texts)
            if n >= packet_tokens:
                yield close()
                packet, parts, n, row = packet + 1, [], 0, 0
        if parts:
            yield close()

    def levels(probes: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.empty(0, np.uint64), *map(_unpack_keys, counts["k"])])
        level = np.frombuffer(b"".join(counts["level"]), np.uint8)
        by = np.lexsort((255 - level, keys))  # of equal keys the highest level comes first
        keys, level = keys[by], level[by]
        out = []
        for packet, bucket, k in zip(probes["packet"], probes["bucket"], probes["k"], strict=True):
            k = _unpack_keys(k)
            at = np.searchsorted(keys, k)
            hit = at < len(keys)
            hit[hit] = keys[at[hit]] == k[hit]
            got = np.zeros(len(k), np.uint8)
            got[hit] = level[at[hit]]
            out.append((packet, bucket, got.tobytes()))
        return pd.DataFrame(out, columns=["packet", "bucket", "levels"])

    def finish(states: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        m = shared.value
        level = np.frombuffer(b"".join(found.sort_values("bucket")["levels"]), np.uint8)
        out, row = [], int(states["packet"].iloc[0]) << 22
        for x in pickle.loads(zlib.decompress(states["state"].iloc[0])):
            x.word[x.open_words], x.pair[x.open_pairs] = level[x.word_keys], level[x.pair_keys]
            out.append(pd.DataFrame({"_row": np.arange(row, row + len(x.sizes)), "score": scores(x, m)}))
            row += len(x.sizes)
        return pd.concat(out)

    made = stored(docs.mapInPandas(run, f"_row long, {SCORED}, packet long, bucket long, k binary, state binary"), shared_dir(docs.sparkSession, "packets"))
    probes = made.where(F.col("bucket").isNotNull()).select("packet", "bucket", "k")
    found = probes.groupBy("bucket").cogroup(rest.groupBy("bucket")).applyInPandas(levels, "packet long, bucket long, levels binary")
    states = made.where(F.col("state").isNotNull()).select("packet", "state")
    score = states.groupBy("packet").cogroup(found.groupBy("packet")).applyInPandas(finish, "_row long, score double")
    return made.where(F.col("_row").isNotNull()).drop("packet", "bucket", "k", "state").join(score, "_row")


def score_documents(docs: DataFrame, m: LanguageModel, words: DataFrame, packet_tokens: int = 3 * FLUSH_TOKENS) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of each row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(m)
    kind = docs.schema["doc_id"].dataType
    texts = docs.select(F.col("doc_id").cast("string").alias("_id"), text_or_empty().alias("_t"))
    scored = _scored_by_buckets(texts, shared, _rest_counts(words, m), packet_tokens) if m.rest else _scored_by_filter(texts, shared)
    # words outside the head are rare, so their rows spread evenly; skewed ones (very long words) Spark splits
    rest = scored.select("_row", F.explode("outside").alias("w")).join(words, "w", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    # (c + 1) / (N + V + 1); without training texts nothing is outside
    rest = rest.groupBy("_row").agg(F.count_if(F.col("c") > 0).alias("known"), F.sum(F.log10((F.col("c") + 1) / F.lit(float(m.total + m.distinct + 1)))).alias("more"))
    out = scored.drop("outside").join(rest, "_row", "left")
    return out.select(
        F.col("_id").cast(kind).alias("doc_id"),
        F.col("n").alias("n_tokens"),
        (F.col("inside") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(m.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
    )
