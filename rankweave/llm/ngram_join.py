r"""N-gram Jaccard join with adaptive multi-match prefixes, and the components of its links.

A document is the set of its distinct five-word shingles (64-bit hashes). Two link when 9 * shared >= 4 * (n + n'), which is a
Jaccard similarity of 0.8. In one global order of shingles, rare ones first, a document of n shingles has an m-match prefix of
n - ceil(0.8 n) + m shingles; two that link share at least min(m, m') of their prefixes. Each document chooses its m by
estimated cost: a longer prefix meets more postings, but of the documents met only those count as candidates that share m of them. The
order and the estimates come from a sketch of how often shingles occur, over all documents.

How many must be shared depends on both sizes, so a token at rank r of a set is in its prefix towards partners up to a certain size
only: each posting carries that bound, and a pair is made where each size is within the other's. Shingles that only one set has stand
first in the order, so an edited copy reaches the shingles of its group late, with a bound below the group's sizes.

Steps, each stored in the folder that the cluster shares:
1. signatures: equal sets become one node (the hash of the sorted set), so exact copies cost one row each from here on;
2. postings: the prefixes' tokens that two nodes or more have;
3. leaders: in each posting, members are compared with the one that has the fewest rare shingles, so a group of near copies is linked by
   about as many comparisons as it has members; the links are contracted;
4. the join: in postings that two or more components share, rows outside the largest component meet all others within the bounds; pairs that share
   enough prefix tokens are verified, first by parity bits (which bound from below how much two sets differ), then by the sets. Only pairs
   inside a component already known are left out: they can't change it;
5. components of all links, by repeated contraction to the least neighbour.

Nothing is capped: a frequent shingle stands late in the order, and pairs that remain in its posting are joined, not dropped.
Shingle and set hashes have 64 bits; equality of hashes is taken as equality.

Defined cases: words are runs of [^\x20\x09-\x0D], A-Z lower-cased; with fewer than five words the whole sequence is one
shingle; a null or empty text, or one without words, has none, links with nothing and is its own component; a null doc_id
is kept, its component_id is the least id that isn't null, or null; a repeated row is a document of its own; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.llm.common import HashedWords, arrow_batches, shared_dir, stored

SLICES = 64
MAX_MATCHES = 8
#: Tasks whose counters of a slice are summed in one group: at most 16 * 2 MB.
FAN_IN = 16
BATCH_SHINGLES = 250_000
MAX_CACHED = 400_000
#: Rows of an Arrow batch: texts and parity bits of 10,000 rows, Spark's default, can be large in both the JVM and Python.
BATCH_ROWS = 1_000
#: Sizes of one band differ by this ratio at most.
BAND = 1.12
#: A shingle whose counter stands this far over the mean goes to the join without a look at who else has it.
HOT = 5_000
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a whole text's shingles."""
    h = HashedWords(text).hashes
    if not len(h):
        return h
    k = min(size, len(h))
    n = len(h) - k + 1
    out = h[:n] * ODD[0]
    for j in range(1, k):
        out = out * ODD[j % len(ODD)] + h[j : n + j]
    out = _mix(out + np.uint64((k * 0x8EBC6AF09C88C6E3) & 0xFFFFFFFFFFFFFFFF))
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def parity_bits(shingles: np.ndarray) -> bytes:
    """About as many bits as there are shingles (a power of two from 64): each says if an odd number of shingles fell on it."""
    width = max(64, 1 << (len(shingles) - 1).bit_length())
    at = (shingles & np.uint64(width - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=width) & 1).astype(np.uint8), bitorder="little").tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """No less than this many shingles are in one of two sets only: those in both fall on the same bits and cancel out."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def set_node(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).view(np.int64))


def fewest_shared(n: int) -> int:
    """What a set of n shares at least with any that it links with: the least whole number from 0.8 n."""
    return (4 * n + 4) // 5


def choose_matches(excess: np.ndarray, n: int) -> int:
    """m with the least estimated cost; excess: how many others have each shingle, in the global order.

    What is met is counted over the prefix towards partners of equal size, by far the most frequent ones.
    """
    base, best, least = n - (8 * n + 8) // 9, 1, None
    met = np.concatenate([[0.0], np.cumsum(excess)])
    for m in range(1, min(MAX_MATCHES, fewest_shared(n)) + 1):
        # postings met, and candidates: each uses up m of them; a candidate costs a comparison of two sets
        cost = n - fewest_shared(n) + m + met[base + m] + met[base + m] / m * (4 + n / 16)
        if least is None or cost < least:
            best, least = m, cost
    return best


def sketch_bits(docs: DataFrame) -> int:
    """As many counters as keep some ten shingles on each, 2**24 at most (64 MB in a task's Python)."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(24, max(18, size.bit_length() - 7))


def sketch_codes(counts: np.ndarray, mean: float) -> np.ndarray:
    """How far counters stand over the mean, in quarter octaves; 0: not at all."""
    ratio = np.maximum(counts / max(mean, 1.0), 1.0)
    return np.where(ratio > 1, np.minimum(1 + np.floor(4 * np.log2(ratio)), 255), 0).astype(np.uint8)


def excess_of_codes(mean: float) -> np.ndarray:
    """For each code, about how many others have a shingle: what a counter holds over what chance explains."""
    ratio = 2.0 ** ((np.arange(256) - 1) / 4)
    out = np.maximum(ratio - (2 if mean >= 1 else 1), 0) * max(mean, 1.0)
    out[0] = 0
    return out


def _signatures(docs: DataFrame, size: int, bits: int) -> DataFrame:
    """Rows of documents (doc_id, n, node, bits), and of the sketch (slice, part, counts)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, places, held = np.zeros(1 << bits, np.uint32), [], 0

        def add() -> None:
            at, n = np.unique(np.concatenate(places), return_counts=True)
            counts[at] += n.astype(np.uint32)
            places.clear()

        for b in batches:
            rows = []
            for doc_id, text in zip(b["_id"].tolist(), b["_t"].tolist(), strict=True):
                s = shingle_set(text, size)
                if len(s):
                    places.append((s >> np.uint64(64 - bits)).astype(np.uint32))
                    held += len(s)
                    if held >= BATCH_SHINGLES:
                        add()
                        held = 0
                    rows.append((doc_id, len(s), set_node(s), parity_bits(s), -1, 0, None))
                else:
                    rows.append((doc_id, 0, None, None, -1, 0, None))
            yield _frame(rows)
        if places:
            add()
        part = TaskContext.get().partitionId()
        for i, x in enumerate(counts.reshape(SLICES, -1)):
            if x.any():
                yield _frame([(None, None, None, None, i, part, _planes(x))])

    schema = "_id string, n int, node long, bits binary, slice int, part int, counts binary"
    return docs.select(F.col("doc_id").cast("string").alias("_id"), F.col("text").alias("_t")).mapInPandas(run, schema)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["_id", "n", "node", "bits", "slice", "part", "counts"], dtype=object)
    return out.assign(slice=out["slice"].astype("int32"), part=out["part"].astype("int32"))


def _planes(x: np.ndarray) -> bytes:
    """Byte by byte of all numbers, so that the zeros of small ones stand together and compress."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _from_planes(raw: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _sketch(signatures: DataFrame, bits: int) -> tuple[np.ndarray, float]:
    """The codes of the tasks' summed sketches, and the mean: slice by slice, FAN_IN tasks' counters at a time in as many levels as
    the tasks ask for, so a group stays small at any number of them; a byte a counter comes to the driver."""
    said = signatures.agg(F.sum(F.when(F.col("slice") < 0, F.col("n"))).alias("total"), F.max("part").alias("last")).first()
    mean = (said["total"] or 0) / (1 << bits)

    def summed(pdf: pd.DataFrame) -> np.ndarray:
        out = np.zeros((1 << bits) // SLICES, np.uint64)
        for raw in pdf["counts"]:
            out += _from_planes(raw, np.uint64 if len(raw) == 8 * len(out) else np.uint32).astype(np.uint64)
        return out

    def some(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"slice": [int(key[0])], "part": [int(key[1])], "counts": [_planes(summed(pdf))]})

    def coded(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"slice": [int(key[0])], "counts": [sketch_codes(summed(pdf).astype(float), mean).tobytes()]})

    rows = signatures.where(F.col("slice") >= 0).select("slice", "part", "counts")
    parts = (said["last"] or 0) + 1
    while parts > FAN_IN:
        rows = rows.select("slice", F.expr(f"part div {FAN_IN}").cast("int").alias("part"), "counts")
        rows = rows.groupBy("slice", "part").applyInPandas(lambda k, p: some(k, p), "slice int, part int, counts binary")
        parts = -(-parts // FAN_IN)
    rows = rows.select("slice", "counts").groupBy("slice").applyInPandas(lambda k, p: coded(k, p), "slice int, counts binary")
    out = np.zeros((SLICES, (1 << bits) // SLICES), np.uint8)
    for r in rows.collect():
        out[r["slice"]] = np.frombuffer(bytes(r["counts"]), np.uint8)
    return out.ravel(), mean


def _postings(docs: DataFrame, size: int, sketch, bits: int) -> DataFrame:
    """(token, node, nm): the prefixes of distinct sets, copies within a task once.

    nm packs, from the top: n; the token's rank less m - 1, plus MAX_MATCHES; m; how many of the set's shingles look rare (on a scale
    of 32); if the token is hot. One number keeps rows short.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        level, mean = sketch.value
        excess_of, seen = excess_of_codes(mean), set()
        for b in batches:
            tokens, nodes, packed = [], [], []
            for text in b["_t"].tolist():
                s = shingle_set(text, size)
                if not len(s) or (node := set_node(s)) in seen:
                    continue
                if len(seen) >= MAX_CACHED:
                    seen.clear()
                seen.add(node)
                at = (s >> np.uint64(64 - bits)).astype(np.int64)
                lv = level[at]
                order = np.argsort(lv, kind="stable") if lv.any() else np.arange(len(s))
                excess = excess_of[lv[order]]
                m = choose_matches(excess, len(s)) if excess.any() else 1
                p = len(s) - fewest_shared(len(s)) + m
                rare = int((excess == 0).sum())
                rare = rare if rare < 16 else min(31, 11 + rare.bit_length())
                tokens.append(s[order[:p]])
                nodes.append(np.full(p, node, np.int64))
                packed.append((len(s) << 36) + ((np.arange(p) + (MAX_MATCHES - m + 1)) << 10) + (m << 6) + (rare << 1) + (excess[:p] > HOT))
            if tokens:
                yield pd.DataFrame({"token": np.concatenate(tokens).view(np.int64), "node": np.concatenate(nodes), "nm": np.concatenate(packed)})

    return docs.select(F.col("text").alias("_t")).mapInPandas(run, "token long, node long, nm long")


def _unpacked(rows: DataFrame, *more: str) -> DataFrame:
    """Of (token, node, nm): n, m, rare and `room`. The token is in the prefix towards sets of n' shingles just when 4 * n' <= room."""
    low = lambda at, mask: F.shiftright("nm", at).bitwiseAND(F.lit(mask)).cast("int")
    n, rank = F.shiftright("nm", 36).cast("int"), low(10, (1 << 26) - 1) - MAX_MATCHES
    # two that link share at least 4 * (n + n') / 9; the prefix has the first n - that + m in the order
    return rows.select("token", "node", n.alias("n"), low(6, 15).alias("m"), low(1, 31).alias("rare"), (5 * n.cast("long") - 9 * rank).alias("room"), *more)


def _bitmap(nodes: DataFrame, bits: int) -> np.ndarray:
    """One bit for each of 2**bits values of a node's first bits: what a pass over all texts may skip."""
    at = F.shiftrightunsigned("node", 64 - bits)
    words = nodes.select(F.shiftright(at, 6).alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(node, {64 - bits}) & 63 AS int))").alias("b"))
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow().to_pandas()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found["w"].to_numpy(np.int64)] = found["b"].to_numpy(np.int64).view(np.uint64)
    return out


def _sets(docs: DataFrame, nodes: DataFrame, size: int, path: str) -> DataFrame:
    """(node, s): the shingles of the nodes asked for, made again from the texts. The bitmap follows their number, up to 32 MB;
    what it lets through beyond them, the join takes out."""
    spark = docs.sparkSession
    nodes = stored(nodes, f"{path}-nodes")
    bits = min(28, max(16, nodes.count().bit_length() + 5))
    shared = spark.sparkContext.broadcast(_bitmap(nodes, bits))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bitmap, seen = shared.value, set()
        for b in batches:
            rows, held = [], 0
            for text in b["_t"].tolist():
                s = shingle_set(text, size)
                if not len(s) or (node := set_node(s)) in seen:
                    continue
                at = (node & 0xFFFFFFFFFFFFFFFF) >> (64 - bits)
                if (int(bitmap[at >> 6]) >> (at & 63)) & 1:
                    if len(seen) >= MAX_CACHED:
                        seen.clear()
                    seen.add(node)
                    rows.append((node, s.view(np.int64)))
                    held += len(s)
                    if held >= BATCH_SHINGLES:
                        yield pd.DataFrame(rows, columns=["node", "s"])
                        rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=["node", "s"])

    made = docs.select(F.col("text").alias("_t")).mapInPandas(run, "node long, s array<bigint>")
    return stored(made.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("s").alias("s")), path)


def _verified(docs: DataFrame, pairs: DataFrame, bits: DataFrame, size: int, root: str, name: str) -> DataFrame:
    """The pairs (a, b) that link, stored. Pairs whose parity bits already differ in too many places need no sets."""

    def likely(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            # 9 * shared >= 4 * (n + n') means 9 * (in one only) <= n + n'
            keep = [9 * least_difference(x, y) <= n for x, y, n in zip(b["xa"], b["xb"], b["nn"], strict=True)]
            yield b.loc[np.array(keep, bool), ["a", "b"]]

    side = lambda c: bits.select(F.col("node").alias(c), F.col("bits").alias(f"x{c}"), F.col("n").alias(f"n{c}"))
    close = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "xa", "xb", (F.col("na") + F.col("nb")).alias("nn"))
    pairs = stored(close.mapInPandas(likely, "a long, b long"), f"{root}/{name}-pairs")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = _sets(docs, nodes, size, f"{root}/{name}-sets")

    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    # row by row in the JVM: a Python batch would hold the sets of thousands of pairs at once
    link = 9 * F.size(F.array_intersect("sa", "sb")) >= 4 * (F.size("sa") + F.size("sb"))
    return stored(both.where(link).select("a", "b"), f"{root}/{name}-links")


def components(links: DataFrame, root: str) -> DataFrame:
    """(node, comp) of every node in links (a, b): comp is the least node reachable. Rounds of contraction, each stored."""
    spark = links.sparkSession
    edges = links.select("a", "b").where(F.col("a") != F.col("b"))
    labels, i = None, 0
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # the least of a node and its neighbours: pointers downwards, a forest
        up = stored(both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("node"), F.least("a", "p").alias("p")), f"{root}/up-{i}")
        # a jump along it
        to = up.select(F.col("node").alias("p"), F.col("p").alias("q"))
        up = stored(up.join(to, "p", "left").select("node", F.coalesce("q", "p").alias("p")), f"{root}/jump-{i}")
        if labels is None:
            labels = up.select("node", F.col("p").alias("comp"))
        else:
            labels = labels.join(up.select(F.col("node").alias("comp"), "p"), "comp", "left").select("node", F.coalesce("p", "comp").alias("comp"))
        labels = stored(labels, f"{root}/labels-{i}")
        at = lambda side: up.select(F.col("node").alias(side), F.col("p").alias(f"p{side}"))
        edges = stored(edges.join(at("a"), "a").join(at("b"), "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), f"{root}/edges-{i}")
        if edges.isEmpty():
            return labels
        i += 1


def _extended(known: DataFrame, more: DataFrame, root: str) -> DataFrame:
    """Components of the links that gave `known` and of more ones: only links between known components are worked on."""
    at = lambda side: known.select(F.col("node").alias(side), F.col("comp").alias(f"p{side}"))
    a, b = F.coalesce("pa", "a"), F.coalesce("pb", "b")
    between = more.join(at("a"), "a", "left").join(at("b"), "b", "left").where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    between = stored(between.distinct(), f"{root}-between")
    if between.isEmpty():
        return known
    joined = components(between, root)
    moved = known.join(joined.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    return moved.unionByName(joined.join(known.select("node"), "node", "left_anti").select("node", "comp"))


def jaccard_components(docs: DataFrame, size: int = 5, leaders: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, node) of each row of docs; node numbers equal sets alike. leaders=False leaves step 3 out."""
    with arrow_batches(docs.sparkSession, BATCH_ROWS):  # what runs in Python is stored before this ends
        return _components_of(docs, size, leaders)


def _components_of(docs: DataFrame, size: int, leaders: bool) -> DataFrame:
    spark = docs.sparkSession
    root = shared_dir(spark, "jaccard")
    kind = docs.schema["doc_id"].dataType
    docs = docs.select("doc_id", "text")
    bits = sketch_bits(docs)
    signed = stored(_signatures(docs, size, bits), f"{root}/signatures")
    sketch = spark.sparkContext.broadcast(_sketch(signed, bits))
    rows = signed.where(F.col("slice") < 0).select(F.col("_id").cast(kind).alias("doc_id"), "n", "node", "bits")
    sets = stored(rows.where(F.col("n") > 0).groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits")), f"{root}/nodes")
    shared = _shared(_postings(docs, size, sketch, bits), f"{root}/shared")

    known = spark.createDataFrame([], "node long, comp long")
    if leaders:
        known = components(_verified(docs, _leader_pairs(shared), sets, size, root, "lead"), f"{root}/cc-lead")
    pairs = _cross_pairs(shared, known, f"{root}/contested")
    labels = _extended(known, _verified(docs, pairs, sets, size, root, "join"), f"{root}/cc")

    placed = rows.join(labels, "node", "left").select("doc_id", "n", "node", F.coalesce("comp", "node").alias("comp"))
    firsts = placed.where(F.col("comp").isNotNull()).groupBy("comp").agg(F.min("doc_id").alias("first"))
    out = placed.join(firsts, "comp", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("first")).alias("component_id"), "node")


def _shared(posted: DataFrame, path: str) -> DataFrame:
    """(token, node, nm), distinct, of tokens that two nodes or more have."""
    # hot tokens are known to be shared: their rows are dealt out by node and kept without a look at each other
    hot = F.col("nm").bitwiseAND(F.lit(1)) == 1
    w = Window.partitionBy("token", F.when(hot, F.col("node"))).orderBy("node")
    rows = posted.select("token", "node", "nm", F.lag("node").over(w).alias("p"), F.lead("node").over(w).alias("q"))
    rows = rows.where(hot | (F.col("p") != F.col("node")) | (F.col("q") != F.col("node")))
    return stored(rows.select("token", "node", "nm").distinct(), path)


def _band(n: Column, ratio: float) -> Column:
    return F.floor(F.log(n.cast("double")) / float(np.log(ratio)) + 1e-9).cast("int")


def _leader_pairs(shared: DataFrame) -> DataFrame:
    """(a, b): in each posting, members by band of sizes with the band's leader (fewest rare shingles: what others are edits of),
    and leaders of neighbouring bands with each other; as many pairs as there are postings at most."""
    rows = _unpacked(shared).withColumn("band", _band(F.col("n"), 1.25))
    lead = rows.groupBy("token", "band").agg(F.min(F.struct("rare", "node", "n", "room")).alias("l"))
    below = F.lag("l").over(Window.partitionBy("token").orderBy("band"))
    own = rows.join(lead, ["token", "band"]).select(F.struct("rare", "node", "n", "room").alias("x"), F.col("l").alias("y"))
    both = own.unionByName(lead.select(F.col("l").alias("x"), below.alias("y")).where(F.col("y").isNotNull()))
    fits = (4 * F.col("x.n").cast("long") <= F.col("y.room")) & (4 * F.col("y.n").cast("long") <= F.col("x.room"))
    both = both.where(fits & (F.col("x.node") != F.col("y.node")))
    return both.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _cross_pairs(shared: DataFrame, known: DataFrame, path: str) -> DataFrame:
    """(a, b) of different components that share as many prefix tokens as they need.

    In each posting, the rows outside its largest component look for partners among all of its rows, by bands of sizes that their room
    and the size ratio allow.
    """
    some = _unpacked(shared).join(known, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    by_comp = some.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("k"))
    mixed = by_comp.groupBy("token").agg(F.max(F.struct("k", "comp")).alias("top"), F.count(F.lit(1)).alias("comps")).where("comps > 1").select("token", F.col("top.comp").alias("most"))
    rows = stored(some.join(mixed, "token").select("token", "node", "n", "m", "room", "comp", (F.col("comp") == F.col("most")).alias("inside")), path)
    home = rows.withColumn("band", _band(F.col("n"), BAND)).alias("y")
    most = F.least(F.floor(F.col("room") / 4), F.floor(1.25 * F.col("n")))
    least = F.ceil(0.8 * F.col("n") - 1e-9)
    probe = rows.where(~F.col("inside") & (most >= least)).withColumn("band", F.explode(F.sequence(_band(least, BAND), _band(most, BAND)))).alias("x")
    near = (F.col("x.token") == F.col("y.token")) & (F.col("x.band") == F.col("y.band")) & (F.col("x.comp") != F.col("y.comp"))
    near = near & (F.col("y.inside") | (F.col("x.node") < F.col("y.node"))) & (5 * F.least("x.n", "y.n").cast("long") >= 4 * F.greatest("x.n", "y.n").cast("long"))
    near = near & (4 * F.col("y.n").cast("long") <= F.col("x.room")) & (4 * F.col("x.n").cast("long") <= F.col("y.room"))
    met = probe.join(home, near).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"), F.least("x.m", "y.m").alias("m"))
    return met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.first("m").alias("m")).where("shared >= m").select("a", "b")
