"""Line dedup: levelled sorted runs of line hashes, in DataFrame operations only.

Batches of documents arrive one after the other. A batch's lines are counted per key (documents holding it) and merge-joined
against the runs kept so far: a key that no run has (the anti-join) is a new line, and starts at its count in the batch; a known one goes on from
the count that the runs have. The batch's keys with their counts up to now are its own sorted run, at level 0. So the latest run that
has a key has its count over all batches so far, which is the largest of its counts. When a level holds `fanout` runs they are merged
into one run of the next level, so a key is looked up in few files however many batches came. Runs are Parquet files, sorted by
hash, in the folder that the cluster shares; nothing of them is on the driver. The number of batches follows the input: one for each
256 GB of text, and MIN_BATCHES at least.

A key is the line without [\\x20\\x09-\\x0D] at both ends and with A-Z lower-cased; runs hold two independent
64-bit hashes of it, 128 bits together.

Defined cases: a null or empty text is one empty line, whose empty key (under `min_chars` code points) is never
dropped; the same row twice counts as two documents; a null doc_id is kept as null; columns beside doc_id and
text pass through `dedup_lines` untouched, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.llm.common import SPACES, shared_dir, stored, text_or_empty

#: Dropped keys up to this many (16 bytes each) are broadcast to the lines; more are merge-joined.
MAX_BROADCAST_KEYS = 250_000
MIN_BATCHES = 6
BATCH_BYTES = 1 << 38


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACES))


def folded(line: Column) -> Column:
    """Equal for two lines just when they are equal once A-Z are lower-cased.

    Lower-casing the UTF-8 bytes as Latin-1 characters maps A-Z to a-z and lead bytes of two-byte characters to
    others, one to one: how many continuation bytes follow tells them from the lead bytes of longer characters.
    """
    return F.lower(F.decode(line.cast("binary"), "ISO-8859-1"))


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2")]


@dataclass
class LineRuns:
    """Sorted runs (h1, h2, n, first): n documents up to a batch held the key, `first` is the least doc_id of them."""

    spark: SparkSession
    root: str
    fanout: int = 4
    levels: list[list[DataFrame]] = field(default_factory=list)
    written: int = 0

    def _write(self, run: DataFrame) -> DataFrame:
        self.written += 1
        return stored(run.sortWithinPartitions("h1", "h2"), f"{self.root}/run-{self.written}")

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def union(self) -> DataFrame | None:
        return reduce(DataFrame.unionByName, self.runs()) if self.runs() else None

    @staticmethod
    def latest(runs: DataFrame) -> DataFrame:
        """A row for each key, from the latest run that has it: counts never fall and least ids never rise."""
        return runs.groupBy("h1", "h2").agg(F.max("n").alias("n"), F.min("first").alias("first"))

    def add(self, batch: DataFrame) -> DataFrame:
        """Takes a batch (h1, h2, n, first), a row for each key; returns its run."""
        kept = self.union()
        if kept is not None:
            old = self.latest(kept).select("h1", "h2", F.col("n").alias("m"), F.col("first").alias("f"))
            batch = batch.join(old.hint("merge"), ["h1", "h2"], "left").select("h1", "h2", (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"), F.least("first", "f").alias("first"))
        run = self._write(batch)
        self._push(0, run)
        return run

    def _push(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged, self.levels[level] = reduce(DataFrame.unionByName, self.levels[level]), []
            self._push(level + 1, self._write(self.latest(merged)))

    def frequent(self, min_docs: int) -> DataFrame:
        """(h1, h2, first) of keys with so many documents. A run that has them says so by itself; few keys do."""
        return self.union().where(F.col("n") >= min_docs).groupBy("h1", "h2").agg(F.min("first").alias("first"))


def frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int | None = None, fanout: int = 4) -> DataFrame:
    """(h1, h2, first) of the keys that at least `min_docs` documents hold, stored in the shared folder."""
    spark = docs.sparkSession
    root = shared_dir(spark, "lines")
    if batches is None:
        batches = MIN_BATCHES + (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BATCH_BYTES
    lines = F.transform(split_lines(F.col("_t")), stripped)
    keys = F.array_distinct(F.transform(F.filter(lines, lambda x: F.length(x) >= min_chars), folded))
    each = (
        docs.select(F.col("doc_id"), text_or_empty().alias("_t"))
        .select(F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"), "doc_id", F.explode(keys).alias("_k"))
        .select("batch", "doc_id", *_hashes(F.col("_k")))
        .groupBy("batch", "h1", "h2")
        .agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    )
    each.write.partitionBy("batch").parquet(f"{root}/batches")
    schema = f"h1 bigint, h2 bigint, n bigint, first {dict(docs.dtypes)['doc_id']}, batch int"
    runs = LineRuns(spark, root, fanout)
    for b in range(batches):
        runs.add(spark.read.schema(schema).parquet(f"{root}/batches").where(F.col("batch") == b).select("h1", "h2", "n", "first"))
    return stored(runs.frequent(min_docs), f"{root}/frequent")


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int | None = None, fanout: int = 4, keep_first: bool = False) -> DataFrame:
    """docs with every line dropped whose key at least `min_docs` documents hold; keep_first: but for those of the least doc_id that holds it.

    The other lines stay in order, joined by \\n, as `text`; `n_lines` (before), `n_dropped` are added as one
    struct `line_stats`, or under another name if docs has that column.
    """
    drop = frequent_lines(docs, min_docs, min_chars, batches, fanout)
    drop = drop.select("h1", "h2", "first", F.lit(True).alias("_drop"))
    drop = F.broadcast(drop) if drop.count() <= MAX_BROADCAST_KEYS else drop.hint("merge")
    names = docs.columns
    rest = [i for i, c in enumerate(names) if c != "text"]
    # other columns travel as c0, c1, ... so that no name of theirs can clash with ours
    lines = (
        docs.toDF(*(f"c{i}" for i in range(len(names))))
        .withColumn("_row", F.monotonically_increasing_id())
        .select("_row", *(f"c{i}" for i in rest), F.col(f"c{names.index('doc_id')}").alias("_id"), F.posexplode(split_lines(F.coalesce(F.col(f"c{names.index('text')}"), F.lit("")))).alias("_pos", "_line"))
        # only a row's first line carries its other columns: they are shuffled once
        .select("_row", F.when(F.col("_pos") == 0, F.struct(F.lit(0).alias("_"), *(f"c{i}" for i in rest))).alias("_rest"), "_id", "_pos", "_line", stripped(F.col("_line")).alias("_k"))
        # lines under min_chars are in no run: hashes of their place spread them over the join
        .select("_row", "_rest", "_id", "_pos", "_line", *[F.when(F.length("_k") >= min_chars, h).otherwise(F.xxhash64("_row", "_pos")).alias(c) for c, h in zip(("h1", "h2"), _hashes(folded(F.col("_k"))), strict=True)])
    )
    gone = F.coalesce("_drop", F.lit(False))
    if keep_first:
        gone = gone & ~F.coalesce(F.col("_id") == F.col("first"), F.lit(False))
    kept = F.filter(F.col("_lines"), lambda x: ~x["gone"])
    out = (
        lines.join(drop, ["h1", "h2"], "left")
        .select("_row", "_rest", "_pos", "_line", gone.alias("_gone"))
        .groupBy("_row")
        .agg(
            F.first("_rest", ignorenulls=True).alias("_rest"),
            F.array_sort(F.collect_list(F.struct(F.col("_pos").alias("pos"), F.col("_gone").alias("gone"), F.when(~F.col("_gone"), F.col("_line")).alias("line")))).alias("_lines"),
        )
        .select(
            "_rest",
            F.array_join(F.transform(kept, lambda x: x["line"]), "\n").alias("_text"),
            F.struct(F.size("_lines").cast("long").alias("n_lines"), F.size(F.filter("_lines", lambda x: x["gone"])).cast("long").alias("n_dropped")).alias("_stats"),
        )
    )
    stats = "line_stats"
    while stats in names:
        stats += "_"
    return out.select(*(F.col("_text").alias("text") if c == "text" else F.col(f"_rest.c{i}").alias(c) for i, c in enumerate(names)), F.col("_stats").alias(stats))
