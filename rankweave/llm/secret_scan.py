r"""Secret scans: base patterns, and multipart credentials linked by an interval join, in DataFrame operations only.

Base kinds (assign, access, hex) are strong and always reported. Weak candidates (ident: a user name or client id that is
assigned; blob: a long mixed token; endpoint: a service address) are everyday text on their own; one is reported
only when a complementary part lies within its scope, that is, at most `scope` code points away: an ident needs a secret
(assign, hex) or a blob, a blob needs an access identifier, an ident or an endpoint, an endpoint needs a secret, an access identifier or a
blob. So parts that are all weak back each other, in texts without base spans too. The join is on (row, block of `scope` code points) with the
overlap tested, so a document with very many parts is joined block by block and never all with all.

Offsets count code points, ends are exclusive. They come from the pieces between matches, by one left-to-right fold.

Defined cases: a null or empty text has no spans; a null or repeated doc_id is kept, each row being scanned by
itself; other columns of docs may have any names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import shared_dir, stored, text_or_empty

# The base patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # as AKIA[A-Z0-9]+ of 20 characters or more: a run's first AKIA has its longest match
HEX = r"[0-9a-f]{24,}"  # as [0-9a-f]+ of 24 or more: matches are whole runs
MIN_VALUE = 6
#: Order of kinds at the same start.
KINDS = ["assign", "access", "hex", "ident", "blob", "endpoint"]
IDENT = r"""(?i)\b(?:user(?:name)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@+-]{3,}"""
BLOB = r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])[A-Za-z0-9+/]{32,}={0,2}"
ENDPOINT = r"""(?:https?|ftp|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|redis|amqps?|mongodb(?:\+srv)?)://[^\x20\x09-\x0D"'<>]+"""
SPAN = "struct<s:int,k:int,e:int>"
#: Items of a chunk in folds over one text's matches.
CHUNK = 256


def _let(value: Column, use) -> Column:
    """use(value), with the value evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _chunks(items: Column) -> Column:
    """An array cut into arrays of CHUNK items; an empty one gives one empty chunk."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int")), lambda i: F.slice(items, F.abs(i) * CHUNK + 1, F.lit(CHUNK)))


def _fold(items: Column, state: Column, step) -> Column:
    """A left-to-right fold that collects spans: step(state, item) gives the next state and an array of spans to append.

    To append to one list copies it for each item. Here lists grow within chunks, and whole chunks are put together at the end.
    """
    none = _none().alias("out")

    def one(at: Column, chunk: Column) -> Column:
        def merge(a: Column, x: Column) -> Column:
            after, more = step(a["at"], x)
            return F.struct(after.alias("at"), F.concat(a["out"], more).alias("out"))

        return F.aggregate(chunk, F.struct(at.alias("at"), none), merge)

    start = F.struct(state.alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("out"))
    add = lambda a, chunk: _let(one(a["at"], chunk), lambda r: F.struct(r["at"].alias("at"), F.concat(a["out"], F.array(r["out"])).alias("out")))
    return _let(items, lambda b: F.aggregate(_chunks(b), start, add, lambda a: F.struct(a["at"].alias("at"), F.flatten(a["out"]).alias("out"))))


def _spans(text: Column, pattern: str, kind: int, at_least: int = 0, group: int = 0) -> Column:
    """Matches of a pattern, leftmost and non-overlapping; those whose group is too short are dropped after matching."""
    p = F.lit(pattern)
    hits = F.regexp_extract_all(text, p, F.lit(0))
    both = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), hits, lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("n")))
    step = lambda at, x: (at + x["gap"] + x["n"], F.array(F.struct((at + x["gap"]).alias("s"), F.lit(kind).alias("k"), (at + x["gap"] + x["n"]).alias("e"))))
    found = _fold(both, F.lit(0), step)["out"]
    if not at_least:
        return found
    long = F.transform(F.regexp_extract_all(text, p, F.lit(group)), lambda v: F.length(v) >= at_least)
    return F.transform(F.filter(F.arrays_zip(found.alias("a"), long.alias("b")), lambda x: x["b"]), lambda x: x["a"])


def _none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def base_spans(text: Column) -> Column:
    """The base kinds' spans, by start, then kind. A cheap test goes before each pattern; most texts pass none."""
    assign = F.when(text.rlike("(?i)password|passwd|secret|token|api_?key"), _spans(text, ASSIGN, 0, MIN_VALUE, 2)).otherwise(_none())
    access = F.when(F.contains(text, F.lit("AKIA")), _spans(text, ACCESS, 1)).otherwise(_none())
    hexes = F.when(text.rlike("[0-9a-f]{24}"), _spans(text, HEX, 2)).otherwise(_none())
    return F.sort_array(F.concat(assign, access, hexes))


def weak_spans(text: Column) -> Column:
    """The weak kinds' spans, after cheap tests as for the base kinds."""
    ident = F.when(text.rlike("(?i)user|login|account|client_?id"), _spans(text, IDENT, 3)).otherwise(_none())
    blob = F.when(text.rlike("[A-Za-z0-9+/]{32}"), _spans(text, BLOB, 4)).otherwise(_none())
    endpoint = F.when(F.contains(text, F.lit("://")), _spans(text, ENDPOINT, 5)).otherwise(_none())
    return F.concat(ident, blob, endpoint)


def may_link(text: Column) -> Column:
    """Whether the text has a blob and an ident or endpoint, which can back each other."""
    return text.rlike("[A-Za-z0-9+/]{32}") & text.rlike(BLOB) & (text.rlike(IDENT) | text.rlike(ENDPOINT))


def linked(rows: DataFrame, scope: int = 256) -> DataFrame:
    """rows (_row, _base, _weak) to (_row, _linked): each row's weak spans that a complementary part backs."""
    blocks = lambda s, e: F.explode(F.sequence(F.floor(s / scope), F.floor(e / scope)))
    weak = rows.select("_row", F.explode("_weak").alias("w")).select("_row", "w", blocks(F.greatest(F.col("w.s") - scope, F.lit(0)), F.col("w.e") + scope).alias("_block"))
    parts = rows.where(F.size("_weak") > 0).select(F.col("_row").alias("_r"), F.explode(F.concat("_base", "_weak")).alias("b")).select("_r", "b", blocks(F.col("b.s"), F.col("b.e") - 1).alias("_b"))
    fits = ((F.col("w.k") == 3) & F.col("b.k").isin(0, 2, 4)) | ((F.col("w.k") == 4) & F.col("b.k").isin(1, 3, 5)) | ((F.col("w.k") == 5) & F.col("b.k").isin(0, 1, 2, 4))
    near = (F.col("b.s") < F.col("w.e") + scope) & (F.col("b.e") > F.col("w.s") - scope)
    # a weak span inside another says nothing new
    apart = (F.col("b.e") <= F.col("w.s")) | (F.col("b.s") >= F.col("w.e"))
    hits = weak.join(parts, (F.col("_row") == F.col("_r")) & (F.col("_block") == F.col("_b")) & fits & near & apart, "left_semi")
    return hits.groupBy("_row").agg(F.collect_set("w").alias("_linked"))


def find_secrets(docs: DataFrame, carry: list[str], scope: int = 256) -> DataFrame:
    """(carried columns, _base, _linked): arrays of (s, k, e), k an index of KINDS, each sorted by start and kind.

    What the patterns found is stored, without the texts, before the join: row numbers then stay as they are.
    """
    spark = docs.sparkSession
    rows = docs.select(*carry, text_or_empty().alias("_t")).withColumn("_base", base_spans(F.col("_t")))
    rows = rows.withColumn("_weak", F.when((F.size("_base") > 0) | may_link(F.col("_t")), weak_spans(F.col("_t"))).otherwise(_none())).drop("_t")
    rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()), shared_dir(spark, "secrets"))
    out = rows.join(linked(rows, scope), "_row", "left")
    return out.select(*carry, "_base", F.sort_array(F.coalesce("_linked", _none())).alias("_linked"))


def span_text(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["s"], x["e"])), ",")


def _masked(text: Column, spans: Column, mask: Column) -> Column:
    """The text with a mask for each run of spans that touch or overlap. A text is cut chunk by chunk, as a cut counts code points from its start."""
    span = lambda x: F.array(x).cast(f"array<{SPAN}>")
    new = lambda at, x: (at["e"] > 0) & (x["s"] > at["e"])  # noqa: E731  # the run so far ends before x
    step = lambda at, x: (
        F.when((at["e"] > 0) & ~new(at, x), F.struct(at["s"].alias("s"), at["k"].alias("k"), F.greatest(at["e"], x["e"]).alias("e"))).otherwise(x),
        F.when(new(at, x), span(at)).otherwise(_none()),
    )
    open_run = F.struct(*(F.lit(0).alias(c) for c in "ske"))
    runs = _let(_fold(spans, open_run, step), lambda r: F.concat(r["out"], F.when(r["at"]["e"] > 0, span(r["at"])).otherwise(_none())))

    def cut(m: Column) -> Column:
        def chunk(ch: Column, i: Column) -> Column:
            before = F.when(i == 0, 0).otherwise(F.try_element_at(m, i * CHUNK)["e"])
            end = F.coalesce(F.try_element_at(ch, F.lit(-1))["e"], F.lit(0))

            def pieces(piece: Column) -> Column:
                def one(x: Column, j: Column) -> Column:
                    last = F.when(j == 0, before).otherwise(F.try_element_at(ch, j)["e"])
                    return F.concat(F.substring(piece, last - before + 1, x["s"] - last), mask)

                return F.array_join(F.transform(ch, one), "")

            return _let(F.substring(text, before + 1, end - before), pieces)

        rest = F.coalesce(F.try_element_at(m, F.lit(-1))["e"], F.lit(0))
        return F.concat(F.array_join(_let(_chunks(m), lambda cs: F.transform(cs, chunk)), ""), F.substring(text, rest + 1, F.length(text)))

    return _let(runs, cut)


def mask_secrets(docs: DataFrame, mask: str = "[secret]", scope: int = 256) -> DataFrame:
    """docs with every reported span of `text` replaced by a mask (spans that touch share one); n_chars, if there, follows.

    Texts without a base span and without weak ones that can back each other take no part in the join and pass as they are.
    """
    names = docs.columns
    inner = docs.toDF(*(c if c == "text" else f"c{i}" for i, c in enumerate(names)))
    found = (F.size(base_spans(text_or_empty())) > 0) | may_link(text_or_empty())
    hit = find_secrets(inner.where(found), inner.columns, scope)
    masked = hit.withColumn("text", _masked(F.col("text"), F.sort_array(F.concat("_base", "_linked")), F.lit(mask)))
    out = inner.where(~found).select(inner.columns).unionByName(masked.select(inner.columns))
    for i, c in enumerate(names):
        if c == "n_chars":
            out = out.withColumn(f"c{i}", F.when(F.col("text").isNull(), F.col(f"c{i}")).otherwise(F.length("text").cast(docs.schema[c].dataType)))
    return out.select(*(F.col("text" if c == "text" else f"c{i}").alias(c) for i, c in enumerate(names)))
