r"""Conversation structure repair: signatures of roles and faults, each solved once, its audit joined back and replayed.

A conversation's rows, ordered by turn (nulls first; those of one turn by a digest of role and text), become a string of one sign a row, the signature: the role's initial (s, u, a
or another) and the row's first fault (none, blank, duplicate, truncated). Conversations of one signature have one cheapest repair. So
distinct signatures are solved, each once, by recursion over (place, last initial) with a memo; the audits are joined back, and
a pass over the rows replays them.

The edits, one a row and insertions between them: K keeps a row, R gives it the role that must come next, D deletes it, which a blank or a duplicate
row needs, I inserts a message without text. After an edit the state is known, and the edits that start with different letters lead
to different states, so of equally cheap audits the ASCII-least is found by the first letter alone.

Scale: faults and signatures need no texts but their digests; a signature that a large share of all conversations has is salted before the join. Rows
travel once more for the replay: a task reads a conversation's rows in order, after its audit, and holds one row at a time, so a
conversation may be of any length; its signature and its audit, a letter a row, must fit one row, as results do.

Defined cases: a null role or text is one space; a null conv_id is a conversation of its own; a null turn comes first and counts in no gap; rows that are alike
are duplicates; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankweave.llm.common import SPACES, shared_dir, stored

#: A row's sign: at 4 * fault + role; faults are none, truncated, blank, duplicate.
SIGNS = "suaoSUAObcdefghi"
ROLES = "suao"
#: Sign i of a row without a fault, of a truncated one; the others must go.
TRUNCATED, GONE = frozenset(SIGNS[4:8]), frozenset(SIGNS[8:])
ROLE_OF = {sign: ROLES[i % 4] for i, sign in enumerate(SIGNS)}
#: After no row, a system row, a user row, an assistant row: which initial must come next when one is inserted or changed.
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}
#: The recursion's memo is filled from the end in steps of so many rows, so it never goes deeper.
DEPTH = 40
#: A signature that more than one in so many conversations have is salted; there can't be more than that of them.
HOT_SHARE, SALTS = 1000, 64
COUNTS = ("blank", "duplicate", "truncated", "illegal")
FIGURES = ("gaps", *COUNTS, "cost", "audit")
INFINITE = float("inf")
FLUSH_CHARS = 4_000_000


def follows(last: str, initial: str) -> bool:
    """May a row of this initial be kept after one of `last`?"""
    return initial == NEXT[last] or (last == "" and initial == "s")


def solve(signature: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair whose roles' initials are `(s?(ua)+)?`, the ASCII-least of equals."""
    n = len(signature)
    memo: dict[tuple[int, str, int], tuple[float, str, str]] = {}

    def best(i: int, last: str, inserted: int = 0) -> tuple[float, str, str]:
        """(cost from here on, first edit, initial after it) before row i, after `last`; insertions just made."""
        known = memo.get((i, last, inserted))
        if known is None:
            known = memo[i, last, inserted] = min(options(i, last, inserted), default=(INFINITE, "", ""))
        return known

    def options(i: int, last: str, inserted: int) -> Iterator[tuple[float, str, str]]:
        then = NEXT[last]
        if inserted < 2:  # a third one in a row would only lead back
            yield 2 + best(i, then, inserted + 1)[0], "I", then
        if i == n:
            if last in ("", "a"):
                yield 0, "", ""
            return
        sign = signature[i]
        yield 3 + best(i + 1, last)[0], "D", last
        if sign not in GONE:
            late = 1 if sign in TRUNCATED else 0
            if follows(last, role := ROLE_OF[sign]):
                yield late + best(i + 1, role)[0], "K", role
            yield 2 + late + best(i + 1, then)[0], "R", then

    for i in range(n - n % DEPTH, 0, -DEPTH):
        for last in NEXT:
            best(i, last)
    cost, edits, i, last, inserted = best(0, "")[0], [], 0, "", 0
    while edit := best(i, last, inserted)[1]:
        last = best(i, last, inserted)[2]
        i, inserted = (i, inserted + 1) if edit == "I" else (i + 1, 0)
        edits.append(edit)
    return int(cost), "".join(edits)


def counted(signature: str) -> tuple[int, int, int, int]:
    """Blank, duplicate and truncated rows, and neighbours whose initials aren't su, ua or au."""
    blank, duplicate, truncated = (sum(map(signature.count, SIGNS[i : i + 4])) for i in (8, 12, 4))
    roles = [ROLE_OF[c] for c in signature]
    illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(roles, roles[1:], strict=False))
    return blank, duplicate, truncated, illegal


def replay(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The repaired (role, text) of a conversation's rows."""
    last = ""
    for edit in audit:
        if edit == "I":
            last = NEXT[last]
            yield NAMES[last], ""
            continue
        role, text = next(rows)
        if edit == "D":
            continue
        if edit == "R":
            role = NAMES[NEXT[last]]
        last = role[:1]
        yield role, text


def _prepared(rows: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    out = rows.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    return out.withColumn("key", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)))


def signatures(rows: DataFrame, conv_ids: DataFrame) -> DataFrame:
    """(conv_id, signature, gaps) of each conversation of conv_ids, a null id too."""
    solid = F.rtrim("text", F.lit(SPACES))
    fault = F.when(solid == "", 2).when(~F.substring(solid, -1, 1).isin(".", "!", "?"), 1).otherwise(0)
    initial = F.substring("role", 1, 1)
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    light = rows.select("conv_id", "turn", "key", fault.alias("fault"), place.alias("place"))
    none = conv_ids.select(F.col("conv_id").cast("string").alias("conv_id"), *(F.lit(None).cast(light.schema[c].dataType).alias(c) for c in ("turn", "key", "fault", "place"))).distinct()
    ordered = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "key")
    alike = Window.partitionBy("conv_id", "key").orderBy(F.col("turn").asc_nulls_first())
    each = light.unionByName(none).repartition("conv_id").withColumns({"copy": F.row_number().over(alike), "before": F.lag("turn").over(ordered), "at": F.row_number().over(ordered)})
    fault = F.when((F.col("fault") < 2) & (F.col("copy") > 1), 3).otherwise(F.col("fault"))
    sign = F.substring(F.lit(SIGNS), 4 * fault + F.col("place") + 1, F.lit(1))
    listed = F.array_sort(F.collect_list(F.when(F.col("key").isNotNull(), F.struct("at", sign.alias("sign")))))
    fresh = F.col("turn").isNotNull() & (F.col("before").isNull() | (F.col("before") != F.col("turn")))
    gaps = F.max("turn") - F.min("turn") + 1 - F.sum(fresh.cast("long"))
    return each.groupBy("conv_id").agg(F.array_join(F.transform(listed, lambda x: x["sign"]), "").alias("signature"), F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"))


def solved(signs: DataFrame) -> DataFrame:
    """(signature, n, blank, duplicate, truncated, illegal, cost, audit) of each distinct signature; n: how many have it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(s, n, *counted(s), *solve(s)) for s, n in zip(b["signature"], b["n"], strict=True)]
            yield pd.DataFrame(rows, columns=["signature", "n", *COUNTS, "cost", "audit"])

    sums = signs.groupBy("signature").agg(F.count(F.lit(1)).alias("n"))
    return sums.mapInPandas(run, f"signature string, n long, {', '.join(f'{c} long' for c in COUNTS)}, cost long, audit string")


def audits(rows: DataFrame, conv_ids: DataFrame | None = None) -> DataFrame:
    """(conv_id as text, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation. Eager: it stores signatures and what solves them."""
    spark = rows.sparkSession
    signs = stored(signatures(_prepared(rows), rows if conv_ids is None else conv_ids), shared_dir(spark, "signatures"))
    known = stored(solved(signs), shared_dir(spark, "audits"))
    total = signs.count()
    # of signatures that more than one in HOT_SHARE conversations have there are fewer than HOT_SHARE
    hot = [r[0] for r in known.where(F.col("n") * HOT_SHARE > total).select(F.xxhash64("signature")).collect()]
    salted = F.xxhash64("signature").isin(hot) if hot else F.lit(False)
    left = signs.withColumn("salt", F.when(salted, F.pmod(F.xxhash64("conv_id"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    right = known.drop("n").withColumn("salt", F.explode(F.when(salted, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, ["signature", "salt"]).select("conv_id", "gaps", *COUNTS, "cost", "audit")


def _streamed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Every conversation's audit, then its rows in order; all as text, but what orders them."""
    own = _prepared(rows).withColumn("kind", F.lit(1))
    head = found.select("conv_id", F.lit(0).alias("kind"), *(F.col(c).cast("string").alias(c) for c in FIGURES))
    return head.unionByName(own, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.col("turn").asc_nulls_first(), "key").drop("turn", "key")


def _conversations(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, Iterator[tuple[str, str]]]]:
    """(conv_id and figures, rows) one conversation after the other; its rows are read as they are asked for."""
    stream = (r for b in batches for r in zip(b["kind"].tolist(), *(b[c].tolist() for c in ("role", "text", "conv_id", *FIGURES)), strict=True))
    head = next(stream, None)

    def rows() -> Iterator[tuple[str, str]]:
        nonlocal head
        for r in stream:
            if r[0] == 0:
                head = r
                return
            yield r[1], r[2]
        head = None

    while head is not None:
        own = rows()
        yield head[3:], own
        for _ in own:  # what the reader left
            pass


def repair_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the repaired messages of each conversation, places from 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = lambda x: pd.DataFrame(x, columns=["conv_id", "place", "role", "text"])
        out, size = [], 0
        for (conv_id, *_, audit), own in _conversations(batches):
            for place, (role, text) in enumerate(replay(audit, own)):
                out.append((conv_id, place, role, text))
                size += len(text)
                if len(out) >= 5000 or size >= FLUSH_CHARS:
                    yield frame(out)
                    out, size = [], 0
        if out:
            yield frame(out)

    kind = dict(rows.dtypes)["conv_id"]
    out = _streamed(rows, audits(rows)).mapInPandas(run, "conv_id string, place long, role string, text string")
    return out.withColumn("conv_id", F.col("conv_id").cast(kind))


def audit_conversations(rows: DataFrame, conv_ids: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation of rows, or of conv_ids.

    The digest is of the repaired messages' `role:text`, joined by newlines.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for head, own in _conversations(batches):
            sha, between = hashlib.sha256(), ""
            for role, text in replay(head[-1], own):
                sha.update(f"{between}{role}:{text}".encode("utf-8", "surrogatepass"))
                between = "\n"
            out.append((*head, sha.hexdigest()))
            if len(out) >= 5000:
                yield pd.DataFrame(out, columns=["conv_id", *FIGURES, "repaired_sha256"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["conv_id", *FIGURES, "repaired_sha256"])

    kind = dict((rows if conv_ids is None else conv_ids).dtypes)["conv_id"]
    out = _streamed(rows, audits(rows, conv_ids)).mapInPandas(run, "conv_id string, " + ", ".join(f"{c} string" for c in FIGURES) + ", repaired_sha256 string")
    return out.select(F.col("conv_id").cast(kind).alias("conv_id"), *(F.col(c).cast("long").alias(c) for c in FIGURES[:-1]), "audit", "repaired_sha256")


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with known faults, by crc32(`conv_id:turn`) % 20: 0 drops a row, 1 empties its text, 2 takes its `.!?`, 3 repeats it, 4 makes its role user."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), lot.alias("lot")).where("lot <> 0")
    text = F.when(F.col("lot") == 1, "").when(F.col("lot") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("lot") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("lot") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_again")).drop("_again")
