"""Prompt texts as column expressions. Items are structs with title, year, rating and genres (array); nulls and empties vanish."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The wording of prompts.
MARKER_INSTRUCTION = "Given the user's interaction history, rank the candidate items according to the user's preferences."
HISTORY_HEADER = "User history:"
LIST_INSTRUCTION = "You are a ranking assistant. Rank the candidate items for the user based on the user history."
NO_HISTORY = "No user history is available."
CANDIDATES_HEADER = "Candidate items:"
RANK_ALL = "Rank all candidate items from most to least relevant."
RANK_SOME = "Return only the top {} {}, ordered from most to least relevant."
ANSWER = "Return only JSON in this format: "
MARKERS = ("[SPAN]", "[/SPAN]", "[ITEM]", "[/ITEM]")


def _optional(before: str, value: Column, after: str = "") -> Column:
    text = value.cast("string")
    return F.when(value.isNotNull() & ~text.isin("", "0", "0.0"), F.concat(F.lit(before), text, F.lit(after))).otherwise("")


def item_text(item: Column, prefix: str = "", rating: bool = False) -> Column:
    genres = F.array_join(item["genres"], ", ")
    return F.concat(F.lit(prefix), F.coalesce(item["title"], F.lit("")), _optional(" (", item["year"], ")"), _optional(", rating: ", item["rating"]) if rating else F.lit(""), _optional(", genres: ", genres))


def marker_prompt(history: Column, candidates: Column) -> Column:
    """candidates already in the order they are shown."""
    start, end, item, over = map(F.lit, MARKERS)
    past = F.transform(history, lambda h: item_text(h, "title: ", True))
    shown = F.flatten(F.transform(candidates, lambda c: F.array(item, item_text(c), over, F.lit(""))))
    return F.array_join(F.concat(F.array(start, F.lit(MARKER_INSTRUCTION), F.lit(""), F.lit(HISTORY_HEADER)), past, F.array(end, F.lit("")), shown), "\n")


def list_prompt(history: Column, candidates: Column, labels: Column, count: int | None = None) -> Column:
    """labels: C and the candidate's number, one for each of candidates; count: ask for so many only."""
    past = F.transform(history, lambda h: item_text(h, "", True))
    past = F.when(F.size(past) > 0, past).otherwise(F.array(F.lit(NO_HISTORY)))
    shown = F.zip_with(labels, candidates, lambda n, c: F.concat(F.lit("["), n, F.lit("] "), item_text(c)))
    n = F.size(labels) if count is None else F.least(F.lit(count), F.size(labels))
    quoted = lambda x: F.concat(F.lit('{"rank_order": ["'), F.array_join(x, '", "'), F.lit('"]}'))
    some = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("C<number-"), i.cast("string"), F.lit(">")))
    before, after = RANK_SOME.split("{}", 1)[0], RANK_SOME.rsplit("{}", 1)[1]
    ask = F.when(n == F.size(labels), F.lit(RANK_ALL)).otherwise(F.concat(F.lit(before), n.cast("string"), F.when(n == 1, " item").otherwise(" items"), F.lit(after)))
    example = F.when(n == F.size(labels), quoted(labels)).otherwise(quoted(some))
    return F.array_join(F.concat(F.array(F.lit(LIST_INSTRUCTION), F.lit(""), F.lit(HISTORY_HEADER)), past, F.array(F.lit(""), F.lit(CANDIDATES_HEADER)), shown, F.array(F.lit(""), ask, F.concat(F.lit(ANSWER), example, F.lit(".")))), "\n")
