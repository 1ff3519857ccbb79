"""Prompt templates: small mappings of texts with placeholders in braces, compiled to column expressions.

A format such as `title: {title}{year_text}` is read once, on the driver; what comes out is one concat() over an item's fields, so prompts are made
in the JVM without a Python worker. An unknown placeholder, a positional one or a stray brace is an error when the template is compiled, not when the job
runs. Doubled braces are braces.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from string import Formatter

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from rankweave.operators.prompts import HISTORY_HEADER, MARKER_INSTRUCTION, MARKERS
from rankweave.sources.readers import exists

# The wording and the layout of the template that stands where none is named.
DEFAULT = {
    "name": "marker",
    "instruction": MARKER_INSTRUCTION,
    "history_header": HISTORY_HEADER,
    "history_item_format": "title: {title}{year_text}{rating_text}{genres_text}",
    "candidate_item_format": "{title}{year_text}{genres_text}",
    "candidate_separator": "",
}
FIELDS = ("item_id", "title", "year", "rating", "genres", "year_text", "rating_text", "genres_text")
FORMATS = ("history_item_format", "candidate_item_format")


def load_template(spark: SparkSession, name_or_path: str | None = None) -> dict:
    """The template of a name or a JSON file (its ending may be left out), checked; what it doesn't say is as in the default."""
    if name_or_path in (None, DEFAULT["name"]):
        return dict(DEFAULT)
    last = name_or_path.rsplit("/", 1)[-1]
    paths = [name_or_path] if "." in last else [name_or_path, f"{name_or_path}.json"]
    path = next((p for p in paths if exists(spark, p)), None)
    if path is None:
        raise FileNotFoundError(f"no such prompt template: {name_or_path}")
    said = json.loads(spark.read.text(path, wholetext=True).first()[0])
    if not isinstance(said, dict):
        raise ValueError(f"{path} doesn't hold a JSON object")
    template = DEFAULT | said
    for key in FORMATS:
        parse_format(template[key])
    return template


def parse_format(text: str) -> list[tuple[str, str | None]]:
    """(text, placeholder after it) in order."""
    out = []
    for before, name, spec, conversion in Formatter().parse(text):
        if name is not None and name not in FIELDS:
            raise ValueError(f"{text!r} has the placeholder {{{name}}}; there are {', '.join(FIELDS)}")
        if spec or conversion:
            raise ValueError(f"{text!r} formats the placeholder {{{name}}}; only its name may be given")
        out.append((before, name))
    return out


def item_fields(item: Column, fields: list[str]) -> dict[str, Column]:
    """Columns of an item (a struct with some of item_id, title, year, rating, genres) under the names of placeholders; what is null or nothing has no text."""
    of = lambda name: item[name] if name in fields else F.lit(None)
    text = lambda name: F.coalesce(of(name).cast("string"), F.lit(""))
    some = lambda value: ~value.isin("", "0", "0.0")
    genres = F.coalesce(F.array_join(of("genres"), ", "), F.lit("")) if "genres" in fields else F.lit("")
    return {
        "item_id": F.coalesce(of("item_id").cast("string"), F.lit("0")),
        "title": text("title"),
        "year": text("year"),
        "rating": text("rating"),
        "genres": genres,
        "year_text": F.when(some(text("year")), F.concat(F.lit(" ("), text("year"), F.lit(")"))).otherwise(""),
        "rating_text": F.when(some(text("rating")), F.concat(F.lit(", rating: "), text("rating"))).otherwise(""),
        "genres_text": F.when(genres != "", F.concat(F.lit(", genres: "), genres)).otherwise(""),
    }


def formatted(text: str, item: Column, fields: list[str]) -> Column:
    """A format over one item."""
    values = item_fields(item, fields)
    parts = [x for before, name in parse_format(text) for x in ([F.lit(before)] if before else []) + ([values[name]] if name else [])]
    return F.concat(*parts) if parts else F.lit("")


def templated_prompt(history: Column, candidates: Column, template: Mapping, fields: list[str], markers: tuple[str, str, str, str] = MARKERS) -> Column:
    """The marker prompt of a template. history and candidates are arrays of items, candidates in the order they are shown; a null history is empty."""
    start, end, item, over = map(F.lit, markers)
    # the whole history is one part of the prompt: one without text leaves no line
    past = F.coalesce(F.array_join(F.transform(history, lambda h: formatted(template["history_item_format"], h, fields)), "\n"), F.lit(""))
    past = F.filter(F.array(past), lambda x: x != "")
    shown = F.flatten(F.transform(candidates, lambda c: F.array(item, formatted(template["candidate_item_format"], c, fields), over, F.lit(template["candidate_separator"]))))
    head = [start, F.lit(template["instruction"]), F.lit("")] + ([F.lit(template["history_header"])] if template["history_header"] else [])
    return F.array_join(F.concat(F.array(*head), past, F.array(end, F.lit("")), shown), "\n")
