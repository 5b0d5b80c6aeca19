"""Column functions of names, paths, JSON and colours."""

from __future__ import annotations

import json
from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Compartments of neuron trees by type code (fixed values).
COMPARTMENTS = {0: "undefined", 1: "soma", 2: "axon", 3: "basal_dendrite", 4: "apical_dendrite"}


def inline_lookup(document: Column, name: str) -> Column:
    """A number of a flat JSON object without parsing it whole; 0 where it is missing. Dots in names are fine."""
    escaped = "".join("\\" + c if c in r"\.[]{}()*+?^$|/" else c for c in name)
    found = F.regexp_extract(document, f'"{escaped}"\\s*:\\s*(-?[0-9.eE+]+)', 1)
    return F.coalesce(F.when(found != "", found).try_cast("double"), F.lit(0.0))


def kind(value: Column) -> Column:
    """The narrowest of bool, int64, float64 and string that text reads as."""
    return (
        F.when(F.lower(value).isin("true", "false"), "bool")
        .when(value.rlike(r"^\s*[+-]?[0-9]+\s*$") & value.try_cast("bigint").isNotNull(), "int64")
        .when(value.try_cast("double").isNotNull(), "float64")
        .otherwise("string")
    )


def column_kind(values: Column) -> Column:
    """Aggregates ``kind`` over a column: one kind, float64 for ints and floats, string for anything mixed or empty."""
    kinds = F.collect_set(F.when(values.isNotNull(), kind(values)))  # at most four values
    return (
        F.when(F.size(kinds) == 1, F.element_at(kinds, 1))
        .when((F.size(kinds) == 2) & F.array_contains(kinds, "int64") & F.array_contains(kinds, "float64"), "float64")
        .otherwise("string")
    )


def tile_path(*parts: Column, extension: str = "") -> Column:
    return F.concat(F.concat_ws("/", *[p.cast("string") for p in parts]), F.lit(extension))


def tile_of(path: Column) -> Column:
    """A file's path without its number among the files of its tile."""
    return F.regexp_replace(path, r"-\d+(\.\w+)$", "$1")


def parse_tile_path(path: Column, dims: int = 2) -> list[Column]:
    """zoom and tile numbers from .../z/x/y[/d].ext; null where the path has another form."""
    pattern = "(?:^|/)" + "/".join(["([0-9]+)"] * (dims + 1)) + r"(?:\.[A-Za-z0-9]+)*$"
    return [F.regexp_extract(path, pattern, i + 1).try_cast("int") for i in range(dims + 1)]


def parse_hive_path(path: Column, names: list[str]) -> list[Column]:
    """Whole numbers of name=value folders; null where they are missing or no number."""
    return [F.regexp_extract(path, f"(?:^|/){n}=(-?[0-9]+)(?:/|$)", 1).try_cast("int") for n in names]


def is_dated(name: Column) -> Column:
    """Whether a folder's name is a date, yyyy-mm-dd, by its form alone."""
    return name.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")


def epoch_millis(day: Column) -> Column:
    """Milliseconds from 1970-01-01 to the start of a date in UTC, whatever the session's zone, as text."""
    return (F.unix_date(day).cast("long") * 86_400_000).cast("string")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def neuron_name(path: Column) -> Column:
    """The stem without a trailing .CNG in any case."""
    return F.regexp_replace(stem(path), r"(?i)\.cng$", "")


def display_name(ident: Column, *names: Column) -> Column:
    """The first name there is, with the id in brackets unless the name holds it; the id alone without names."""
    text = ident.cast("string")
    name = F.coalesce(*[F.when(F.trim(n) != "", n) for n in names])
    return F.when(name.isNull(), text).when(F.contains(name, text), name).otherwise(F.concat(name, F.lit(" ("), text, F.lit(")")))


def compartment(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in COMPARTMENTS.items() for x in pair])
    return F.coalesce(F.element_at(names, code.cast("int")), F.concat(F.lit("type_"), code.cast("string")))


def label(name: Column) -> Column:
    """a_b becomes A B."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def hex_colour(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *[F.lower(F.lpad(F.hex(c.cast("long")), 2, "0")) for c in (r, g, b)])


def rgb(colour: Column) -> Column:
    """[r, g, b] of #rrggbb."""
    text = F.ltrim(colour, F.lit("#"))
    return F.array(*[F.conv(F.substring(text, i, 2), 16, 10).cast("int") for i in (1, 3, 5)])


def hashed_colour(name: Column) -> Column:
    """A colour that a name always gets."""
    code = F.crc32(name.cast("binary"))
    return F.concat(F.lit("#"), F.lower(F.lpad(F.hex(code % F.lit(1 << 24)), 6, "0")))


def jet(share: Column) -> Column:
    """A blue-green-red ramp over the cube root of a share in [0, 1]: [r, g, b] in 0..255."""
    t = F.cbrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))
    part = lambda centre: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.5 - F.abs(4 * t - centre))) * 255 + 0.5).cast("int")
    return F.array(part(3.0), part(2.0), part(1.0))


def url_state(state: dict, base: str = "") -> str:
    """A viewer's state as the fragment of a URL."""
    return f"{base}#!{quote(json.dumps(state, separators=(',', ':')), safe='')}"
