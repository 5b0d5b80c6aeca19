"""Properties: attaching, gating, dropping and renaming tags; what keys there are; which become facets."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lower-cased prefixes of control features (fixed values).
CONTROLS = ("negcontrol", "blank", "antisense", "deprecated", "unassigned")


def attach(features: DataFrame, attributes: DataFrame, key: str, other: str | None = None) -> DataFrame:
    """Left outer join by id. The planner broadcasts the attributes if they are small enough, and sorts otherwise."""
    other = other or key
    right = attributes.withColumnRenamed(other, "_key") if other == key else attributes.withColumn("_key", F.col(other)).drop(other)
    return features.join(right, features[key] == right["_key"], "left").drop("_key")


def merge_maps(left: Column, right: Column) -> Column:
    """Two tag maps in one; the right one wins. No session setting is needed, as keys are made distinct first."""
    left, right = (F.coalesce(m, F.create_map().cast("map<string,string>")) for m in (left, right))
    return F.map_concat(F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k)), right)


def attach_maps(features: DataFrame, attributes: DataFrame, key: str, tags: str = "tags", more: str = "more") -> DataFrame:
    """Adds a table of (key, more map<string,string>) to the tags of features; a missing match adds nothing."""
    return attach(features, attributes, key).withColumn(tags, merge_maps(F.col(tags), F.col(more))).drop(more)


def zoom_gate(tags: Column, zoom: Column, gates: dict[str, int]) -> Column:
    """Drops keys at zooms below their gate."""
    closed = F.array(*[F.when(zoom < least, F.lit(key)) for key, least in gates.items()]) if gates else F.array().cast("array<string>")
    return F.map_filter(tags, lambda k, v: ~F.coalesce(F.array_contains(F.array_compact(closed), k), F.lit(False)))


def without(tags: Column, keys: list[str]) -> Column:
    return F.map_filter(tags, lambda k, v: ~k.isin(keys)) if keys else tags


def renamed(tags: Column, old: str, new: str) -> Column:
    return F.transform_keys(tags, lambda k, v: F.when(k == old, F.lit(new)).otherwise(k))


def known(tags: Column) -> Column:
    """Null values go, as tiles have no null."""
    return F.map_filter(tags, lambda k, v: v.isNotNull())


def stringified(tags: Column) -> Column:
    return F.transform_values(tags, lambda k, v: v.cast("string"))


def serialised(tags: Column) -> Column:
    """Tags as text in the order of keys: comparable and groupable, which maps are not."""
    entries = F.array_sort(F.map_entries(tags))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"].cast("string"), F.lit("")))), ";")


def scalar_tags(json: Column) -> Column:
    """The scalar members of a JSON object as a map of strings; nulls, arrays and objects go."""
    return F.map_filter(F.from_json(json, "map<string,string>"), lambda k, v: v.isNotNull() & ~F.substring(F.ltrim(v), 1, 1).isin("{", "["))


def quality_filter(df: DataFrame, name: str, quality: str | None = None, least: float = 20.0) -> DataFrame:
    """Rows of sufficient quality whose feature isn't a control."""
    df = df.where(~F.lower(F.col(name).cast("string")).rlike(f"^({'|'.join(CONTROLS)})"))
    return df.where(F.col(quality) >= least) if quality else df


def numeric_filter(df: DataFrame, column: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """low <= number <= high; what is no number goes, NaN too; either side may be open."""
    v = F.col(column).try_cast("double")
    ok = v.isNotNull() & ~F.isnan(v)
    ok = ok & (v >= low) if low is not None else ok
    return df.where(ok & (v <= high) if high is not None else ok)


def category_filter(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Value among ``values``; null counts as empty text; no values at all means no filter."""
    return df.where(F.coalesce(F.col(column).cast("string"), F.lit("")).isin(values)) if values else df


def name_search(df: DataFrame, column: str, part: str) -> DataFrame:
    """Case-insensitive substring."""
    return df.where(F.contains(F.lower(column), F.lower(F.lit(part))))


def pick_alias(columns: list[str], candidates: list[str]) -> str:
    """The first candidate that a table has, in any case; KeyError if none."""
    by = {c.lower(): c for c in reversed(columns)}
    for c in candidates:
        if c.lower() in by:
            return by[c.lower()]
    raise KeyError(candidates)


def entries(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, name, value) rows of the named columns as text."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(key, pairs.alias("e")).select(key, "e.name", "e.value")


def map_entries_of(df: DataFrame, key: str, tags: str) -> DataFrame:
    return df.select(key, F.explode(F.col(tags)).alias("name", "value"))


def filterable(rows: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """name, kind, n_distinct of the names a viewer can filter by: numeric if every value is a number, categorical
    otherwise; names with one value or none, and ids, are skipped. Exact; distinct counts shuffle (name, value)."""
    number = F.col("value").try_cast("double")
    found = rows.where(F.col("value").isNotNull() & ~F.col("name").isin(*skip)).groupBy("name").agg(
        F.count_distinct("value").alias("n_distinct"), F.bool_and(number.isNotNull()).alias("numeric"), F.min(number).alias("low"), F.max(number).alias("high"))
    return found.where("n_distinct > 1").select("name", F.when(F.col("numeric"), "numeric").otherwise("categorical").alias("kind"), "n_distinct", "low", "high")


def property_ranges(rows: DataFrame, most: int | None = None) -> DataFrame:
    """name, kind (Number beats String), low, high and, for strings, their sorted distinct values: all, or
    the smallest ``most``."""
    number = F.col("value").try_cast("double")
    own = rows.where("value is not null")
    stats = own.groupBy("name").agg(F.bool_or(number.isNotNull()).alias("numeric"), F.min(number).alias("low"), F.max(number).alias("high"))
    texts = own.where(number.isNull()).select("name", "value").distinct()
    if most is not None:  # cut before they meet
        texts = texts.withColumn("_n", F.row_number().over(Window.partitionBy("name").orderBy("value"))).where(F.col("_n") <= most)
    enums = texts.groupBy("name").agg(F.array_join(F.sort_array(F.collect_list("value")), ",").alias("enums"))
    return stats.join(enums, "name", "left").select("name", F.when(F.col("numeric"), "Number").otherwise("String").alias("kind"), "low", "high", "enums")


def cardinality(df: DataFrame, columns: list[str]) -> DataFrame:
    """name, n_distinct of non-null values, numeric (by the column's type): one pass, one row a column."""
    kinds = dict(df.dtypes)
    row = df.agg(*[F.count_distinct(c).alias(c) for c in columns])
    parts = [F.struct(F.lit(c).alias("name"), F.col(c).alias("n_distinct"), F.lit(bool(re.match("tinyint|smallint|int|bigint|float|double|decimal", kinds[c]))).alias("numeric")) for c in columns]
    return row.select(F.explode(F.array(*parts)).alias("c")).select("c.*")


def glob(pattern: str) -> str:
    """A shell glob as a regular expression: *, ?, [set] and [!set]."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2)
        if c == "[" and close > 0:
            body = pattern[i + 1 : close].replace("\\", "\\\\")
            out += f"[{'^' + body[1:] if body[0] == '!' else body}]"
            i = close
        else:
            out += ".*" if c == "*" else "." if c == "?" else re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def matches_any(name: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | name.rlike(glob(p))
    return out


@dataclass
class FacetPolicy:
    """Which columns leave the tiles for a facet store."""

    key: str = "cell_id"
    keep_inline: list[str] = field(default_factory=list)
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    threshold: int = 64

    @classmethod
    def from_config(cls, config: dict | None) -> FacetPolicy:
        return cls(**{k: v for k, v in (config or {}).items() if k in cls.__dataclass_fields__})


def facet_keys(columns: DataFrame, policy: FacetPolicy) -> DataFrame:
    """Adds ``facet`` to rows (name, n_distinct, numeric): the key, inline and excluded names stay; then included
    globs, and numeric columns of more values than the threshold, are facets."""
    n = F.col("name")
    stays = (n == policy.key) | n.isin(*policy.keep_inline) if policy.keep_inline else n == policy.key
    stays = stays | matches_any(n, policy.exclude)
    takes = matches_any(n, policy.include) | (F.col("numeric") & (F.col("n_distinct") > policy.threshold))
    return columns.withColumn("facet", ~stays & takes)
