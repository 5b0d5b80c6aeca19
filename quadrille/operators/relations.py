"""Joins by ids, names and trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_all(base: DataFrame, *others: tuple[DataFrame, str]) -> DataFrame:
    """Left joins of several tables by their key columns; unmatched values are null."""
    for df, key in others:
        base = base.join(df, key, "left")
    return base


def present(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_semi")


def absent(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_anti")


def suffixed(left: DataFrame, right: DataFrame, key: str, suffix: str) -> DataFrame:
    """Left join in which colliding columns of the right table get a suffix."""
    both = set(left.columns) - {key}
    return left.join(right.toDF(*[c + suffix if c in both else c for c in right.columns]), key, "left")


def ontology_keys(terms: DataFrame) -> DataFrame:
    """Lower-cased names and acronyms, and ids, of (id, name, acronym): match -> id. The largest id of equal
    matches wins, names before acronyms."""
    rows = terms.select("id", F.explode(F.array(F.struct(F.lit(2).alias("way"), F.lower("name").alias("match")), F.struct(F.lit(1).alias("way"), F.lower("acronym").alias("match")))).alias("k"))
    rows = rows.select("id", "k.*").where("match is not null")
    return rows.groupBy("match").agg(F.max_by("id", F.struct("way", "id")).alias("id"))


def ontology_match(stems: DataFrame, terms: DataFrame, stem: str = "stem") -> DataFrame:
    """Adds term_id to stems: by name or acronym in any case, else by the digits in the stem as an id."""
    names = ontology_keys(terms).select(F.col("match"), F.col("id").alias("_by_name"))
    ids = terms.select(F.col("id").alias("_by_id")).distinct()
    out = stems.join(names, F.lower(F.col(stem)) == names.match, "left").drop("match")
    digits = F.regexp_replace(stem, "[^0-9]", "").try_cast("bigint")
    out = out.join(ids, digits == F.col("_by_id"), "left")
    return out.withColumn("term_id", F.coalesce("_by_name", "_by_id")).drop("_by_name", "_by_id")


def by_label(labels: DataFrame, properties: DataFrame, label: str = "label", key: str = "key") -> DataFrame:
    """Integer labels joined with properties whose keys are integers or text."""
    right = properties.withColumn("_key", F.trim(F.col(key).cast("string"))).drop(key)
    return labels.join(right, F.col(label).cast("string") == F.col("_key"), "left").drop("_key")


def annotated(bodies: DataFrame, annotations: DataFrame, key: str, columns: list[str], name: str = "annotations") -> DataFrame:
    """Left join of bodies with their annotations, as a map of the columns that hold text other than white space.

    A body without a match has an empty map; one with several rows of annotations gets a row for each.
    """
    filled = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in columns])
    held = F.map_from_entries(F.filter(filled, lambda e: e["value"].isNotNull() & (F.trim(e["value"]) != "")))
    right = annotations.select(F.col(key), held.alias(name))
    return bodies.join(right, key, "left").withColumn(name, F.coalesce(name, F.create_map().cast("map<string,string>")))


def tree_edges(nodes: DataFrame, tree: str = "tree") -> DataFrame:
    """(tree, id, parent) with both ends' columns: the segments of a tree of parent pointers."""
    up = nodes.select(F.col(tree), F.col("id").alias("parent"), *[F.col(c).alias(f"parent_{c}") for c in nodes.columns if c not in (tree, "id", "parent")])
    return nodes.join(up, [tree, "parent"])


def paths(nodes: DataFrame, name: str = "name", parent: str = "parent_id", node: str = "id") -> DataFrame:
    """(id, depth, path) of every node from its root, by a recursive query over the tree table."""
    spark = nodes.sparkSession
    nodes.select(F.col(node).cast("bigint").alias("id"), F.col(parent).cast("bigint").alias("parent_id"), F.col(name).cast("string").alias("name")).createOrReplaceTempView("_quadrille_tree")
    return spark.sql("""
        WITH RECURSIVE up(id, depth, path) AS (
          SELECT id, 0, name FROM _quadrille_tree WHERE parent_id IS NULL
          UNION ALL SELECT t.id, up.depth + 1, concat(up.path, '/', t.name) FROM _quadrille_tree t JOIN up ON t.parent_id = up.id)
        SELECT id, depth, path FROM up""")


def majority(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The commonest value of each key; the smallest of equals. Counts combine before the shuffle."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(key).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(value))


def with_majority(keys: DataFrame, lookup: DataFrame, rows: DataFrame, key: str, value: str) -> DataFrame:
    """A value by lookup, or by majority of a key's rows where the lookup has none."""
    known = lookup.select(key, F.col(value).alias("_known"))
    most = majority(rows, key, value).withColumnRenamed(value, "_most")
    return keys.join(known, key, "left").join(most, key, "left").withColumn(value, F.coalesce("_known", "_most")).drop("_known", "_most")
