"""Counts, profiles, hierarchies and text sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import clusters


def count_by_element(df: DataFrame, array_col: str) -> DataFrame:
    """(element, texts) over all elements of an array column."""
    return df.select(F.explode(array_col).alias("element")).groupBy("element").agg(F.count("*").alias("texts"))


def explode_pair(df: DataFrame, a: str, b: str) -> DataFrame:
    """Every pair of elements of two arrays of the same row."""
    return df.withColumn(a, F.explode(a)).withColumn(b, F.explode(b))


def count_by_pair(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, texts); array columns are counted by element."""
    kinds = dict(df.dtypes)
    for c in (a, b):
        if kinds[c].startswith("array"):
            df = df.withColumn(c, F.explode(c))
    return df.groupBy(a, b).agg(F.count("*").alias("texts"))


def ordered_tuples(df: DataFrame, key: str, columns: Sequence[str], order: Sequence[str], name: str = "items", limit: int | None = None) -> DataFrame:
    """One array of structs a group, ordered by columns (``-c``: descending, numbers only); at most ``limit`` where one is asked for.

    A group's array must fit into a row: it lists a vocabulary, not documents."""
    sort = [(-F.col(o[1:])).alias(f"_{i}") if o.startswith("-") else F.col(o).alias(f"_{i}") for i, o in enumerate(order)]
    items = F.sort_array(F.collect_list(F.struct(*sort, *columns)))
    items = F.transform(items, lambda x: F.struct(*[x[c].alias(c) for c in columns]))
    return df.groupBy(key).agg((items if limit is None else F.slice(items, 1, limit)).alias(name))


def distinct_array(df: DataFrame, key: str, column: str, name: str = "items") -> DataFrame:
    return df.groupBy(key).agg(F.array_sort(F.collect_set(column)).alias(name))


def latest(df: DataFrame, key: str, column: str, default: int = -1) -> DataFrame:
    return df.groupBy(key).agg(F.coalesce(F.max(column), F.lit(default)).alias(column))


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def count_key(df: DataFrame, key: str, value: object) -> DataFrame:
    return df.where(F.col(key) == F.lit(value)).agg(F.count("*").alias("n"))


def two_way_map(df: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """a with its set of b, and b with its set of a."""
    pairs = df.select(a, b).distinct()
    return distinct_array(pairs, a, b), distinct_array(pairs, b, a)


def text_size_stats(df: DataFrame, by: Sequence[str], column: str = "text") -> DataFrame:
    """Texts, characters and grapheme clusters of each group."""
    return df.groupBy(*by).agg(F.count(column).alias("texts"), F.sum(F.length(column)).alias("chars"), F.sum(F.size(clusters(F.col(column)))).alias("clusters"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def worst_severity(violations: DataFrame, key: str = "doc_id") -> DataFrame:
    return violations.groupBy(key).agg(F.max("severity").alias("status"))


def facets(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(facet, value, n) of several columns in one pass over the rows."""
    return df.groupingSets([[c] for c in columns], *columns).agg(F.count("*").alias("n"), F.grouping_id().alias("_g")).select(
        F.coalesce(*[F.when(F.col("_g") == F.lit((1 << len(columns)) - 1 - (1 << len(columns) - 1 - i)), c) for i, c in enumerate(columns)]).alias("facet"),
        F.coalesce(*[F.when(F.col("_g") == F.lit((1 << len(columns)) - 1 - (1 << len(columns) - 1 - i)), F.col(c).cast("string")) for i, c in enumerate(columns)]).alias("value"),
        "n",
    )


def repo_profile(repos: DataFrame, docs: DataFrame, people: DataFrame, langs: DataFrame, scripts: DataFrame) -> DataFrame:
    """Repositories with their number of texts and what is known of people, languages and scripts (each by ``repo``)."""
    out = repos
    for other in (docs, people, langs, scripts):
        out = out.join(other, "repo", "left")
    return out


def person_profile(people: DataFrame, docs: DataFrame, langs: DataFrame, repos: DataFrame) -> DataFrame:
    out = people
    for other in (docs, langs, repos):
        out = out.join(other, "person_id", "left")
    return out


def closure(df: DataFrame, id_col: str, parent_col: str, deepest: int = 64) -> DataFrame:
    """(id, root, depth): every node below each of its ancestors and itself, from an adjacency list.

    A recursive query, for hierarchies of vocabularies: a cycle, or a tree deeper than ``deepest``, ends with an error."""
    links = df.select(F.col(id_col).alias("id"), F.col(parent_col).alias("up"))
    text = """
    WITH RECURSIVE below(id, root, up, depth) MAX RECURSION LEVEL %d AS (
      SELECT id, id AS root, up, 0 AS depth FROM {links}
      UNION ALL
      SELECT b.id, b.up AS root, l.up, b.depth + 1 FROM below b JOIN {links} l ON l.id = b.up)
    SELECT id, root, depth FROM below""" % deepest
    return df.sparkSession.sql(text, links=links)


def children_of(closed: DataFrame, root: object) -> DataFrame:
    return closed.where((F.col("root") == F.lit(root)) & (F.col("depth") == 1)).select("id")


def under_node(df: DataFrame, key: str, closed: DataFrame, root: object) -> DataFrame:
    """Rows whose key is the node or lies below it."""
    inside = closed.where(F.col("root") == F.lit(root)).select(F.col("id").alias(key)).distinct()
    return df.join(inside, key, "left_semi")


def unmapped_owners(owners: DataFrame, git_map: DataFrame) -> DataFrame:
    return owners.join(git_map, "git_name", "left_anti").select("git_name").distinct()
