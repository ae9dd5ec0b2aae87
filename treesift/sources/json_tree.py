"""JSON of any depth as rows, by variants and a recursive query.

Spark works a recursive query out level by level, each level from the one before, so
a tree's depth costs levels and no row is walked by Python.  The session's limits of
levels and rows of such queries are lifted, as they would cut deep or large trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _without_limits(spark: SparkSession) -> None:
    for name in ("spark.sql.cteRecursionLevelLimit", "spark.sql.cteRecursionRowLimit"):
        spark.conf.set(name, "-1")


def nested(trees: DataFrame, child: str = "$") -> DataFrame:
    """(repo_id, path, depth, name, item) of every entry of the objects ``tree`` (repo_id,
    path, tree), and of the objects at ``child`` of each entry, to any depth; ``item`` is a variant."""
    _without_limits(trees.sparkSession)
    below = "e.item" if child == "$" else f"try_variant_get(e.item, '{child}', 'variant')"
    return trees.sparkSession.sql(
        f"""WITH RECURSIVE e(repo_id, path, depth, name, item) AS (
              SELECT t.repo_id, t.path, 1, x.key, x.value FROM {{trees}} t, LATERAL variant_explode(t.tree) x WHERE x.key IS NOT NULL
              UNION ALL
              SELECT e.repo_id, e.path, e.depth + 1, x.key, x.value FROM e, LATERAL variant_explode({below}) x WHERE x.key IS NOT NULL
            ) SELECT * FROM e""",
        trees=trees.select("repo_id", "path", "tree").where("tree is not null"),
    )


def entries_below(tree: Column, text: Column, child: str, field: str) -> Column:
    """An array of (name, value) of every entry of the object ``tree``, and of the objects at ``child``
    of each entry, to any depth; ``value`` is the string at ``field`` of an entry.  ``tree`` is parsed from ``text``.

    The row's own array is walked level by level: nothing is shuffled, and the entries, which
    share the names in a tree, are never written.  No tree is deeper than its text has braces;
    levels after the last one only pass on what there is."""
    below = lambda v, path: F.map_entries(F.try_variant_get(v, path, "map<string,variant>"))
    said = lambda e: F.struct(e["key"].alias("name"), F.try_variant_get(e["value"], field, "string").alias("value"))

    def step(acc: Column, level: Column) -> Column:
        further = F.flatten(F.filter(F.transform(acc["open"], lambda e: below(e["value"], child)), lambda x: x.isNotNull()))
        return F.when(F.size(acc["open"]) == 0, acc).otherwise(F.struct(F.concat(acc["done"], F.transform(acc["open"], said)).alias("done"), further.alias("open")))

    none = F.array().cast("array<struct<name: string, value: string>>")
    first = F.struct(none.alias("done"), below(tree, "$").alias("open"))
    levels = F.sequence(F.lit(1), F.greatest(F.length(text) - F.length(F.replace(text, F.lit("{"))), F.lit(1)))
    walked = F.aggregate(levels, first, step, lambda acc: acc["done"])
    return F.when(F.try_variant_get(tree, "$", "map<string,variant>").isNotNull(), walked).otherwise(none)


def fields(documents: DataFrame, known: list[str] | None = None) -> DataFrame:
    """(id, field) of every field in the JSON of ``documents`` (id, json): objects' fields by
    ``.name``, elements of arrays by ``[]``.  With ``known`` only fields below known ones are looked into."""
    _without_limits(documents.sparkSession)
    into = "" if known is None else f"AND e.field IN ({', '.join(repr(k) for k in known)})"
    return documents.sparkSession.sql(
        f"""WITH RECURSIVE e(id, field, item) AS (
              SELECT d.id, '$', try_parse_json(d.json) FROM {{documents}} d
              UNION ALL
              SELECT e.id, concat(e.field, coalesce(concat('.', x.key), '[]')), x.value FROM e, LATERAL variant_explode(e.item) x WHERE true {into}
            ) SELECT id, field FROM e WHERE field <> '$'""",
        documents=documents.select("id", "json"),
    )


def is_json(text: Column) -> Column:
    """Whether a text is one JSON value and nothing else.  The parser stops where a value ends;
    what comes after it can't close both a list and an object that are put around."""
    listed = F.size(F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")) == 1
    return F.coalesce(listed & F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}"))).isNotNull(), F.lit(False))


def strict_problems(documents: DataFrame, known: list[str]) -> DataFrame:
    """(id, field, problem) of ``documents`` (id, json) that a strict reader refuses: what is not
    JSON as a whole, with nothing after it, and each field that is not ``known`` (as in ``fields``)."""
    unread = documents.where(~is_json(F.col("json"))).select("id", F.lit("$").alias("field"), F.lit("not JSON").alias("problem"))
    unknown = fields(documents.where(is_json(F.col("json"))), ["$", *known]).where(~F.col("field").isin(*known)).distinct()
    return unread.unionByName(unknown.select("id", "field", F.lit("unknown field").alias("problem")))
