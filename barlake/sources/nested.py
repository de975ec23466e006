"""Nested JSON payloads of any shape as rows of names and values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Keep = Callable[[DataFrame, str], DataFrame]


def _opened(front: DataFrame) -> DataFrame:
    """(id, path, fields, node, pos, key, text, kind, value) of the members of the front's objects and arrays; kind is the member's, node the parent's."""
    parsed = front.withColumn("v", F.try_parse_json("text")).where("v is not null")
    sql = "select id, path, fields, schema_of_variant(v) as node, pos, key, value as item from {front}, lateral variant_explode(v)"
    members = parsed.sparkSession.sql(sql, front=parsed)
    return members.select("id", "path", "fields", "node", "pos", "key", F.to_json("item").alias("text"), F.schema_of_variant("item").alias("kind"), F.expr("try_variant_get(item, '$', 'string')").alias("value"))


def _is(kind: str, name: str) -> Column:
    return F.startswith(F.col(kind), F.lit(name))


def _unique(names: Column) -> Column:
    """Names of which a repeated one gets its number: a, a_2, a_3."""
    seen = lambda n, i: F.size(F.filter(F.slice(names, 1, i + 1), lambda m: m == n))
    return F.transform(names, lambda n, i: F.when(seen(n, i) == 1, n).otherwise(F.concat(n, F.lit("_"), seen(n, i).cast("string"))))


def flatten(raw: DataFrame, column: str, keep: Keep) -> DataFrame:
    """(id, path, fields) of the objects and table rows in JSON texts (id, column), whatever their shape and depth.

    An object with values of its own gives a row: fields holds them, and those of the objects that it lies in, of equal names the innermost. An array of arrays whose first one holds
    texts alone is a table: that one names the others' values (a name's further ones a_2, a_3), and each gives a row. Other arrays give their members' rows, values in them none.
    path names members and places from the top. Values are text, a nested value of a table row its JSON, null stays null. Texts that are not JSON, or repeat a name in an
    object, give no rows. Each round opens one level of all texts, so there are as many rounds as the deepest has levels. keep(df, name) writes a table and returns it.
    """
    front = keep(raw.select("id", F.lit("").alias("path"), F.col(column).alias("text"), F.create_map().cast("map<string,string>").alias("fields")).where("text is not null"), "payloads")
    out = front.select("id", "path", "fields").limit(0)
    while not front.isEmpty():
        at = keep(_opened(front), "members")
        down = _is("kind", "OBJECT") | _is("kind", "ARRAY")
        inside = at.where(_is("node", "OBJECT"))
        own = inside.where(~down).groupBy("id", "path").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("own"))
        heads = at.where(_is("node", "ARRAY")).groupBy("id", "path").agg(F.bool_and(_is("kind", "ARRAY")).alias("arrays"), F.count(F.lit(1)).alias("n"), F.min_by(F.struct("kind", "text"), "pos").alias("first"))
        heads = heads.where("arrays and n > 1 and first.kind = 'ARRAY<STRING>'").select("id", "path", _unique(F.from_json("first.text", "array<string>")).alias("names"))
        nodes = front.select("id", "path", "fields").join(own.hint("merge"), ["id", "path"])
        merged = F.map_concat(F.map_filter("fields", lambda k, v: ~F.map_contains_key("own", k)), "own")
        found = keep(nodes.select("id", "path", merged.alias("fields")), "objects")
        place = F.concat("path", F.lit("/"), F.coalesce("key", F.col("pos").cast("string")))
        rows = at.where("pos > 0").join(heads.hint("merge"), ["id", "path"])
        values = F.from_json("text", "array<string>")
        both = F.least(F.size("names"), F.size(values))
        row = F.map_from_arrays(F.slice("names", 1, both), F.slice(values, 1, both))
        table = rows.select("id", place.alias("path"), F.map_concat(F.map_filter("fields", lambda k, v: ~F.array_contains("names", k)), row).alias("fields"))
        out = keep(out.unionByName(found).unionByName(table), "flat")
        # children take their object's fields where it has its own
        deeper = at.where(down).join(heads.select("id", "path").hint("merge"), ["id", "path"], "left_anti")
        given = deeper.join(found.select("id", "path", F.col("fields").alias("more")).hint("merge"), ["id", "path"], "left")
        front = keep(given.select("id", place.alias("path"), "text", F.coalesce("more", "fields").alias("fields")), "payloads")
    return out


def flatten_nested(raw: DataFrame, column: str, keep: Keep) -> DataFrame:
    """(id, Path, Name, Value): flatten's fields, one row a name."""
    return flatten(raw, column, keep).select("id", F.col("path").alias("Path"), F.explode("fields").alias("Name", "Value"))
