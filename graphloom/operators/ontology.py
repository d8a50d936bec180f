"""Ontologies: one made of several, first definitions first, with their properties united."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = (
    "entities map<string,struct<description:string,properties:map<string,string>,key_property:string>>, "
    "relationships map<string,struct<description:string,domain:string,range:string,properties:array<string>>>")  # fmt: skip
#: fixed values: when User is shared by views and Post is known, this links them
BRIDGE = ("User", "Post", "POSTED", ("Who", "Says What"), "Links users to their content")


def parse(rows: DataFrame, json_col: str = "ontology") -> DataFrame:
    """``rows`` with the columns entities and relationships from JSON text; text that isn't such JSON has none of either."""
    j = F.from_json(json_col, SCHEMA)
    return rows.withColumns({"entities": j["entities"], "relationships": j["relationships"]})


def mini_ontology(entities: Column, properties: Column, relationships: Column, view: Column) -> dict[str, Column]:
    """The columns entities and relationships of a view's small ontology, from its lists of names."""
    props = F.map_from_arrays(F.array_distinct(properties), F.transform(F.array_distinct(properties), lambda _: F.lit("type_definition")))
    entity = lambda e: F.struct(F.concat(e, F.lit(" in the context of "), view).alias("description"), props.alias("properties"), F.get(properties, F.lit(0)).alias("key_property"))
    first = F.get(entities, F.lit(0))
    relation = lambda r: F.struct(
        F.concat(r, F.lit(" relationship for "), view).alias("description"), first.alias("domain"), F.coalesce(F.get(entities, F.lit(1)), first).alias("range"),
        F.array(F.lit("timestamp"), F.lit("strength"), F.lit("confidence")).alias("properties"))
    of = lambda names, f: F.map_from_arrays(F.array_distinct(names), F.transform(F.array_distinct(names), f))
    return {"entities": of(entities, entity), "relationships": of(relationships, relation)}


def unify_entities(views: DataFrame, by: list[str], place: str = "place") -> DataFrame:
    """by, name, description, key_property, properties, n_views, shared, place: each entity once, as its first view defines it.

    ``views`` (by, place, view, entities) is one row a view; ``place`` is their order. Properties of all views are united; where several views
    define one, the last definition stays. ``shared``: more than one view has the entity. Null names are left out. One row of
    definitions is looked at at a time, so a type in any number of views is a sum, not a list.
    """
    e = views.select(*by, F.col(place).alias("place"), F.explode("entities").alias("name", "d")).filter("name is not null")
    first = e.groupBy(*by, "name").agg(F.min_by(F.struct("d.description", "d.key_property"), "place").alias("f"), F.count("*").alias("n_views"), F.min("place").alias("place"))
    p = e.select(*by, "name", "place", F.explode("d.properties").alias("property", "kind")).groupBy(*by, "name", "property").agg(F.max_by("kind", "place").alias("kind"))
    p = p.groupBy(*by, "name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("property", "kind")))).alias("properties"))
    out = first.join(p, [*by, "name"], "left")
    return out.select(*by, "name", "f.description", "f.key_property", F.coalesce("properties", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("properties"), "n_views", (F.col("n_views") > 1).alias("shared"), "place")


def unify_relationships(views: DataFrame, by: list[str], place: str = "place") -> DataFrame:
    """by, name, description, domain, range, properties, place: each relationship as the first view that has it defines it."""
    r = views.select(*by, F.col(place).alias("place"), F.explode("relationships").alias("name", "d")).filter("name is not null")
    first = r.groupBy(*by, "name").agg(F.min_by("d", "place").alias("d"), F.min("place").alias("place"))
    return first.select(*by, "name", "d.description", "d.domain", "d.range", "d.properties", "place")


def bridges(entities: DataFrame, by: list[str]) -> DataFrame:
    """by, name, connects, description: relationships that tie views together, where several share the user and any has the post."""
    user, post, name, connects, text = BRIDGE
    seen = entities.groupBy(*by).agg(F.max((F.col("name") == user) & F.col("shared")).alias("u"), F.max(F.col("name") == post).alias("p")).filter("u and p")
    return seen.select(*by, F.lit(name).alias("name"), F.array(*map(F.lit, connects)).alias("connects"), F.lit(text).alias("description"))
