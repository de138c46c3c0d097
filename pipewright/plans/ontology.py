"""Semantic layer: entities and relationships bound to tables.

The model is data. Entity views, time series, edges and traversals are built from it as plain
projections and equi-joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipewright.operators.lookups import stacked
from pipewright.tables import Tables

# How a declared value type is stored.
SPARK_TYPES = {
    "String": "string",
    "DateTime": "timestamp_ntz",
    "BigInt": "bigint",
    "Boolean": "boolean",
    "Double": "double",
}


@dataclass(frozen=True)
class Entity:
    """A typed node: properties of one table, its identifier and its display column.

    A property is (name, value type), or (name, value type, column) where the column is named
    differently. An identifier of several columns is a tuple of them. A type that is bound to
    several tables is a tuple of entities.
    """

    name: str
    type_id: str
    table: str
    key: str | tuple[str, ...]
    display: str
    properties: tuple[tuple[str, ...], ...]


@dataclass(frozen=True)
class TimeSeries:
    """Timestamped properties of an entity, kept in a table of their own."""

    entity: str
    table: str
    key: str | tuple[str, ...]
    timestamp: str
    properties: tuple[tuple[str, ...], ...]


@dataclass(frozen=True)
class Relationship:
    """A directed edge type: both endpoint keys are columns of one table."""

    name: str
    type_id: str
    source: str
    target: str
    table: str
    source_column: str | tuple[str, ...]
    target_column: str | tuple[str, ...]


# The sales and support model.
ENTITIES = {
    e.name: e
    for e in (
        Entity(
            "customer", "225559144391860", "customers", "customer_id", "customer_name",
            (("customer_id", "String"), ("customer_name", "String"), ("country", "String")),
        ),
        Entity(
            "product", "198911562181992", "products", "product_id", "product_name",
            (("product_id", "String"), ("product_name", "String"), ("product_line", "String")),
        ),
        Entity(
            "sales_opportunity", "75952987897380", "sales_opportunities", "opp_id", "opp_id",
            (
                ("opp_id", "String"), ("type", "String"), ("status", "String"), ("stage", "String"),
                ("opened_at", "DateTime"), ("expected_close_date", "DateTime"),
                ("closed_at", "DateTime"), ("is_forecast", "Boolean"),
                ("forecast_category", "String"), ("stage_last_changed_at", "DateTime"),
                ("amount", "Double"), ("currency", "String"), ("probability", "BigInt"),
                ("renewal_term_months", "BigInt"),
            ),
        ),
        Entity(
            "sales_activity", "145734892797750", "sales_activities", "activity_id", "type",
            (
                ("activity_id", "String"), ("activity_at", "DateTime"), ("description", "String"),
                ("type", "String"), ("contact_name", "String"),
            ),
        ),
        Entity(
            "sales_note", "27201152825262", "opportunity_notes", "note_id", "note_type",
            (
                ("note_id", "String"), ("note_at", "DateTime"), ("note_type", "String"),
                ("note_text", "String"), ("tags", "String"),
            ),
        ),
        Entity(
            "support_ticket", "172035851653791", "support_tickets", "ticket_id", "title",
            (
                ("ticket_id", "String"), ("status", "String"), ("opened_at", "DateTime"),
                ("closed_at", "DateTime"), ("severity", "String"), ("priority", "String"),
                ("channel", "String"), ("title", "String"), ("sla_breach_flag", "Boolean"),
                ("assigned_group", "String"),
            ),
        ),
        Entity(
            "support_activity", "261176581994496", "support_activities", "activity_id",
            "activity_type",
            (
                ("activity_id", "String"), ("activity_at", "DateTime"), ("description", "String"),
                ("author", "String"), ("activity_type", "String"), ("minutes_spent", "BigInt"),
            ),
        ),
    )
}

CSAT_SERIES = TimeSeries(
    "customer", "csat_by_month", "customer_id", "month",
    (("month", "DateTime"), ("csat", "BigInt")),
)

RELATIONSHIPS = {
    r.name: r
    for r in (
        Relationship(
            "has_opportunity", "5656583808927365294", "customer", "sales_opportunity",
            "sales_opportunities", "customer_id", "opp_id",
        ),
        Relationship(
            "has_opportunity_product", "5657590158201072397", "sales_opportunity", "product",
            "sales_opportunities", "opp_id", "product_id",
        ),
        Relationship(
            "has_opportunity_activity", "5658489847860878435", "sales_opportunity",
            "sales_activity", "sales_activities", "opp_id", "activity_id",
        ),
        Relationship(
            "has_opportunity_note", "5659137616197630065", "sales_opportunity", "sales_note",
            "opportunity_notes", "opp_id", "note_id",
        ),
        Relationship(
            "has_ticket", "5659828379573538127", "customer", "support_ticket",
            "support_tickets", "customer_id", "ticket_id",
        ),
        Relationship(
            "has_support_product", "5660682799628552533", "support_ticket", "product",
            "support_tickets", "ticket_id", "product_id",
        ),
        Relationship(
            "has_support_activity", "5661510012506907203", "support_ticket", "support_activity",
            "support_activities", "ticket_id", "activity_id",
        ),
    )
}


def _bindings(bound) -> tuple:
    """All tables that a type is bound to."""
    return bound if isinstance(bound, tuple) else (bound,)


def _id(key: str | tuple[str, ...]):
    """An identifier: one column as it is, several as one text, NULL if any of them is."""
    if isinstance(key, str):
        return F.col(key)
    return F.concat(*[c for k in key for c in (F.lit("|"), F.col(k).cast("string"))][1:])


def _typed(properties: tuple[tuple[str, ...], ...]):
    return [F.col(p[-1] if len(p) == 3 else p[0]).cast(SPARK_TYPES[p[1]]).alias(p[0]) for p in properties]


def entity_view(t: Tables, name: str, entities: dict[str, Entity] = ENTITIES) -> DataFrame:
    """The bound properties of one entity type, in their declared types. Foreign keys are not
    properties; they live on as edges."""
    views = [getattr(t, e.table).select(_typed(e.properties)) for e in _bindings(entities[name])]
    out = views[0]
    for view in views[1:]:
        # A further table may bind some of the properties only.
        out = out.unionByName(view, allowMissingColumns=True)
    return out


def entity_index(t: Tables, entities: dict[str, Entity] = ENTITIES) -> DataFrame:
    """Identifier and display name of every entity of every type."""
    return stacked(
        [
            getattr(t, e.table).select(
                F.lit(e.name).alias("entity_type"),
                _id(e.key).cast("string").alias("entity_id"),
                F.col(e.display).cast("string").alias("display_name"),
            )
            for bound in entities.values()
            for e in _bindings(bound)
        ]
    )


def _with_id(t: Tables, bound) -> DataFrame:
    views = [
        getattr(t, b.table).select(_id(b.key).alias("_entity"), *_typed(b.properties)) for b in bound
    ]
    out = views[0]
    for view in views[1:]:
        out = out.unionByName(view, allowMissingColumns=True)
    return out


def entity_timeseries(
    t: Tables, series: TimeSeries = CSAT_SERIES, entities: dict[str, Entity] = ENTITIES
) -> DataFrame:
    """Static properties of each entity next to every observation of its time series. Entities
    without observations appear once, with NULLs."""
    static = _with_id(t, _bindings(entities[series.entity]))
    observed = _with_id(t, [series])
    source = observed
    # An inner join can be split when one entity holds most observations; an outer join from the
    # entity side could not.
    return (
        static.join(observed, "_entity")
        .unionByName(
            static.join(source.select("_entity").distinct(), "_entity", "left_anti"),
            allowMissingColumns=True,
        )
        .drop("_entity")
    )


def edges_of(t: Tables, r: Relationship) -> DataFrame:
    """Edges of one relationship type, in the key types of the bound table."""
    return (
        getattr(t, r.table)
        .select(_id(r.source_column).alias("src_id"), _id(r.target_column).alias("dst_id"))
        .where(F.col("src_id").isNotNull() & F.col("dst_id").isNotNull())
    )


def edges(t: Tables, relationships: dict[str, Relationship] = RELATIONSHIPS) -> DataFrame:
    """All typed edges in one frame. Each bound table is read once, and nothing is shuffled."""
    by_table: dict[str, list[Relationship]] = {}
    for bound in relationships.values():
        for r in _bindings(bound):
            by_table.setdefault(r.table, []).append(r)
    return stacked(
        [
            getattr(t, table)
            .select(
                F.inline(
                    F.array(
                        *[
                            F.struct(
                                F.lit(r.name).alias("rel"),
                                F.lit(r.source).alias("src_type"),
                                _id(r.source_column).cast("string").alias("src_id"),
                                F.lit(r.target).alias("dst_type"),
                                _id(r.target_column).cast("string").alias("dst_id"),
                            )
                            for r in bound
                        ]
                    )
                )
            )
            .where(F.col("src_id").isNotNull() & F.col("dst_id").isNotNull())
            for table, bound in by_table.items()
        ]
    )


def entity_degree(t: Tables, relationships: dict[str, Relationship] = RELATIONSHIPS) -> DataFrame:
    """Outgoing edges per relationship and source entity, counted on the native keys."""
    return stacked(
        [
            stacked([edges_of(t, r) for r in _bindings(bound)])
            .groupBy("src_id")
            .agg(F.count("*").alias("degree"))
            .select(
                F.lit(_bindings(bound)[0].name).alias("rel"),
                F.lit(_bindings(bound)[0].source).alias("src_type"),
                F.col("src_id").cast("string").alias("src_id"),
                "degree",
            )
            for bound in relationships.values()
        ]
    )


# Before the name of a relationship that is followed from its target to its source.
BACK = "~"


def _hop(name: str, relationships: dict[str, Relationship]) -> tuple[str, str]:
    """The types a hop leads from and to."""
    r = _bindings(relationships[name.removeprefix(BACK)])[0]
    return (r.target, r.source) if name.startswith(BACK) else (r.source, r.target)


def _hop_edges(t: Tables, name: str, relationships: dict[str, Relationship]) -> DataFrame:
    bound = _bindings(relationships[name.removeprefix(BACK)])
    edges_ = stacked([edges_of(t, r) for r in bound])
    if name.startswith(BACK):
        edges_ = edges_.select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"))
    return edges_


def traverse(
    t: Tables, path: list[str], relationships: dict[str, Relationship] = RELATIONSHIPS
) -> DataFrame:
    """Where a chain of relationships leads: (src_id, dst_id, num_paths). A name after `~` is
    followed backwards.

    Paths are counted after every step instead of being listed, so many ways between two entities
    make a larger number and not more rows.
    """
    steps = [_hop(name, relationships) for name in path]
    for (_, to), (start, _), a, b in zip(steps, steps[1:], path, path[1:]):
        if to != start:
            raise ValueError(f"{a} leads to {to}, {b} starts at {start}")
    hops = [_hop_edges(t, name, relationships) for name in path]
    reached = hops[0].withColumn("num_paths", F.lit(1).cast("bigint"))
    for edges_ in hops[1:]:
        hop = edges_.select(
            F.col("src_id").alias("dst_id"), F.col("dst_id").alias("next_id")
        )
        reached = (
            reached.join(hop, "dst_id")
            .groupBy("src_id", F.col("next_id").alias("dst_id"))
            .agg(F.sum("num_paths").alias("num_paths"))
        )
    if len(steps) == 1:
        reached = reached.groupBy("src_id", "dst_id").agg(F.sum("num_paths").alias("num_paths"))
    return reached.select(
        F.lit(steps[0][0]).alias("src_type"),
        F.col("src_id").cast("string").alias("src_id"),
        F.lit(steps[-1][1]).alias("dst_type"),
        F.col("dst_id").cast("string").alias("dst_id"),
        "num_paths",
    )


def routes(
    source: str, target: str, relationships: dict[str, Relationship] = RELATIONSHIPS
) -> list[list[str]]:
    """The shortest chains of relationships from one type to another, each followed forwards or
    backwards, in the order of their names. A type that cannot be reached gives none.

    The model is searched breadth first. It is as small as a schema, whatever the tables hold.
    """
    hops = [h for name in relationships for h in (name, BACK + name)]
    known = {end for h in hops for end in _hop(h, relationships)}
    for one in (source, target):
        if one not in known:
            raise ValueError(f"no relationship has the type {one}")
    found, met = {source: [[]]}, {source}
    while found and target not in found:
        further: dict[str, list[list[str]]] = {}
        for at, chains in found.items():
            for h in hops:
                start, to = _hop(h, relationships)
                if start == at and to not in met:
                    further.setdefault(to, []).extend([*chain, h] for chain in chains)
        met |= set(further)
        found = further
    return sorted(found.get(target, []))


def connected(
    t: Tables,
    source: str,
    target: str,
    relationships: dict[str, Relationship] = RELATIONSHIPS,
) -> DataFrame:
    """Which entities of two types hang together, along every shortest route between the types:
    (route, src_type, src_id, dst_type, dst_id, num_paths)."""
    chains = [c for c in routes(source, target, relationships) if c]
    if not chains:
        raise ValueError(f"no route leads from {source} to {target}")
    return stacked(
        [
            traverse(t, chain, relationships).select(F.lit("/".join(chain)).alias("route"), "*")
            for chain in chains
        ]
    )
