"""The semantic model as read from the parts of an item definition.

A model is configuration: its parts are parsed by Spark, and the resulting few types come to the
driver to shape later queries, as a table schema would.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipewright.plans.ontology import Entity, Relationship, TimeSeries

# Where a definition keeps its parts, and the fields of each kind of part.
_KINDS = {
    "entity": (
        r"^EntityTypes/([^/]+)/definition\.json$",
        "id string, name string, entityIdParts array<string>, displayNamePropertyId string, "
        "properties array<struct<id: string, name: string, valueType: string>>, "
        "timeseriesProperties array<struct<id: string, name: string, valueType: string>>",
    ),
    "binding": (
        r"^EntityTypes/([^/]+)/DataBindings/[^/]+\.json$",
        "dataBindingConfiguration struct<dataBindingType: string, timestampColumnName: string, "
        "propertyBindings: array<struct<sourceColumnName: string, targetPropertyId: string>>, "
        "sourceTableProperties: struct<sourceTableName: string>>",
    ),
    "relationship": (
        r"^RelationshipTypes/([^/]+)/definition\.json$",
        "id string, name string, source struct<entityTypeId: string>, "
        "target struct<entityTypeId: string>",
    ),
    "context": (
        r"^RelationshipTypes/([^/]+)/Contextualizations/[^/]+\.json$",
        "dataBindingTable struct<sourceTableName: string>, "
        "sourceKeyRefBindings array<struct<sourceColumnName: string>>, "
        "targetKeyRefBindings array<struct<sourceColumnName: string>>",
    ),
}


@dataclass(frozen=True)
class Model:
    """What a definition binds. A type may be bound to several tables."""

    entities: dict[str, tuple[Entity, ...]]
    series: dict[str, tuple[TimeSeries, ...]]
    relationships: dict[str, tuple[Relationship, ...]]


def _collected(parts: DataFrame, kind: str) -> list[tuple[str, dict]]:
    """All parts of a kind, by path: as many rows as the model has types and bindings."""
    pattern, schema = _KINDS[kind]
    rows = (
        parts.where(F.col("is_json") & F.col("path").rlike(pattern))
        .select(
            "path",
            F.regexp_extract("path", pattern, 1).alias("owner"),
            F.from_json("content", schema).alias("body"),
        )
        .collect()
    )
    return [(r["owner"], r["body"].asDict(recursive=True)) for r in sorted(rows, key=lambda r: r["path"])]


def _key(columns: list[str]) -> str | tuple[str, ...]:
    return columns[0] if len(columns) == 1 else tuple(columns)


def load_model(parts: DataFrame) -> Model:
    """Entities, time series and relationships from `definition_parts` of one model."""
    types = {e["id"]: e for _, e in _collected(parts, "entity")}
    entities, series = {}, {}
    for owner, body in _collected(parts, "binding"):
        e = types[owner]
        config = body["dataBindingConfiguration"]
        column = {b["targetPropertyId"]: b["sourceColumnName"] for b in config["propertyBindings"]}
        table = config["sourceTableProperties"]["sourceTableName"]
        key = _key([column[part] for part in e["entityIdParts"]])

        def bound(properties):
            return tuple(
                (p["name"], p["valueType"])
                if column[p["id"]] == p["name"]
                else (p["name"], p["valueType"], column[p["id"]])
                for p in properties or []
                if p["id"] in column
            )

        if config["dataBindingType"] == "TimeSeries":
            one = TimeSeries(
                e["name"], table, key, config["timestampColumnName"], bound(e["timeseriesProperties"])
            )
            series[e["name"]] = (*series.get(e["name"], ()), one)
        else:
            # A further table need not hold the display property; its key stands in.
            display = column.get(e["displayNamePropertyId"], key if isinstance(key, str) else key[0])
            one = Entity(e["name"], e["id"], table, key, display, bound(e["properties"]))
            entities[e["name"]] = (*entities.get(e["name"], ()), one)
    contexts: dict[str, list[dict]] = {}
    for owner, body in _collected(parts, "context"):
        contexts.setdefault(owner, []).append(body)
    relationships = {}
    for _, r in _collected(parts, "relationship"):
        relationships[r["name"]] = tuple(
            Relationship(
                r["name"],
                r["id"],
                types[r["source"]["entityTypeId"]]["name"],
                types[r["target"]["entityTypeId"]]["name"],
                context["dataBindingTable"]["sourceTableName"],
                _key([b["sourceColumnName"] for b in context["sourceKeyRefBindings"]]),
                _key([b["sourceColumnName"] for b in context["targetKeyRefBindings"]]),
            )
            for context in contexts[r["id"]]
        )
    return Model(entities, series, relationships)
