"""The built-in model, written as definition parts and read back."""

import json
from datetime import date

import pytest

from oracles.definition import binding, part, parts_of
from pipewright.plans import ontology
from pipewright.sources import definitions
from pipewright.sources.model import load_model
from tests.small import dicts, tables


def read(spark, parts):
    document = json.dumps({"definition": {"parts": parts}})
    df = spark.createDataFrame([("model", document)], "item string, document string")
    return load_model(definitions.definition_parts(df, "item", "document"))


def test_model_survives_its_definition(spark):
    series = {"customer": ontology.CSAT_SERIES}
    model = read(spark, parts_of(ontology.ENTITIES, series, ontology.RELATIONSHIPS))
    assert model.entities == {n: (e,) for n, e in ontology.ENTITIES.items()}
    assert model.series == {n: (s,) for n, s in series.items()}
    assert model.relationships == {n: (r,) for n, r in ontology.RELATIONSHIPS.items()}


def test_a_model_of_ones_own(spark):
    account = ontology.Entity(
        "account", "7", "customers", "customer_id", "customer_name",
        (("number", "String", "customer_id"), ("label", "String", "customer_name")),
    )
    model = read(spark, parts_of({"account": account}, {}, {}))
    t = tables(spark, customers=[{"customer_id": "C1", "customer_name": "Aurora"}])
    view = ontology.entity_view(t, "account", model.entities)
    assert dicts(view, "number", "label") == [("C1", "Aurora")]
    index = ontology.entity_index(t, model.entities)
    assert dicts(index, *index.columns) == [("account", "C1", "Aurora")]


def test_unbound_relationship_is_an_error(spark):
    parts = parts_of(ontology.ENTITIES, {}, ontology.RELATIONSHIPS)
    with pytest.raises(KeyError):
        read(spark, [p for p in parts if "Contextualizations" not in p["path"]])


def test_several_bindings_and_composite_keys(spark):
    parts = [
        part(
            "EntityTypes/7/definition.json",
            {
                "id": "7", "name": "score", "entityIdParts": ["p-c", "p-m"],
                "displayNamePropertyId": "p-c",
                "properties": [
                    {"id": "p-c", "name": "customer", "valueType": "String"},
                    {"id": "p-m", "name": "month", "valueType": "String"},
                    {"id": "p-v", "name": "value", "valueType": "BigInt"},
                ],
                "timeseriesProperties": [],
            },
        ),
        part("EntityTypes/7/DataBindings/1.json", binding("NonTimeSeries", "csat_by_month",
             [("customer_id", "p-c"), ("month", "p-m"), ("csat", "p-v")])),
        part("EntityTypes/7/DataBindings/2.json", binding("NonTimeSeries", "customers",
             [("customer_id", "p-c"), ("country", "p-m")])),
        part("EntityTypes/8/definition.json", {
            "id": "8", "name": "account", "entityIdParts": ["p-c"], "displayNamePropertyId": "p-c",
            "properties": [{"id": "p-c", "name": "customer", "valueType": "String"}],
        }),
        part("RelationshipTypes/9/definition.json", {
            "id": "9", "name": "has_score",
            "source": {"entityTypeId": "8"}, "target": {"entityTypeId": "7"},
        }),
    ]
    for n, table, columns in ((1, "csat_by_month", ("customer_id", "month")), (2, "customers", ("customer_id", "country"))):
        parts.append(part(f"RelationshipTypes/9/Contextualizations/{n}.json", {
            "dataBindingTable": {"sourceTableName": table},
            "sourceKeyRefBindings": [{"sourceColumnName": "customer_id"}],
            "targetKeyRefBindings": [{"sourceColumnName": c} for c in columns],
        }))
    model = read(spark, parts)
    t = tables(
        spark,
        customers=[{"customer_id": "C1", "country": "IT"}],
        csat_by_month=[{"customer_id": "C1", "month": date(2026, 1, 1), "csat": 4}],
    )
    view = ontology.entity_view(t, "score", model.entities)
    assert dicts(view, "customer", "month", "value") == [("C1", "2026-01-01", 4), ("C1", "IT", None)]
    index = ontology.entity_index(t, {"score": model.entities["score"]})
    assert dicts(index, "entity_id") == [("C1|2026-01-01",), ("C1|IT",)]
    assert dicts(ontology.edges(t, model.relationships), "src_id", "dst_id") == [
        ("C1", "C1|2026-01-01"), ("C1", "C1|IT"),
    ]
    assert dicts(ontology.entity_degree(t, model.relationships), "src_id", "degree") == [("C1", 2)]
    paths = ontology.traverse(t, ["has_score"], model.relationships)
    assert dicts(paths, "dst_id", "num_paths") == [("C1|2026-01-01", 1), ("C1|IT", 1)]
