"""The built-in model as the definition document that describes it."""

import base64
import json

from pipewright.plans import ontology


def part(path, body):
    payload = base64.b64encode(json.dumps(body).encode()).decode()
    return {"path": path, "payload": payload, "payloadType": "InlineBase64"}


def binding(kind, table, pairs, **more):
    return {
        "dataBindingConfiguration": {
            "dataBindingType": kind,
            "propertyBindings": [
                {"sourceColumnName": c, "targetPropertyId": p} for c, p in pairs
            ],
            "sourceTableProperties": {"sourceTableName": table},
            **more,
        }
    }


def parts_of(entities, series, relationships):
    out = [part(".platform", {"metadata": {}})]
    ids = {e.name: e.type_id for e in entities.values()}
    for e in entities.values():
        folder = f"EntityTypes/{e.type_id}"
        static = [{"id": f"p-{p[0]}", "name": p[0], "valueType": p[1]} for p in e.properties]
        mine = [s for s in series.values() if s.entity == e.name]
        timed = [
            {"id": f"t-{p[0]}", "name": p[0], "valueType": p[1]} for s in mine for p in s.properties
        ]
        columns = {p[-1] if len(p) == 3 else p[0]: f"p-{p[0]}" for p in e.properties}
        out.append(
            part(
                f"{folder}/definition.json",
                {
                    "id": e.type_id, "name": e.name, "entityIdParts": [columns[e.key]],
                    "displayNamePropertyId": columns[e.display], "properties": static,
                    "timeseriesProperties": timed,
                },
            )
        )
        out.append(
            part(f"{folder}/DataBindings/1.json", binding("NonTimeSeries", e.table, columns.items()))
        )
        for s in mine:
            pairs = [(s.key, columns[e.key])] + [(p[0], f"t-{p[0]}") for p in s.properties]
            out.append(
                part(
                    f"{folder}/DataBindings/2.json",
                    binding("TimeSeries", s.table, pairs, timestampColumnName=s.timestamp),
                )
            )
    for r in relationships.values():
        folder = f"RelationshipTypes/{r.type_id}"
        out.append(
            part(
                f"{folder}/definition.json",
                {
                    "id": r.type_id, "name": r.name,
                    "source": {"entityTypeId": ids[r.source]},
                    "target": {"entityTypeId": ids[r.target]},
                },
            )
        )
        out.append(
            part(
                f"{folder}/Contextualizations/1.json",
                {
                    "dataBindingTable": {"sourceTableName": r.table},
                    "sourceKeyRefBindings": [{"sourceColumnName": r.source_column}],
                    "targetKeyRefBindings": [{"sourceColumnName": r.target_column}],
                },
            )
        )
    return out


def document_of(entities, series, relationships) -> str:
    return json.dumps({"definition": {"parts": parts_of(entities, series, relationships)}})


MODEL_DOCUMENT = document_of(
    ontology.ENTITIES, {"customer": ontology.CSAT_SERIES}, ontology.RELATIONSHIPS
)
