import base64
import json
import uuid
from datetime import date

import pytest
from pyspark.sql import functions as F

from pipewright.functions.text import BLANKS, clean_text
from pipewright.plans import exchange, slip
from pipewright.policy import SlipPolicy
from pipewright.sources import answers, catalog, definitions, literal, scratch, tsv
from pipewright.sources.schemas import SCHEMAS
from pipewright.tables import Tables
from tests.small import tables

ODD_TEXT = 'tab\there, "quoted", back\\slash,\nnext line; comma, é'


@pytest.fixture(scope="module")
def t(spark):
    return tables(
        spark,
        customers=[{"customer_id": "C1", "country": None}],
        products=[{"product_id": "P1"}],
        csat_by_month=[{"customer_id": "C1", "month": date(2026, 2, 6), "csat": 4}],
        sales_opportunities=[
            {"opp_id": "O1", "type": "Renewal", "renewal_term_months": 12},
            {"opp_id": "O2", "is_forecast": False, "amount": 0.1 + 0.2},
        ],
        sales_activities=[{"activity_id": "A1", "opp_id": "O1", "activity_at": date(2026, 2, 1)}],
        opportunity_notes=[
            {"note_id": "N1", "opp_id": "O1", "note_at": date(2026, 2, 1), "note_text": ODD_TEXT},
            {"note_id": "N2", "opp_id": "O1", "note_at": date(2026, 2, 1), "note_text": '"'},
            {"note_id": "N3", "opp_id": "O1", "note_at": date(2026, 2, 1), "note_text": " padded "},
        ],
        support_tickets=[{"ticket_id": "T1", "sla_breach_flag": True}],
        support_activities=[{"activity_id": "S1", "ticket_id": "T1"}],
    )


def test_tsv_roundtrip(spark, t, tmp_path):
    report = exchange.tsv_roundtrip(spark, t, str(tmp_path)).collect()
    assert {r["table_name"] for r in report} == set(Tables.names())
    for r in report:
        assert r["num_source"] == r["num_copy"] and r["num_different"] == 0, r
    back = tsv.load(spark, str(tmp_path), multi_line=True)
    assert back.opportunity_notes.where("note_id = 'N1'").collect()[0]["note_text"] == ODD_TEXT


def test_tsv_as_other_tools_write_it(spark, tmp_path):
    schema = SCHEMAS["sales_opportunities"]
    values = "O1 C1 P1 Renewal Open Proposal 2026-01-01 2026-02-01 - True - 2026-01-05 85000.0 EUR 40 12.0"
    fields = ["" if v == "-" else v for v in values.split(" ")]
    (tmp_path / "o.csv").write_text("\t".join(schema.names) + "\n" + "\t".join(fields) + "\n")
    row = tsv.read_table(spark, str(tmp_path / "o.csv"), schema).collect()[0]
    assert row["renewal_term_months"] == 12 and row["is_forecast"] is True
    assert row["closed_at"] is None and row["forecast_category"] is None
    assert row["expected_close_date"] == date(2026, 2, 1)


def test_malformed_tsv_fails(spark, tmp_path):
    (tmp_path / "c.csv").write_text("customer_id\tmonth\tcsat\nC1\tnot a day\t4\n")
    with pytest.raises(Exception):
        tsv.read_table(spark, str(tmp_path / "c.csv"), SCHEMAS["csat_by_month"]).collect()


def test_difference_sees_values_lost_to_null(spark, t):
    broken = t.sales_opportunities.withColumn("renewal_term_months", F.lit(None).cast("int"))
    report = exchange.difference(t.sales_opportunities, broken).collect()[0]
    assert (report["num_source"], report["num_copy"], report["num_different"]) == (2, 2, 2)
    swapped = t.customers.select(
        "customer_id", F.lit(None).cast("string").alias("customer_name"),
        F.col("customer_name").alias("country"),
    )
    assert exchange.difference(t.customers, swapped).collect()[0]["num_different"] == 2


def test_answers_roundtrip(spark, tmp_path):
    df = spark.createDataFrame(
        [("q1", 'select \\"a\\"\nfrom t', "| a |\n|:-|\n| 1, 2 |"), ("q2", "s;\ns", 'with "quotes"')],
        "question string, sql string, result string",
    )
    report = exchange.answers_roundtrip(spark, df, str(tmp_path / "a")).collect()[0]
    assert (report["num_copy"], report["num_different"]) == (2, 0)
    wanted = answers.evaluation_input(answers.read_answers(spark, str(tmp_path / "a")))
    assert wanted.columns == ["question", "expected_answer"] and wanted.count() == 2
    raw = "".join(p.read_text() for p in (tmp_path / "a").glob("part-*"))
    assert raw.count("\t") >= 3


def test_clean_text(spark):
    texts = ['  a \t\t "b"   c\n d \n\n', "", "　x\x1f ", "no change", None]
    assert BLANKS == "".join(sorted(BLANKS, key=BLANKS.index))
    got = [
        r[0]
        for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string")
        .orderBy("i").select(clean_text(F.col("t"))).collect()
    ]
    import re

    def plain(s):
        return None if s is None else re.sub(" +", " ", s.replace("\t", " ").replace('"', '\\"')).strip()

    assert got == [plain(s) for s in texts]


def parts_of(spark):
    def b64(s):
        return base64.b64encode(s.encode()).decode()

    parts = [
        ("a/definition.json", b64('{"id": "1", "deep": {"x": [1, 2.5, null]}}'), "InlineBase64"),
        ("a/broken.json", b64("not json {"), "InlineBase64"),
        ("a/readme.txt", b64('{"kept": "as text"}'), "InlineBase64"),
        ("a/plain.json", '{"raw": true}', "Other"),
        ("é.json", b64("replaced by the next part"), "InlineBase64"),
        ("é.json", b64('"ünïcode"'), "InlineBase64"),
    ]
    document = json.dumps(
        {"definition": {"parts": [dict(zip(("path", "payload", "payloadType"), p)) for p in parts]}}
    )
    return spark.createDataFrame([("item", document)], "item string, document string")


def test_definition_parts(spark):
    got = {
        r["path"]: (r["content"], r["is_json"])
        for r in definitions.definition_parts(parts_of(spark), "item", "document")
        .orderBy("position")
        .collect()
    }
    assert got == {
        "a/definition.json": ('{"deep":{"x":[1,2.5,null]},"id":"1"}', True),
        "a/broken.json": ("not json {", False),
        "a/readme.txt": ('{"kept": "as text"}', False),
        "a/plain.json": ('{"raw": true}', False),
        "é.json": ('"ünïcode"', True),
    }


def test_bad_definitions_are_reported(spark):
    def document(*parts):
        return json.dumps(
            {"definition": {"parts": [dict(zip(("path", "payload", "payloadType"), p)) for p in parts]}}
        )

    rows = [
        ("cut off", document(("a.json", "e30=", "InlineBase64"))[:20]),
        ("not an object", "[1]"),
        ("no document", None),
        ("bad base64", document(("a.json", "%%%", "InlineBase64"), ("b.txt", "YQ==", "InlineBase64"))),
        ("bad json", document(("a.json", "bm90IGpzb24=", "InlineBase64"))),
        ("no parts", document()),
    ]
    df = spark.createDataFrame(rows, "item string, document string")
    parts = definitions.definition_parts(df, "item", "document")
    assert sorted((r.item, r.status, r.content) for r in parts.collect() if r.content) == [
        ("bad base64", "text", "a"), ("bad json", "not json", "not json"),
    ]
    assert sorted((r.item, r.status) for r in parts.collect() if not r.content) == [
        ("bad base64", "not base64"), ("cut off", "no definition"),
        ("no document", "no definition"), ("not an object", "no definition"),
    ]
    whole = {
        r.item: (r.document, r.status)
        for r in definitions.definition_documents(df, "item", "document").collect()
    }
    assert whole["bad base64"] == ('{"a.json":null,"b.txt":"a"}', "json")
    assert whole["no parts"] == ("{}", "json")
    assert {whole[k] for k in ("cut off", "not an object", "no document")} == {(None, "no definition")}


def test_definition_documents(spark, tmp_path):
    expected = {
        "a/definition.json": {"id": "1", "deep": {"x": [1, 2.5, None]}},
        "a/broken.json": "not json {",
        "a/readme.txt": '{"kept": "as text"}',
        "a/plain.json": '{"raw": true}',
        "é.json": "ünïcode",
    }
    whole = definitions.definition_documents(parts_of(spark), "item", "document")
    text = whole.collect()[0]["document"]
    assert json.loads(text) == expected
    assert list(json.loads(text)) == sorted(expected) and text.count("é.json") == 1
    definitions.write_documents(whole, str(tmp_path / "d"))
    assert json.loads(spark.read.text(str(tmp_path / "d")).collect()[0][0]) == expected


def test_catalog_tables(spark, t, tmp_path):
    schema = f"ops_{uuid.uuid4().hex[:8]}"
    saved = catalog.save_all(spark, t, schema, root=str(tmp_path / "plain"))
    for name, df in t.items():
        assert exchange.difference(df, getattr(saved, name)).collect()[0]["num_different"] == 0
    catalog.save(t.customers, f"{schema}.customers", mode="append", path=str(tmp_path / "plain/customers"))
    assert Tables.from_catalog(spark, schema).customers.count() == 2
    spark.sql(f"DROP SCHEMA {schema} CASCADE")


def test_bucketed_tables_join_without_shuffling_facts(spark, t, tmp_path):
    schema = f"ops_{uuid.uuid4().hex[:8]}"
    saved = catalog.save_all(spark, t, schema, root=str(tmp_path / "bucketed"), buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        last = saved.sales_activities.groupBy("opp_id").agg(F.max("activity_at").alias("at"))
        plan = saved.sales_opportunities.join(last, "opp_id", "left")
        assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
        policy = SlipPolicy(date(2026, 2, 1), date(2026, 3, 1), date(2026, 2, 15), date(2026, 2, 1))
        ours = slip.slip_risk_flags(saved, policy)
        assert sorted(ours.collect()) == sorted(slip.slip_risk_flags(t, policy).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"DROP SCHEMA {schema} CASCADE")


def test_scratch_is_below_the_shared_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    first, second = scratch.scratch_path(spark, "x"), scratch.scratch_path(spark, "x")
    assert first != second
    assert root is None or first.startswith(root)


def test_literal_rows_are_part_of_the_plan(spark):
    df = literal.literal_table(
        spark, [("a", literal.TEXT), ("d", literal.DAY)], [("x", date(2026, 1, 1)), (None, None)]
    )
    assert dict(df.dtypes) == {"a": "string", "d": "date"}
    assert "LocalTableScan" in df._jdf.queryExecution().executedPlan().toString()
