"""Rejected records, runs that replace themselves, models from folders, and routes."""

import pytest
from pyspark.sql import types as T

from oracles.definition import MODEL_DOCUMENT
from pipewright.plans import evaluate, ontology
from pipewright.sources import catalog, definitions, tsv
from pipewright.sources.model import load_model
from tests.small import dicts, tables

SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("n", T.IntegerType()),
        T.StructField("day", T.DateType(), False),
        T.StructField("flag", T.BooleanType()),
        T.StructField("x", T.DoubleType()),
    ]
)
LINES = [
    ("a\t1\t2026-01-02\tTrue\t1.5", None),
    ("b\t12.0\t2026-01-02\t\t", None),
    ('"c\t1"\t\t2026-01-03\tFalse\t-1', None),
    ("d\t1.5\t2026-01-02\tTrue\t1.0", "fraction in n"),
    ("e\tmany\t2026-01-02\tTrue\t1.5", "no int in n"),
    ("f\t1\t2026-02-30\tTrue\t1.5", "no date in day"),
    ("g\t1\t\tTrue\t1.5", "no value in day"),
    ("\t1\t2026-01-02\tTrue\t1.5", "no value in id"),
    ("h\t1\t2026-01-02\tperhaps\t1.5", "no boolean in flag"),
    ("i\t1\t2026-01-02\tTrue", tsv.WRONG_WIDTH),
    ("j\t1\t2026-01-02\tTrue\t1.5\tmore", tsv.WRONG_WIDTH),
    ("k\tmany\t2026-01-02\tTrue\tmany", "no int in n"),
]


@pytest.mark.parametrize("multi_line", [False, True])
def test_every_record_is_loaded_or_rejected(spark, tmp_path, multi_line):
    path = tmp_path / "t.csv"
    path.write_text("\n".join(["id\tn\tday\tflag\tx", *[line for line, _ in LINES]]) + "\n")
    good, rejects = tsv.read_with_rejects(spark, str(path), SCHEMA, multi_line)
    assert good.schema.simpleString() == SCHEMA.simpleString()
    assert [(i, n) for i, n in dicts(good, "id", "n")] == [("a", 1), ("b", 12), ("c\t1", None)]
    assert dicts(rejects, "record", "reason") == sorted((line, r) for line, r in LINES if r)
    assert {r.file.rsplit("/", 1)[-1] for r in rejects.collect()} == {"t.csv"}
    # Counting and single columns see the same rows as the whole table.
    assert good.count() == 3 and rejects.count() == 9 and good.select("x").count() == 3


def test_rejects_of_a_folder_name_their_files(spark, tmp_path):
    for name, line in (("one", LINES[0][0]), ("two", LINES[4][0])):
        (tmp_path / name).write_text(line + "\n")
    good, rejects = tsv.read_with_rejects(spark, str(tmp_path), SCHEMA, header=False)
    assert dicts(good, "id") == [("a",)]
    assert [r.file.rsplit("/", 1)[-1] for r in rejects.collect()] == ["two"]


def test_a_run_replaces_itself_and_nothing_else(spark, tmp_path):
    spark.sql("CREATE SCHEMA IF NOT EXISTS run_test")

    def run(name, *scores):
        frame = spark.createDataFrame([(name, i, s) for i, s in enumerate(scores)], "evaluation_id string, q int, score int")
        catalog.save_run(frame, "run_test.results", path=str(tmp_path / "results"))

    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    run("one", 1, 2, 3)
    run("two", 5)
    run("one", 4, 4)
    run("one", 4, 4)
    assert dicts(spark.table("run_test.results"), "evaluation_id", "q", "score") == [
        ("one", 0, 4), ("one", 1, 4), ("two", 0, 5),
    ]
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before
    # A reader of one run opens its files only.
    plan = spark.table("run_test.results").where("evaluation_id = 'two'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(evaluation_id" in plan
    catalog.drop(spark, ["run_test.results"], "run_test")
    assert not spark.catalog.databaseExists("run_test")


def test_queries_leave_no_tables_behind(spark):
    import __spark_entry__ as registry

    def names():
        return {(d.name, t.name) for d in spark.catalog.listDatabases() for t in spark.catalog.listTables(d.name)}

    before = names()
    for name in ("eval_summary", "catalog_roundtrip", "eval_runs_replaced"):
        registry.queries()[name](spark, "/root/testdata/sf0.001").collect()
    assert names() == before


def parts(spark):
    document = spark.createDataFrame([("model", MODEL_DOCUMENT)], "item string, document string")
    return definitions.definition_parts(document, "item", "document")


def test_a_model_survives_its_folder(spark, tmp_path):
    folder = f"{tmp_path}/a model+1%20.Ontology"
    definitions.write_folder(parts(spark), folder)
    read = definitions.read_folder(spark, folder)
    assert load_model(read) == load_model(parts(spark))
    visible = parts(spark).where("path <> '.platform'")
    assert dicts(read, "path", "content") == dicts(visible, "path", "content")
    # Written again with fewer parts, the others are gone.
    definitions.write_folder(visible.where("path LIKE 'Entity%'"), folder)
    assert load_model(definitions.read_folder(spark, folder)).relationships == {}


def test_parts_of_a_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "broken.json").write_text("{not json")
    (tmp_path / "note.txt").write_text("line one\nline two\n")
    (tmp_path / "x.json").write_text('{"a": [1, null]}\n')
    read = definitions.read_folder(spark, str(tmp_path))
    assert dicts(read, "position", "path", "content", "is_json", "status") == [
        (0, "note.txt", "line one\nline two\n", False, "text"),
        (1, "sub/broken.json", "{not json", False, "not json"),
        (2, "x.json", '{"a":[1,null]}', True, "json"),
    ]
    outside = spark.createDataFrame([(0, "../x", "y")], "position int, path string, content string")
    with pytest.raises(ValueError):
        definitions.write_folder(outside, str(tmp_path / "out"))


def test_routes():
    assert ontology.routes("product", "customer") == [
        ["~has_opportunity_product", "~has_opportunity"], ["~has_support_product", "~has_ticket"],
    ]
    assert ontology.routes("customer", "sales_note") == [["has_opportunity", "has_opportunity_note"]]
    assert ontology.routes("customer", "customer") == [[]]
    with pytest.raises(ValueError):
        ontology.routes("customer", "moon")
    alone = {**ontology.RELATIONSHIPS, "own": ontology.Relationship("own", "1", "sun", "moon", "t", "a", "b")}
    assert ontology.routes("customer", "moon", alone) == []


def test_entities_that_hang_together(spark):
    t = tables(
        spark,
        sales_opportunities=[{"opp_id": f"O{i}", "customer_id": f"C{i % 2}", "product_id": "P1"} for i in range(3)],
        support_tickets=[{"ticket_id": "T1", "customer_id": "C1", "product_id": "P2"}],
        opportunity_notes=[{"note_id": "N1", "opp_id": "O1"}, {"note_id": "N2", "opp_id": "O9"}],
    )
    found = ontology.connected(t, "product", "customer")
    assert dicts(found, "route", "src_id", "dst_id", "num_paths") == [
        ("~has_opportunity_product/~has_opportunity", "P1", "C0", 2),
        ("~has_opportunity_product/~has_opportunity", "P1", "C1", 1),
        ("~has_support_product/~has_ticket", "P2", "C1", 1),
    ]
    back = ontology.traverse(t, ["~has_opportunity_note", "~has_opportunity"])
    assert dicts(back, "src_type", "src_id", "dst_type", "dst_id") == [("sales_note", "N1", "customer", "C1")]
    with pytest.raises(ValueError):
        ontology.traverse(t, ["has_opportunity", "~has_ticket"])
    with pytest.raises(ValueError):
        ontology.connected(t, "product", "product")


def test_scores_by_cells(spark):
    schema = "run string, question string, id int, name string, amount double"
    right = [(i, f"n{i}", float(i)) for i in range(10)]
    runs = {
        "equal": right[::-1],
        "to the cent": [(i, n, a + 0.004) for i, n, a in right],
        "beyond the cent": [(i, n, a + (0.006 if i == 3 else 0)) for i, n, a in right],
        "two rows less": right[:8],
        "other values": [(i, "?", a + 1) for i, n, a in right],
        "few rows": right[:3],
        "other rows": [(i + 100, n, a) for i, n, a in right],
        "nothing": [],
        "a row twice": [*right, right[0]],
    }
    rows = [("truth", "q", *r) for r in right] + [(run, "q", *r) for run, own in runs.items() for r in own]
    questions = spark.createDataFrame([("q",), ("empty",)], "question string")
    found = evaluate.cell_scores(
        spark.createDataFrame(rows, schema), questions, "question", ["id"], "truth", list(runs)
    )
    by = {r.evaluation_id: r for r in found.where("question = 'q'").collect()}
    assert {run: by[run].score for run in runs} == {
        "equal": 5, "to the cent": 5, "beyond the cent": 4, "two rows less": 4, "other values": 3,
        "few rows": 2, "other rows": 1, "nothing": 1, "a row twice": 4,
    }
    r = by["beyond the cent"]
    assert (r.matched_rows, r.same_cells, r.differing_cells, r.all_cells, r.passed) == (10, 29, 1, 30, True)
    r = by["a row twice"]
    assert (r.expected_rows, r.actual_rows, r.missing_rows, r.extra_rows) == (10, 11, 0, 1)
    r = by["nothing"]
    assert (r.missing_rows, r.extra_rows, r.same_cells) == (10, 0, 0)
    assert {r.score for r in found.where("question = 'empty'").collect()} == {5}


def test_null_keys_and_null_cells_align(spark):
    rows = [
        ("truth", "q", None, None, None), ("truth", "q", 1, "a", None), ("truth", "q", 1, "b", 2.0),
        ("one", "q", None, None, None), ("one", "q", 1, "b", 2.0), ("one", "q", 1, "a", None),
    ]
    frame = spark.createDataFrame(rows, "run string, question string, id int, name string, amount double")
    questions = frame.select("question").distinct()
    r = evaluate.cell_scores(frame, questions, "question", ["id"], "truth", ["one"]).first()
    assert (r.matched_rows, r.same_cells, r.score) == (3, 9, 5)
