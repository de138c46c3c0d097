"""Registered queries over the given tables, and the SQL each of them must agree with."""

from __future__ import annotations

import importlib
import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oracles import oracle_statements
from oracles.definition import MODEL_DOCUMENT
from oracles.seeds import ALTERED, CASES, PHRASINGS, SEEDS
from pipewright.functions.dates import month_window
from pipewright.functions.text import clean_text
from pipewright.operators.lookups import stacked
from pipewright.plans import (
    accelerate,
    activity,
    checks,
    customer360,
    distributions,
    evaluate,
    exchange,
    generate,
    notes,
    ontology,
    pipeline,
    renewal,
    slip,
    truth,
    variants,
)
from pipewright.policy import AcceleratePolicy, RenewalPolicy, SlipPolicy
from pipewright.sources import catalog, star, tsv
from pipewright.sources.answers import evaluation_input, read_answers, write_answers
from pipewright.sources.definitions import (
    definition_documents,
    definition_parts,
    read_documents,
    read_folder,
    write_documents,
    write_folder,
)
from pipewright.sources.literal import INT, TEXT, literal_table
from pipewright.sources.model import load_model
from pipewright.sources.scratch import scratch_path
from pipewright.tables import Tables

SF_DIR = "/root/testdata/sf0.001"

AS_OF = date(2000, 2, 15)
SLIP = SlipPolicy(*month_window(2000, 2), as_of=AS_OF, base=date(2000, 2, 1))
RENEWAL = RenewalPolicy(*month_window(2000, 2, 4))
ACCELERATE = AcceleratePolicy(*month_window(2000, 7, 12))


def monthly_policies(**overrides) -> list[SlipPolicy]:
    """One slip policy per month of 2000, looked at on the 15th."""
    return [
        SlipPolicy(
            *month_window(2000, m),
            as_of=date(2000, m, 15),
            base=date(2000, m, 1),
            policy_id=f"2000-{m:02d}",
            **overrides,
        )
        for m in range(1, 13)
    ]


SLIP_SWEEP = [
    *monthly_policies(),
    SlipPolicy(
        *month_window(2000, 1, 3),
        as_of=AS_OF,
        base=date(2000, 2, 1),
        activity_days=30,
        stagnant_days=45,
        policy_id="first quarter, patient",
    ),
    SlipPolicy(
        *month_window(2000, 2),
        as_of=AS_OF,
        base=date(2000, 2, 1),
        exact_tag="at_risk",
        severities=("Critical",),
        policy_id="february, exact tag",
    ),
    SlipPolicy(
        *month_window(2000, 2),
        as_of=AS_OF,
        base=date(2000, 2, 1),
        signal_days=90,
        product_id=8,
        policy_id="february, product 8",
    ),
]
RENEWAL_SWEEP = [
    RENEWAL,
    RenewalPolicy(
        *month_window(2000, 1, 6), expansion_limit=250_000.0, incident_min=8, policy_id="strict"
    ),
    RenewalPolicy(
        *month_window(2000, 2, 4),
        severities=("Low", "Medium", "High", "Critical"),
        open_only=True,
        policy_id="any severity, open",
    ),
    RenewalPolicy(
        *month_window(2000, 1, 12), expansion_types=("Expansion",), product_id=5, policy_id="product 5"
    ),
]


def _on_tables(job: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: job(star.load(spark, sf_dir))


def _customer_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.schema(star.COLUMNS["customer"]).parquet(f"{sf_dir}/customer.parquet")
    return rows.select(F.col("c_custkey").alias("id"))


def _product_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.schema(star.COLUMNS["part"]).parquet(f"{sf_dir}/part.parquet")
    return rows.select(F.col("p_partkey").alias("id"))


def _generated(job: Callable[..., DataFrame], products: bool = False):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frames = [generate.gen_customers(_customer_ids(spark, sf_dir))]
        if products:
            frames.append(generate.gen_products(_product_ids(spark, sf_dir)))
        return job(*frames, date(2026, 3, 8))

    return run


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every free text of the given tables, cleaned whole."""

    def read(table: str, *key: str, text: str = "text") -> DataFrame:
        columns = ", ".join(f"{k} bigint" for k in key) + f", {text} string"
        return spark.read.schema(columns).parquet(f"{sf_dir}/{table}.parquet").select(
            F.lit(table).alias("source"),
            F.concat_ws("/", *[F.col(k).cast("string") for k in key]).alias("row_id"),
            clean_text(F.col(text)).alias("cleaned"),
        )

    return stacked(
        [
            read("documents", "doc_id"),
            read("benchmark", "item_id"),
            read("conversations", "conv_id", "turn"),
            read("pages", "page_id", text="html"),
        ]
    )


def _definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One definition document per event, with an encoded JSON part (broken for errors), an encoded
    text part (broken for some) and a part that is not encoded; some documents are cut off."""
    name = "concat('items/', event_id, '/"
    events = spark.read.schema(star.COLUMNS["events"]).parquet(f"{sf_dir}/events.parquet")
    return events.selectExpr(
        "event_id AS item",
        f"""to_json(struct(struct(array(
            struct({name}definition.json') AS path,
                   base64(cast(if(event_type = 'error', concat('broken ', props), props) AS binary))
                     AS payload,
                   'InlineBase64' AS payloadType),
            struct({name}notes.txt') AS path,
                   if(event_id % 59 = 0, '%%%', base64(cast(props AS binary))) AS payload,
                   'InlineBase64' AS payloadType),
            struct('.platform' AS path, event_type AS payload, 'InlineText' AS payloadType)
        ) AS parts) AS definition)) AS whole""",
    ).selectExpr("item", "if(item % 53 = 0, substr(whole, 1, 30), whole) AS document")


def _definition_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return definition_parts(_definitions(spark, sf_dir), "item", "document")


def _definition_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return definition_documents(_definitions(spark, sf_dir), "item", "document")


def _documents_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definition documents written, one a line, read back and compared."""
    documents = _definition_documents(spark, sf_dir).where("document IS NOT NULL").select("document")
    path = scratch_path(spark, "documents")
    write_documents(documents, path)
    return exchange.difference(documents, read_documents(spark, path))


def _model_parts(spark: SparkSession) -> DataFrame:
    document = literal_table(spark, [("item", TEXT), ("document", TEXT)], [("model", MODEL_DOCUMENT)])
    return definition_parts(document, "item", "document")


def _model(spark: SparkSession, sf_dir: str):
    """The model as its own definition document, read back, and the tables it binds."""
    return load_model(_model_parts(spark)), star.load(spark, sf_dir)


def _model_folder(spark: SparkSession, sf_dir: str):
    """The model as a folder with a file for each part, read back, and the tables it binds."""
    path = scratch_path(spark, "model")
    write_folder(_model_parts(spark), path)
    return load_model(read_folder(spark, path)), star.load(spark, sf_dir)


def _defined_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, tables = _model(spark, sf_dir)
    return ontology.entity_index(tables, model.entities)


def _defined_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, tables = _model(spark, sf_dir)
    return ontology.edges(tables, model.relationships)


def _folder_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, tables = _model_folder(spark, sf_dir)
    return ontology.entity_index(tables, model.entities)


def _folder_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, tables = _model_folder(spark, sf_dir)
    return ontology.edges(tables, model.relationships)


def _broken_lines(t: Tables) -> DataFrame:
    """Support activities as lines of an exchange file, some of them broken in one way or another."""
    return t.support_activities.selectExpr(
        """concat_ws('\t', activity_id, if(activity_id % 73 = 0, 'T?', cast(ticket_id AS string)),
            if(activity_id % 97 = 0, '2000-13-45', cast(activity_at AS string)),
            if(activity_id % 83 = 0, '', description), author, activity_type,
            concat(minutes_spent, if(activity_id % 89 = 0, '.5', '')),
            if(activity_id % 79 = 0, 'one more', NULL)) AS line"""
    )


ACTIVITIES = T.StructType(
    [
        T.StructField("activity_id", T.LongType(), False),
        T.StructField("ticket_id", T.LongType(), False),
        T.StructField("activity_at", T.DateType(), False),
        T.StructField("description", T.StringType(), False),
        T.StructField("author", T.StringType()),
        T.StructField("activity_type", T.StringType()),
        T.StructField("minutes_spent", T.IntegerType()),
    ]
)


def _imported(spark: SparkSession, sf_dir: str) -> tuple[Tables, DataFrame, DataFrame]:
    t = star.load(spark, sf_dir)
    path = scratch_path(spark, "lines")
    _broken_lines(t).write.text(path)
    return t, *tsv.read_with_rejects(spark, path, ACTIVITIES, header=False)


def _import_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of a file that are not fit for its table, and why."""
    _, _, rejects = _imported(spark, sf_dir)
    return rejects.select("record", "reason")


def _import_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the same file that are, compared with the unbroken ones."""
    t, good, _ = _imported(spark, sf_dir)
    fit = " AND ".join(f"activity_id % {n} <> 0" for n in (73, 79, 83, 89, 97))
    return exchange.difference(t.support_activities.where(fit), good)


def _markdown(t: Tables) -> DataFrame:
    """Open opportunities of every customer, a table for each closing year under the customer's
    name."""
    rows = (
        t.sales_opportunities.where(F.col("status") == "Open")
        .join(t.customers, "customer_id")
        .select(
            "customer_id",
            "customer_name",
            "opp_id",
            "type",
            "expected_close_date",
            "amount",
            "is_forecast",
            "renewal_term_months",
        )
    )
    rows = rows.withColumn("close_year", F.year("expected_close_date"))
    return truth.markdown_render(
        rows, ["customer_id", "close_year"], ["opp_id"], title="customer_name"
    )


def _ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truth.ground_truth(star.load(spark, sf_dir), SEEDS)


def _ground_truth_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exchange.answers_roundtrip(spark, _ground_truth(spark, sf_dir))


def _question_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seed varied over all closing months and all product lines of the data."""
    t = star.load(spark, sf_dir)
    seed_ids = [row[0] for row in PHRASINGS]
    seeds = literal_table(spark, [("seed_id", TEXT)], [(s,) for s in dict.fromkeys(seed_ids)])
    phrasings = literal_table(
        spark, [("seed_id", TEXT), ("phrasing_no", INT), ("template", TEXT)], PHRASINGS
    )
    months = t.sales_opportunities.select(
        F.lit("horizon").alias("kind"),
        F.date_format("expected_close_date", "yyyy-MM").alias("value"),
    )
    lines = t.products.select(F.lit("product").alias("kind"), F.col("product_line").alias("value"))
    overrides = literal_table(
        spark,
        [("kind", TEXT), ("value", TEXT)],
        [("policy", f"{p.window_start:%Y-%m} with {p.activity_days} quiet days") for p in SLIP_SWEEP],
    )
    each_seed = F.explode(F.array(*[F.lit(s) for s in dict.fromkeys(seed_ids)])).alias("seed_id")
    variants = months.unionByName(lines).unionByName(overrides).distinct().select("kind", "value", each_seed)
    return truth.question_variants(seeds, variants, phrasings)


EXPECTED = "expected"
RUNS = ["stale stages only", "exact tags"]


def _asked_policies(run: str, **overrides) -> list[SlipPolicy]:
    """The monthly questions as one run asks them, and one that no opportunity answers."""
    nothing = SlipPolicy(
        *month_window(2030, 1), as_of=AS_OF, base=date(2030, 1, 1), policy_id="2030-01", **overrides
    )
    return [
        replace(p, policy_id=f"{run}/{p.policy_id}")
        for p in [*monthly_policies(**overrides), nothing]
    ]


def _eval_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs that answer under other policies than the expected ones, in one sweep."""
    policies = [
        *_asked_policies(EXPECTED),
        *_asked_policies(RUNS[0], stagnant_days=60),
        *_asked_policies(RUNS[1], exact_tag="risk"),
    ]
    swept = slip.slip_sweep(star.load(spark, sf_dir), policies)
    answers = swept.withColumn("run", F.substring_index("policy_id", "/", 1)).withColumn(
        "policy_id", F.substring_index("policy_id", "/", -1)
    )
    asked = [(p.policy_id.split("/")[1],) for p in _asked_policies(EXPECTED)]
    questions = literal_table(spark, [("policy_id", TEXT)], asked)
    return evaluate.eval_scores(answers, questions, "policy_id", EXPECTED, RUNS)


def _stored(spark: SparkSession, *results: DataFrame) -> DataFrame:
    """Results saved one after the other to a named table that keeps runs apart, and what it holds.
    The name goes again; the files stay as long as the process."""
    schema = f"evaluation_{uuid.uuid4().hex}"
    spark.sql(f"CREATE SCHEMA {schema}")
    name, path = f"{schema}.results", scratch_path(spark, "results")
    for frame in results:
        catalog.save_run(frame, name, path=path)
    kept = spark.table(name).schema
    catalog.drop(spark, [name], schema)
    return spark.read.schema(kept).parquet(path)


def _stored_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of both runs, written by one sweep and read back."""
    return _stored(spark, _eval_scores(spark, sf_dir))


def _replaced_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A results table after its first run was written a second time, with the scores that it had
    not had before: every run is there once, the first one as it was written last."""
    scores = spark.read.parquet(_written(_eval_scores(spark, sf_dir)))
    first = F.col("evaluation_id") == RUNS[0]
    early = scores.withColumn("score", F.when(first, 1).otherwise(F.col("score")))
    return _stored(spark, early, scores.where(first))


def _written(df: DataFrame) -> str:
    path = scratch_path(df.sparkSession, "scores")
    df.write.parquet(path)
    return path


def _cell_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of one sweep, changed by a little or a lot, scored cell by cell."""
    swept = slip.slip_sweep(star.load(spark, sf_dir), _asked_policies(EXPECTED)).withColumn(
        "policy_id", F.substring_index("policy_id", "/", -1)
    )

    def answer(run, **changed):
        own = [changed.get(c, F.col(c)).alias(c) for c in swept.columns]
        return F.struct(run.alias("run"), *own)

    no_text = F.lit(None).cast("string")
    other = {"type": no_text, "stage": no_text, "forecast_category": F.lit("?"), "amount": F.col("amount") * 2}
    late = F.date_format(F.add_months(F.to_date(F.concat("policy_id", F.lit("-01"))), 1), "yyyy-MM")
    answers = swept.select(
        F.inline(
            F.array(
                answer(F.lit(EXPECTED)),
                answer(F.lit("to the cent"), amount=F.col("amount") + 0.004),
                answer(F.lit("an eighth off"), amount=F.when(F.col("opp_id") % 8 == 0, 0.0).otherwise(F.col("amount"))),
                answer(F.lit("other values"), **other, **{f: 1 - F.col(f) for f in slip.FLAGS}),
                answer(F.when(F.col("opp_id") % 3 == 0, "a third")),
                answer(F.lit("a month late"), policy_id=late),
            )
        )
    ).where("run IS NOT NULL")
    asked = [(p.policy_id.split("/")[1],) for p in _asked_policies(EXPECTED)]
    questions = literal_table(spark, [("policy_id", TEXT)], asked)
    runs = ["to the cent", "an eighth off", "other values", "a third", "a month late"]
    return evaluate.cell_scores(answers, questions, "policy_id", ["opp_id"], EXPECTED, runs)


ACCELERATE_SWEEP = [
    replace(ACCELERATE, policy_id="second half"),
    AcceleratePolicy(
        *month_window(2000, 1, 6), stage="Negotiation", min_delivered=2, blocking_signal="neutral",
        require_forecast=True, policy_id="first half, two visits",
    ),
    AcceleratePolicy(*month_window(2000, 1, 12), delivered_types=("call",), product_id=5, policy_id="product 5"),
]


def _answered_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three questions, three variants of each, three phrasings: the policies of each question in
    one pass, and the answers of every case."""
    t = star.load(spark, sf_dir)
    policies = {
        "slip": (variants.slip_answers, SLIP_SWEEP),
        "renewal": (variants.renewal_answers, RENEWAL_SWEEP),
        "accelerate": (variants.accelerate_answers, ACCELERATE_SWEEP),
    }
    asked = [case[3] for case in CASES]
    answers = {
        seed: job(t, variants.policy_table(spark, [p for p in sweep if p.policy_id in asked]))
        for seed, (job, sweep) in policies.items()
    }
    cases = literal_table(
        spark, [("seed_id", TEXT), ("kind", TEXT), ("value", TEXT), ("policy_id", TEXT)], CASES
    )
    phrasings = literal_table(
        spark, [("seed_id", TEXT), ("phrasing_no", INT), ("template", TEXT)], PHRASINGS
    )
    return variants.answered_variants(cases, phrasings, answers, dict.fromkeys(answers, ["opp_id"]))


def _eval_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written answers against those to questions asked a little differently: the expected side is
    read from the file of questions and answers."""
    tables = star.load(spark, sf_dir)
    path = scratch_path(spark, "answers")
    write_answers(truth.ground_truth(tables, SEEDS).where("part = 'all'"), path)
    schema = "question string, sql string, part string, result string"
    expected = evaluation_input(read_answers(spark, path, schema))
    changed = [replace(s, statements=(ALTERED.get(s.question, s.statements[0]), *s.statements[1:])) for s in SEEDS]
    actual = truth.ground_truth(tables, changed).where("part = 'all'")
    answers = evaluate.answer_lines(
        expected.withColumnRenamed("expected_answer", "answer"), EXPECTED
    ).union(evaluate.answer_lines(actual.select("question", F.col("result").alias("answer")), "altered"))
    return evaluate.eval_scores(answers, expected, "question", EXPECTED, ["altered"])


def _catalog_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tables saved below a schema, read by `schema.table` and compared."""
    tables = star.load(spark, sf_dir)
    schema = f"exchange_{uuid.uuid4().hex}"
    root = scratch_path(spark, "catalog")
    copy = catalog.save_all(spark, tables, schema, root=root)
    opened = {name: spark.read.schema(df.schema).parquet(f"{root}/{name}") for name, df in copy.items()}
    catalog.drop(spark, [f"{schema}.{name}" for name in Tables.names()], schema)
    return exchange.differences(tables, Tables(spark, opened))


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the open opportunities most likely to slip, and why."""
    return slip.slip_risk_top(star.load(spark, SF_DIR), SLIP)


def _optional(module: str):
    """A module, or None where it is not there; any other import error is one."""
    try:
        return importlib.import_module(module)
    except ModuleNotFoundError as missing:
        if missing.name not in (module, "pipewright.llm"):
            raise
        return None


def _training_data() -> tuple[dict, dict]:
    """Queries and SQL of the optional subpackage and of the pipeline over it."""
    jobs, sql = {}, {}
    if llm := _optional("pipewright.llm.queries"):
        jobs, sql = llm.queries(), llm.oracle_sql()
    if pipe := _optional("corpus_pipeline"):
        jobs["pipeline"] = pipe.run
        if pipe.ORACLE_SQL:
            sql["pipeline"] = pipe.ORACLE_SQL
    return jobs, sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    jobs = {
        "opp_last_activity": activity.opp_last_activity,
        "ticket_last_activity": activity.ticket_last_activity,
        "delivered_activities": activity.delivered_activities,
        "never_active": activity.never_active,
        "stage_age": lambda t: activity.stage_age(t, AS_OF),
        "risk_notes": lambda t: slip.risk_notes(t, SLIP),
        "high_sev_keys": lambda t: slip.high_sev_keys(t, SLIP),
        "slip_risk_flags": lambda t: slip.slip_risk_flags(t, SLIP),
        "slip_risk_top10": lambda t: slip.slip_risk_top(t, SLIP),
        "slip_risk_reasons": lambda t: slip.slip_risk_reasons(t, SLIP),
        "policy_sweep": lambda t: slip.slip_sweep(t, SLIP_SWEEP),
        "policy_sweep_renewals": lambda t: renewal.renewal_sweep(t, RENEWAL_SWEEP),
        "expansion_pipeline": renewal.expansion_pipeline,
        "open_incidents": renewal.open_incidents,
        "renewal_risk": lambda t: renewal.renewal_risk(t, RENEWAL),
        "renewal_risk_full": lambda t: renewal.renewal_risk_full(t, RENEWAL),
        "latest_csat": renewal.latest_csat,
        "csat_last_month": lambda t: renewal.csat_last_month(t, AS_OF),
        "sla_breaches": renewal.sla_breaches,
        "note_digest": notes.note_digest,
        "tag_counts": notes.tag_counts,
        "accelerate": lambda t: accelerate.accelerate(t, ACCELERATE),
        "customer_360_opps": customer360.customer_360_opps,
        "customer_360_tickets": customer360.customer_360_tickets,
        "customer_top_opps": customer360.customer_top_opps,
        "critical_ticket_actions": customer360.critical_ticket_actions,
        "customer_360_opps_scoped": lambda t: customer360.customer_360_opps(
            t, customer_id=1, product_id=6
        ),
        "customer_360_tickets_scoped": lambda t: customer360.customer_360_tickets(
            t, customer_id=2, product_id=72
        ),
        "critical_ticket_actions_scoped": lambda t: customer360.critical_ticket_actions(
            t, customer_id=7
        ),
        "pipeline_health": pipeline.pipeline_health,
        "pipeline_by_line": pipeline.pipeline_by_line,
        "support_performance": pipeline.support_performance,
        "entity_index": ontology.entity_index,
        "entity_timeseries": ontology.entity_timeseries,
        "edges": ontology.edges,
        "entity_degree": ontology.entity_degree,
        "traverse_path_customer_ticket_product": lambda t: ontology.traverse(
            t, ["has_ticket", "has_support_product"]
        ),
        "traverse_path_customer_opportunity_note": lambda t: ontology.traverse(
            t, ["has_opportunity", "has_opportunity_note"]
        ),
        "traverse_path_customer_opportunity_product": lambda t: ontology.traverse(
            t, ["has_opportunity", "has_opportunity_product"]
        ),
        "traverse_path_customer_opportunity_activity": lambda t: ontology.traverse(
            t, ["has_opportunity", "has_opportunity_activity"]
        ),
        "traverse_path_customer_ticket_activity": lambda t: ontology.traverse(
            t, ["has_ticket", "has_support_activity"]
        ),
        "route_product_to_customer": lambda t: ontology.connected(t, "product", "customer"),
        "route_note_to_product": lambda t: ontology.connected(t, "sales_note", "product"),
        "note_digest_whole": lambda t: notes.note_digest(t, whole=True),
        "accelerate_whole": lambda t: accelerate.accelerate(t, ACCELERATE, whole=True),
        "customer_360_opps_whole": lambda t: customer360.customer_360_opps(t, whole=True),
        "critical_ticket_actions_whole": lambda t: customer360.critical_ticket_actions(t, whole=True),
        "policy_table_slip": lambda t: variants.slip_answers(
            t, variants.policy_table(t.spark, SLIP_SWEEP)
        ),
        "policy_table_renewals": lambda t: variants.renewal_answers(
            t, variants.policy_table(t.spark, RENEWAL_SWEEP)
        ),
        "policy_table_accelerate": lambda t: variants.accelerate_answers(
            t, variants.policy_table(t.spark, ACCELERATE_SWEEP)
        ),
        "vocab_violations": checks.vocab_violations,
        "orphan_rows": checks.orphan_rows,
        "key_violations": checks.key_violations,
        "range_violations": checks.range_violations,
        "markdown_render": _markdown,
        "table_counts": exchange.table_counts,
    }
    for name in ontology.ENTITIES:
        jobs[f"entity_view_{name}"] = lambda t, name=name: ontology.entity_view(t, name)
    generators = {
        "gen_csat": generate.gen_csat,
        "gen_support_activities": generate.gen_support_activities,
        "gen_sales_activities": generate.gen_sales_activities,
        "gen_notes": generate.gen_notes,
    }
    return {
        **{name: _on_tables(job) for name, job in jobs.items()},
        **{name: _generated(job) for name, job in generators.items()},
        "gen_tickets": _generated(generate.gen_tickets, products=True),
        "gen_opportunities": _generated(generate.gen_opportunities, products=True),
        "gen_dimensions": lambda spark, sf_dir: generate.gen_dimensions(
            _customer_ids(spark, sf_dir), _product_ids(spark, sf_dir)
        ),
        "gen_distributions": lambda spark, sf_dir: distributions.distribution_report(
            generate.generate(
                _customer_ids(spark, sf_dir), _product_ids(spark, sf_dir), date(2026, 3, 8)
            )
        ),
        "clean_text": _texts,
        "definition_parts": _definition_parts,
        "definition_documents": _definition_documents,
        "documents_roundtrip": _documents_roundtrip,
        "entity_index_from_definition": _defined_entities,
        "edges_from_definition": _defined_edges,
        "entity_index_from_folder": _folder_entities,
        "edges_from_folder": _folder_edges,
        "import_rejects": _import_rejects,
        "import_loaded": _import_loaded,
        "answered_variants": _answered_variants,
        "eval_cell_scores": _cell_scores,
        "eval_runs_replaced": _replaced_runs,
        "tsv_roundtrip": lambda spark, sf_dir: exchange.tsv_roundtrip(
            spark, star.load(spark, sf_dir)
        ),
        "ground_truth": _ground_truth,
        "ground_truth_roundtrip": _ground_truth_roundtrip,
        "question_variants": _question_variants,
        "eval_scores": _eval_scores,
        "eval_details": lambda spark, sf_dir: evaluate.eval_details(_stored_scores(spark, sf_dir)),
        "eval_summary": lambda spark, sf_dir: evaluate.eval_summary(_stored_scores(spark, sf_dir)),
        "eval_written_answers": _eval_written,
        "catalog_roundtrip": _catalog_roundtrip,
        **_training_data()[0],
    }


def oracle_sql() -> dict[str, str]:
    return {**oracle_statements(), **_training_data()[1]}
