"""Questions answered from tables of policies.

A policy is a row, so variants of a question may come from a file or another job. One pass over the
facts answers all of them: what a policy may ask for is kept by key in small maps (latest day by
signal or severity, amount or count by type), and each row looks up what its policy names.
"""

from __future__ import annotations

from dataclasses import asdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pipewright.functions.dates import older_than
from pipewright.functions.text import clean_text, flag, mentions_risk, tag_list
from pipewright.operators.lookups import latest, money, with_names
from pipewright.operators.sweep import with_close_month
from pipewright.plans import slip
from pipewright.plans.notes import last_signals
from pipewright.plans.renewal import DETAIL as RENEWAL_DETAIL
from pipewright.plans.truth import clean_text_literal, header, markdown_render
from pipewright.policy import AcceleratePolicy, RenewalPolicy, SlipPolicy
from pipewright.sources.literal import BOOL, DAY, DOUBLE, INT, TEXT, literal_table
from pipewright.tables import Tables

TEXTS = pa.list_(TEXT)
ACCELERATE_DETAIL = (
    "opp_id",
    "customer_name",
    "expected_close_date",
    "is_forecast",
    "product_name",
    "last_signal",
)

# Columns of a table of policies, by kind of question. Each row is one variant.
COLUMNS = {
    SlipPolicy: [
        ("policy_id", TEXT),
        ("window_start", DAY),
        ("window_end", DAY),
        ("as_of", DAY),
        ("base", DAY),
        ("activity_days", INT),
        ("stagnant_days", INT),
        ("signal_days", INT),
        ("severities", TEXTS),
        ("exact_tag", TEXT),
        ("product_id", TEXT),
    ],
    RenewalPolicy: [
        ("policy_id", TEXT),
        ("window_start", DAY),
        ("window_end", DAY),
        ("expansion_limit", DOUBLE),
        ("incident_min", INT),
        ("severities", TEXTS),
        ("expansion_types", TEXTS),
        ("open_only", BOOL),
        ("product_id", TEXT),
    ],
    AcceleratePolicy: [
        ("policy_id", TEXT),
        ("window_start", DAY),
        ("window_end", DAY),
        ("stage", TEXT),
        ("delivered_types", TEXTS),
        ("min_delivered", INT),
        ("blocking_signal", TEXT),
        ("require_forecast", BOOL),
        ("product_id", TEXT),
    ],
}


def policy_table(spark: SparkSession, policies: list) -> DataFrame:
    """Policies given in the program as the table that the answers below take. They are all of one
    kind."""
    columns = COLUMNS[type(policies[0])]

    def value(policy, name: str, kind: pa.DataType):
        found = asdict(policy)[name]
        return str(found) if kind == TEXT and found is not None else found

    rows = [tuple(value(p, name, kind) for name, kind in columns) for p in policies]
    return literal_table(spark, columns, rows)


def _asked(opps: DataFrame, policies: DataFrame) -> DataFrame:
    """Opportunities with each policy whose window and product they fit, by an equi-join on the
    closing month."""
    # A policy asks for the months that its window touches; an empty window for none.
    months = F.when(
        F.col("window_start") < F.col("window_end"),
        F.sequence(
            F.trunc("window_start", "MM"),
            F.trunc(F.date_sub("window_end", 1), "MM"),
            F.expr("interval 1 month"),
        ),
    )
    wanted = (
        policies.withColumnRenamed("product_id", "wanted_product")
        .withColumn("close_month", F.explode(months))
        # True for every month of a window; it tells Spark that policies select some months only.
        .where(F.col("close_month") < F.col("window_end"))
    )
    return (
        with_close_month(opps)
        .join(wanted, "close_month")
        .where(
            (F.col("expected_close_date") >= F.col("window_start"))
            & (F.col("expected_close_date") < F.col("window_end"))
            & (
                F.col("wanted_product").isNull()
                | (F.col("product_id").cast("string") == F.col("wanted_product"))
            )
        )
    )


def _by_label(df: DataFrame, keys: list[str], label: str, value: Column, out: str) -> DataFrame:
    """(keys, out): a map from each label to an aggregate of its rows. Rows are added up by key and
    label first, so a map has an entry for each label and no more."""
    return (
        df.groupBy(*keys, label)
        .agg(value.alias("_value"))
        .groupBy(*keys)
        .agg(F.map_from_entries(F.collect_list(F.struct(label, "_value"))).alias(out))
    )


def _summed(values: str, names: str, kind: str) -> Column:
    """What a map holds for all of some names together, each counted once."""
    found = F.transform(
        F.array_distinct(names), lambda n: F.coalesce(F.try_element_at(values, n), F.lit(0).cast(kind))
    )
    return F.coalesce(
        F.aggregate(found, F.lit(0).cast(kind), lambda a, b: (a + b).cast(kind)), F.lit(0).cast(kind)
    )


def slip_answers(t: Tables, policies: DataFrame) -> DataFrame:
    """`slip_risk_flags` for every row of a table of policies: (policy_id, detail, flags)."""
    risky = mentions_risk(F.col("note_type"), F.col("tags"))
    asked_tags = policies.where("exact_tag IS NOT NULL").select(
        F.concat(F.lit("tag "), "exact_tag").alias("label")
    )
    labels = literal_table(t.spark, [("label", TEXT)], [("any",), ("type",)]).union(asked_tags).distinct()
    # What a note may count as: risk by type or any tag, risk by type, and each of its tags.
    named = F.array_compact(
        F.concat(
            F.array(F.when(risky, F.lit("any")), F.when(F.col("note_type") == "risk", F.lit("type"))),
            F.transform(F.coalesce(tag_list(F.col("tags")), F.array()), lambda x: F.concat(F.lit("tag "), x)),
        )
    )
    notes = t.opportunity_notes.select("opp_id", "note_at", F.explode(named).alias("label"))
    signals = _by_label(
        notes.join(labels, "label", "left_semi"), ["opp_id"], "label", F.max("note_at"), "signals"
    )
    tickets = _by_label(
        t.support_tickets.where(F.col("status") == "Open"),
        ["customer_id", "product_id"],
        "severity",
        F.max("opened_at"),
        "opened",
    )
    opps = t.sales_opportunities.where(F.col("status") == "Open")
    facts = (
        _asked(opps, policies)
        .join(latest(t.sales_activities, ["opp_id"], "activity_at", "last_activity_at"), "opp_id", "left")
        .join(signals, "opp_id", "left")
        .join(tickets, ["customer_id", "product_id"], "left")
    )
    last, bound = F.col("last_activity_at"), F.date_sub(F.col("base"), F.col("signal_days"))
    noted = F.when(F.col("exact_tag").isNull(), F.try_element_at("signals", F.lit("any"))).otherwise(
        F.greatest(
            F.try_element_at("signals", F.lit("type")),
            F.try_element_at("signals", F.concat(F.lit("tag "), "exact_tag")),
        )
    )
    severe = F.exists(
        "severities", lambda s: F.coalesce(F.try_element_at("opened", s) >= bound, F.lit(False))
    )
    return with_names(facts, t.customers, t.products).select(
        "policy_id",
        *slip.DETAIL,
        flag(last.isNull() | older_than(last, F.col("as_of"), F.col("activity_days"))).alias(slip.FLAGS[0]),
        flag(older_than(F.col("stage_last_changed_at"), F.col("as_of"), F.col("stagnant_days"))).alias(
            slip.FLAGS[1]
        ),
        flag((noted >= bound) | severe).alias(slip.FLAGS[2]),
    )


def renewal_answers(t: Tables, policies: DataFrame) -> DataFrame:
    """`renewal_risk` for every row of a table of policies: (policy_id, detail, flags)."""
    open_opps = t.sales_opportunities.where(F.col("status") == "Open")
    amounts = _by_label(open_opps, ["customer_id"], "type", F.sum(money("amount")), "amounts")
    tickets = t.support_tickets.where((F.col("status") == "Open") & F.col("severity").isNotNull())
    incidents = _by_label(tickets, ["customer_id"], "severity", F.count("*"), "incidents")
    renewals = t.sales_opportunities.where(F.col("type") == "Renewal")
    matched = (
        _asked(renewals, policies)
        .where(~F.col("open_only") | (F.col("status") == "Open"))
        .join(amounts, "customer_id", "left")
        .join(incidents, "customer_id", "left")
        .withColumns(
            {
                "expansion_amount": _summed("amounts", "expansion_types", "decimal(28,2)").cast("double"),
                "num_incidents": _summed("incidents", "severities", "bigint"),
            }
        )
    )
    return (
        with_names(matched, t.customers, t.products)
        .select(
            "policy_id",
            *RENEWAL_DETAIL,
            flag(F.col("expansion_amount") < F.col("expansion_limit")).alias("low_expansion_flag"),
            flag(F.col("num_incidents") >= F.col("incident_min")).alias("high_incident_flag"),
        )
        .where("low_expansion_flag = 1 OR high_incident_flag = 1")
    )


def accelerate_answers(t: Tables, policies: DataFrame) -> DataFrame:
    """Deals to pull forward, without their notes, for every row of a table of policies."""
    delivered = _by_label(
        t.sales_activities.where("type IS NOT NULL"), ["opp_id"], "type", F.count("*"), "delivered"
    )
    opps = t.sales_opportunities.where(F.col("status") == "Open").withColumnRenamed("stage", "_stage")
    matched = (
        _asked(opps, policies)
        .where((F.col("_stage") == F.col("stage")) & (~F.col("require_forecast") | F.col("is_forecast")))
        .join(delivered, "opp_id")
        .where(
            F.greatest(F.col("min_delivered"), F.lit(1)) <= _summed("delivered", "delivered_types", "bigint")
        )
        .join(last_signals(t), "opp_id", "left")
        .where(~F.col("last_signal").eqNullSafe(F.col("blocking_signal")))
        .join(t.customers.select("customer_id", "customer_name"), "customer_id")
    )
    return with_names(matched, products=t.products).select("policy_id", *ACCELERATE_DETAIL)


def rendered(answers: DataFrame, order: list[str]) -> DataFrame:
    """(policy_id, part, answer): the answer rows of each policy as Markdown, a table for each
    closing month."""
    by_month = answers.withColumn("part", F.date_format("expected_close_date", "yyyy-MM"))
    tables = markdown_render(by_month.select("policy_id", "part", *answers.columns[1:]), ["policy_id", "part"], order)
    return tables.withColumnRenamed("markdown", "answer")


def answered_variants(
    variants: DataFrame, phrasings: DataFrame, answers: dict[str, DataFrame], orders: dict[str, list[str]]
) -> DataFrame:
    """Test cases: (seed_id, kind, value, phrasing_no, question, part, answer).

    `variants(seed_id, kind, value, policy_id)` name the policy that answers them, and
    `phrasings(seed_id, phrasing_no, template)` put each into words; `{value}` is replaced by the
    varied parameter. `answers` has the rows of each seed by policy, all policies swept together.
    Each policy's tables are rendered once, however many phrasings ask for them. A variant without
    rows has the part `none` and the head of its table.
    """
    texts, heads = [], []
    for seed, rows in answers.items():
        texts.append(rendered(rows, orders[seed]).select(F.lit(seed).alias("seed_id"), "*"))
        heads.append((seed, clean_text_literal(header(list(rows.columns[1:]))) + "\n"))
    text = texts[0]
    for further in texts[1:]:
        text = text.unionByName(further)
    head = literal_table(variants.sparkSession, [("seed_id", TEXT), ("head", TEXT)], heads)
    asked = variants.join(text, ["seed_id", "policy_id"], "left").join(head, "seed_id")
    return asked.join(phrasings, "seed_id").select(
        "seed_id",
        "kind",
        "value",
        "phrasing_no",
        clean_text(F.replace("template", F.lit("{value}"), F.col("value"))).alias("question"),
        F.coalesce("part", F.lit("none")).alias("part"),
        F.coalesce("answer", F.btrim("head", F.lit("\n"))).alias("answer"),
    )
