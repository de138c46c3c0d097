"""Synthetic sales and support data of any size.

Every table is computed from a frame of customers by projections and short per-row explodes; the
customer rows are shuffled to spread the work, and tickets and opportunities meet their product by
its drawn place. All randomness is drawn from the row's own keys, so the output is the same for any
number of executors.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipewright.functions.dates import day
from pipewright.functions.draws import (
    chance,
    entropy,
    pick,
    pick_weighted,
    shifted,
    uniform_int,
    wide_int,
)
from pipewright.tables import Tables

# Names and vocabularies of the synthetic business.
CUSTOMERS = (
    ("Banco Aurora", "IT"),
    ("Cassa Nova", "IT"),
    ("EuroTrust Bank", "DE"),
    ("Mediterraneo Credito", "ES"),
    ("Alpine Bank", "CH"),
)
PRODUCTS = (
    ("Account Ledger", "Core Banking Suite"),
    ("Loan Origination", "Core Banking Suite"),
    ("Customer 360", "Core Banking Suite"),
    ("AML Monitor", "Risk & Compliance"),
    ("KYC Orchestrator", "Risk & Compliance"),
    ("Stress Test Pro", "Risk & Compliance"),
    ("Real-Time Payments", "Payments & Treasury"),
    ("Treasury Manager", "Payments & Treasury"),
)
SEVERITIES = (("Low", 40), ("Medium", 35), ("High", 20), ("Critical", 5))
PRIORITY_OF = (("Low", "P4"), ("Medium", "P3"), ("High", "P2"), ("Critical", "P1"))
CHANNELS = ("Portal", "Email", "Phone")
GROUPS = ("L1 Support", "L2 Support", "AML Specialists")
SUPPORT_STEPS = (
    "Acknowledged issue",
    "Requested logs",
    "Provided workaround",
    "Patch applied",
    "Escalated to L2",
    "Awaiting customer response",
)
AUTHORS = ("agent.john", "agent.ana", "agent.samir", "agent.luca")
SUPPORT_TYPES = ("comment", "worknote", "escalation")
OPP_TYPES = ("Renewal", "Expansion", "Project")
OPP_STATUSES = ("Open", "Won", "Lost")
STAGES = ("Qualification", "Discovery", "Proposal", "Negotiation", "Procurement")
CATEGORIES = ("Pipeline", "BestCase", "Commit")
AMOUNTS = (25000.0, 40000.0, 60000.0, 85000.0, 120000.0, 180000.0)
OPEN_PROBABILITIES = (30, 40, 50, 60, 70)
SALES_STEPS = (
    "Intro call with bank stakeholders",
    "Demo delivered to ops team",
    "Proposal shared with legal",
    "Negotiation on pricing",
    "Security questionnaire sent",
    "Management review scheduled",
)
SALES_TYPES = ("call", "demo", "email", "meeting")
STALE_STEPS = ("Follow-up email", "Internal review", "Waiting on customer")
STALE_TYPES = ("email", "meeting", "call")
STALE_AGES = (15, 21, 28)
CONTACTS = ("CIO", "Head of Compliance", "Procurement", "IT Manager")
RISK_TEXT = "Delivery risk flagged: scope creep and integration uncertainty."
RISK_TAGS = "delivery risk;scope creep;integration"
TRENDING = 2  # position of the customer whose tickets pile up recently
MAX_TICKETS, MAX_OPPS, MAX_CHILDREN = 65, 18, 5
PRODUCT_BUCKETS = 1024

SEED = 42




def _season_start(as_of: date) -> date:
    return date(as_of.year - 1, 7, 1)


def _at(values: tuple, position: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (position + 1).cast("int"))


def _day_between(digits: Column, i: int, start: date, end: date) -> Column:
    return F.date_add(day(start), uniform_int(digits, i, 0, (end - start).days))


def _numbered(df: DataFrame, count: Column, column: str) -> DataFrame:
    # sequence(1, 0) would count down, so rows without children are dropped first.
    return df.where(count > 0).withColumn(column, F.explode(F.sequence(F.lit(1), count)))


def _label(prefix: str, first: int, number: Column) -> Column:
    return F.concat(F.lit(prefix), (F.lit(first) + number).cast("string"))


def gen_customers(ids: DataFrame) -> DataFrame:
    """One synthetic customer per row of `ids(id)`; beyond the first few, names carry a number."""
    kind = F.col("id") % len(CUSTOMERS)
    name = _at(tuple(n for n, _ in CUSTOMERS), kind)
    return ids.select(
        F.col("id").alias("customer_no"),
        F.format_string("C%03d", F.col("id") + 1).alias("customer_id"),
        F.when(F.col("id") < len(CUSTOMERS), name)
        .otherwise(F.concat(name, F.lit(" "), (F.col("id") + 1).cast("string")))
        .alias("customer_name"),
        _at(tuple(c for _, c in CUSTOMERS), kind).alias("country"),
    )


def gen_products(ids: DataFrame) -> DataFrame:
    """One synthetic product per row of `ids(id)`; beyond the first few, names carry a number."""
    kind = F.col("id") % len(PRODUCTS)
    name = _at(tuple(n for n, _ in PRODUCTS), kind)
    return ids.select(
        F.format_string("P%03d", F.col("id") + 1).alias("product_id"),
        F.when(F.col("id") < len(PRODUCTS), name)
        .otherwise(F.concat(name, F.lit(" "), (F.col("id") + 1).cast("string")))
        .alias("product_name"),
        _at(tuple(line for _, line in PRODUCTS), kind).alias("product_line"),
    )


def gen_dimensions(customer_ids: DataFrame, product_ids: DataFrame) -> DataFrame:
    """Both dimensions in one frame: (dimension, id, name, attribute)."""
    c = gen_customers(customer_ids).select(
        F.lit("customer").alias("dimension"),
        F.col("customer_id").alias("id"),
        F.col("customer_name").alias("name"),
        F.col("country").alias("attribute"),
    )
    p = gen_products(product_ids).select(
        F.lit("product").alias("dimension"),
        F.col("product_id").alias("id"),
        F.col("product_name").alias("name"),
        F.col("product_line").alias("attribute"),
    )
    return c.unionByName(p)


def _spread(customers: DataFrame) -> DataFrame:
    # A customer grows into hundreds of rows, so the few customer rows are dealt out before they
    # grow, to as many tasks as any shuffle has. The number is explicit because AQE would merge such
    # small partitions again.
    tasks = int(customers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return customers.repartition(tasks, "customer_no")


def _numbered_products(products: DataFrame, seed: int) -> DataFrame:
    """(place, product_id, product_name): places from 0 without gaps, by a hash of the id, then the
    id. Ranked within hash buckets, so that no task sorts all products."""
    h = entropy(seed, "product place", F.col("product_id"))
    hashed = products.withColumn("_bucket", wide_int(h, 0, PRODUCT_BUCKETS))
    heads = (
        hashed.groupBy("_bucket")
        .agg(F.count("*").alias("_n"))
        # One row for each bucket.
        .withColumn("_head", F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n"))
    )
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy("product_id")) - 1
    return (
        hashed.withColumn("_within", within)
        .join(heads, "_bucket")
        .select((F.col("_head") + F.col("_within")).alias("place"), "product_id", "product_name")
    )


def _with_product(rows: DataFrame, products: DataFrame, seed: int, label: str, key: str) -> DataFrame:
    """Rows with one of the given products each, all equally likely."""
    n = products.count()
    if not n:
        raise ValueError("there is no product to choose from")
    drawn = rows.withColumn("place", wide_int(entropy(seed, label, F.col(key)), 0, n))
    return drawn.join(_numbered_products(products, seed), "place").drop("place")


def _trending() -> Column:
    return F.col("customer_no") % len(CUSTOMERS) == TRENDING


def gen_csat(customers: DataFrame, as_of: date, seed: int = SEED) -> DataFrame:
    """Twelve scores per customer, 30 days apart, around a base of 3 or 4."""
    base = _spread(customers).withColumn("h", entropy(seed, "csat", F.col("customer_no"))).withColumn(
        "base", uniform_int(F.col("h"), 0, 3, 4)
    )
    rows = _numbered(base, F.lit(12), "m").withColumn(
        "h", entropy(seed, "csat month", F.col("customer_no"), F.col("m"))
    )
    season = F.when(_trending() & F.col("m").isin(2, 3), 1).otherwise(0)
    score = F.col("base") + pick(F.col("h"), 0, (-1, 0, 0, 0, 1)) + season
    return rows.select(
        "customer_id",
        F.date_sub(day(as_of), F.col("m") * 30).alias("month"),
        F.greatest(F.lit(1), F.least(F.lit(5), score)).alias("csat"),
    )


def _tickets(customers: DataFrame, as_of: date, seed: int) -> DataFrame:
    h = F.col("h")
    start = _season_start(as_of)
    rows = _spread(customers).withColumn("h", entropy(seed, "ticket count", F.col("customer_no")))
    rows = _numbered(rows, uniform_int(h, 0, 35, MAX_TICKETS), "n")
    rows = rows.withColumn("ticket_no", F.col("customer_no") * MAX_TICKETS + F.col("n") - 1)
    rows = rows.withColumn("h", entropy(seed, "ticket", F.col("ticket_no"))).withColumn(
        "h2", entropy(seed, "ticket detail", F.col("ticket_no"))
    )
    recent = _day_between(h, 2, as_of - timedelta(days=120), as_of)
    usual = _day_between(h, 2, start, as_of)
    rows = rows.select(
        "ticket_no",
        "customer_id",
        F.when(_trending() & chance(h, 1, 75), recent).otherwise(usual).alias("opened_at"),
        F.when(chance(h, 3, 75), "Closed").otherwise("Open").alias("status"),
        uniform_int(h, 4, 1, 30).alias("days_open"),
        pick_weighted(h, 5, SEVERITIES).alias("severity"),
        pick(h, 6, CHANNELS).alias("channel"),
        chance(h, 7, 30).alias("late"),
        pick(F.col("h2"), 0, GROUPS).alias("assigned_group"),
    )
    return rows


def gen_tickets(
    customers: DataFrame, products: DataFrame, as_of: date, seed: int = SEED
) -> DataFrame:
    """35 to 65 tickets per customer, on any of the products; for the trending customer most are
    recent."""
    severity, status = F.col("severity"), F.col("status")
    priority = F.lit(None).cast("string")
    for name, code in PRIORITY_OF:
        priority = F.when(severity == name, code).otherwise(priority)
    tickets = _tickets(customers, as_of, seed)
    return _with_product(tickets, products, seed, "ticket product", "ticket_no").select(
        _label("T", 1000, F.col("ticket_no")).alias("ticket_id"),
        "customer_id",
        "product_id",
        "status",
        "opened_at",
        F.when(
            status == "Closed", shifted(F.col("opened_at"), F.col("days_open"), day(as_of))
        ).alias("closed_at"),
        "severity",
        priority.alias("priority"),
        "channel",
        F.concat(F.lit("Issue on "), "product_name").alias("title"),
        (severity.isin("High", "Critical") & (status == "Open") & F.col("late")).alias(
            "sla_breach_flag"
        ),
        "assigned_group",
    )


def gen_support_activities(customers: DataFrame, as_of: date, seed: int = SEED) -> DataFrame:
    """Up to five activities per ticket within 30 days of its opening."""
    h = F.col("h")
    rows = (
        _tickets(customers, as_of, seed)
        .select("ticket_no", "opened_at")
        .withColumn("h", entropy(seed, "support count", F.col("ticket_no")))
    )
    rows = _numbered(rows, uniform_int(h, 0, 0, MAX_CHILDREN), "n")
    rows = rows.withColumn("activity_no", F.col("ticket_no") * MAX_CHILDREN + F.col("n") - 1)
    rows = rows.withColumn("h", entropy(seed, "support", F.col("activity_no")))
    return rows.select(
        _label("SA", 20000, F.col("activity_no")).alias("activity_id"),
        _label("T", 1000, F.col("ticket_no")).alias("ticket_id"),
        shifted(F.col("opened_at"), uniform_int(h, 0, 0, 30), day(as_of)).alias("activity_at"),
        pick(h, 1, SUPPORT_STEPS).alias("description"),
        pick(h, 2, AUTHORS).alias("author"),
        pick(h, 3, SUPPORT_TYPES).alias("activity_type"),
        uniform_int(h, 4, 5, 120).alias("minutes_spent"),
    )


def _opportunities(customers: DataFrame, as_of: date, seed: int) -> DataFrame:
    h, h2 = F.col("h"), F.col("h2")
    start = _season_start(as_of)
    rows = _spread(customers).withColumn("h", entropy(seed, "opp count", F.col("customer_no")))
    rows = rows.withColumn("n_opps", uniform_int(h, 0, 10, MAX_OPPS))
    # At most two renewals are forced per customer. Whether an opportunity asks to be forced depends
    # only on its own draw, so a customer's requests fit in one short array and the running count
    # needs no shuffle.
    rows = rows.withColumn(
        "asks",
        F.transform(
            F.sequence(F.lit(1), F.col("n_opps")),
            lambda n: chance(entropy(seed, "force renewal", F.col("customer_no"), n), 0, 25),
        ),
    )
    rows = _numbered(rows, F.col("n_opps"), "n")
    earlier = F.size(F.filter(F.slice("asks", 1, F.col("n") - 1), lambda a: a))
    rows = rows.withColumn("earlier", earlier).withColumn(
        "forced", F.element_at("asks", F.col("n")) & (F.col("earlier") < 2)
    )
    rows = rows.withColumn("opp_no", F.col("customer_no") * MAX_OPPS + F.col("n") - 1)
    rows = rows.withColumn("h", entropy(seed, "opp", F.col("opp_no"))).withColumn(
        "h2", entropy(seed, "opp detail", F.col("opp_no"))
    )
    drawn = pick(h, 1, OPP_TYPES)
    rows = rows.select(
        "opp_no",
        "customer_id",
        "h2",
        F.when(F.col("forced"), "Renewal")
        .when((drawn == "Renewal") & (F.col("earlier") >= 2), pick(h, 2, ("Expansion", "Project")))
        .otherwise(drawn)
        .alias("type"),
        _day_between(h, 3, start, as_of).alias("opened_at"),
        uniform_int(h, 4, 14, 120).alias("close_days"),
        pick(h, 5, OPP_STATUSES).alias("status"),
        pick(h, 6, STAGES).alias("stage"),
        uniform_int(h, 7, 3, 90).alias("stage_days"),
    )
    return rows.withColumn(
        "expected_close_date",
        shifted(F.col("opened_at"), F.col("close_days"), day(as_of + timedelta(days=120))),
    ).withColumn("is_forecast", F.col("status") == "Open")


def gen_opportunities(
    customers: DataFrame, products: DataFrame, as_of: date, seed: int = SEED
) -> DataFrame:
    """10 to 18 opportunities per customer, on any of the products."""
    h2, status = F.col("h2"), F.col("status")
    last_day = F.least(day(as_of), F.col("expected_close_date"))
    opps = _opportunities(customers, as_of, seed)
    return _with_product(opps, products, seed, "opp product", "opp_no").select(
        _label("O", 5000, F.col("opp_no")).alias("opp_id"),
        "customer_id",
        "product_id",
        "type",
        "status",
        "stage",
        "opened_at",
        "expected_close_date",
        F.when(
            ~F.col("is_forecast"), shifted(F.col("opened_at"), uniform_int(h2, 0, 14, 150), last_day)
        ).alias("closed_at"),
        "is_forecast",
        F.when(F.col("is_forecast"), pick(h2, 1, CATEGORIES)).alias("forecast_category"),
        shifted(F.col("opened_at"), F.col("stage_days"), day(as_of)).alias("stage_last_changed_at"),
        pick(h2, 2, AMOUNTS).alias("amount"),
        F.lit("EUR").alias("currency"),
        F.when(status == "Won", 100)
        .when(status == "Lost", 0)
        .otherwise(pick(h2, 3, OPEN_PROBABILITIES))
        .alias("probability"),
        F.when(F.col("type") == "Renewal", 12).alias("renewal_term_months"),
    )


def gen_sales_activities(customers: DataFrame, as_of: date, seed: int = SEED) -> DataFrame:
    """Up to five activities per opportunity; half of the deals closing this month went stale."""
    h = F.col("h")
    month_start, month_end = as_of.replace(day=1), as_of.replace(day=28)
    closing = F.col("is_forecast") & F.col("expected_close_date").between(
        day(month_start), day(month_end)
    )
    rows = (
        _opportunities(customers, as_of, seed)
        .select("opp_no", "opened_at", "expected_close_date", "is_forecast")
        .withColumn("h", entropy(seed, "sales count", F.col("opp_no")))
        .withColumn("stale", closing & chance(h, 0, 50))
        .withColumn(
            "count",
            F.when(F.col("stale"), pick(h, 1, (0, 0, 1))).otherwise(
                uniform_int(h, 2, 0, MAX_CHILDREN)
            ),
        )
    )
    rows = _numbered(rows, F.col("count"), "n")
    rows = rows.withColumn("activity_no", F.col("opp_no") * MAX_CHILDREN + F.col("n") - 1)
    rows = rows.withColumn("h", entropy(seed, "sales", F.col("activity_no")))
    stale = F.col("stale")
    return rows.select(
        _label("A", 60000, F.col("activity_no")).alias("activity_id"),
        _label("O", 5000, F.col("opp_no")).alias("opp_id"),
        F.when(stale, F.date_sub(day(as_of), pick(h, 0, STALE_AGES)))
        .otherwise(shifted(F.col("opened_at"), uniform_int(h, 1, 1, 90), day(as_of)))
        .alias("activity_at"),
        F.when(stale, pick(h, 2, STALE_STEPS)).otherwise(pick(h, 3, SALES_STEPS)).alias(
            "description"
        ),
        F.when(stale, pick(h, 4, STALE_TYPES)).otherwise(pick(h, 5, SALES_TYPES)).alias("type"),
        pick(h, 6, CONTACTS).alias("contact_name"),
    )


def gen_notes(customers: DataFrame, as_of: date, seed: int = SEED) -> DataFrame:
    """One risk note on a quarter of the open opportunities."""
    h = F.col("h")
    return (
        _opportunities(customers, as_of, seed)
        .where("is_forecast")
        .select("opp_no", "opened_at")
        .withColumn("h", entropy(seed, "note", F.col("opp_no")))
        .where(chance(h, 0, 25))
        .select(
            _label("N", 70000, F.col("opp_no")).alias("note_id"),
            _label("O", 5000, F.col("opp_no")).alias("opp_id"),
            shifted(F.col("opened_at"), uniform_int(h, 1, 10, 90), day(as_of)).alias("note_at"),
            F.lit("risk").alias("note_type"),
            F.lit(RISK_TEXT).alias("note_text"),
            F.lit(RISK_TAGS).alias("tags"),
        )
    )


def generate(
    customer_ids: DataFrame, product_ids: DataFrame, as_of: date, seed: int = SEED
) -> Tables:
    """All eight tables, for as many customers as `customer_ids` has rows."""
    customers, products = gen_customers(customer_ids), gen_products(product_ids)
    return Tables(
        customer_ids.sparkSession,
        {
            "customers": customers.drop("customer_no"),
            "products": products,
            "csat_by_month": gen_csat(customers, as_of, seed),
            "support_tickets": gen_tickets(customers, products, as_of, seed),
            "support_activities": gen_support_activities(customers, as_of, seed),
            "sales_opportunities": gen_opportunities(customers, products, as_of, seed),
            "sales_activities": gen_sales_activities(customers, as_of, seed),
            "opportunity_notes": gen_notes(customers, as_of, seed),
        },
    )
