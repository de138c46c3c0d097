"""The eight sales and support tables as one value."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

NAMES = (
    "customers",
    "products",
    "csat_by_month",
    "support_tickets",
    "support_activities",
    "sales_opportunities",
    "sales_activities",
    "opportunity_notes",
)


class Tables:
    """Tables by name, as attributes. Each is given as a frame, or as a function that makes one when
    a job first asks for it, so a job only opens the tables it reads."""

    customers: DataFrame
    products: DataFrame
    csat_by_month: DataFrame
    support_tickets: DataFrame
    support_activities: DataFrame
    sales_opportunities: DataFrame
    sales_activities: DataFrame
    opportunity_notes: DataFrame

    def __init__(
        self, spark: SparkSession, sources: Mapping[str, DataFrame | Callable[[], DataFrame]]
    ):
        if set(sources) != set(NAMES):
            raise ValueError(f"tables needed: {', '.join(NAMES)}")
        self.spark = spark
        self._sources = dict(sources)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in NAMES:
            raise AttributeError(name)
        source = self._sources[name]
        df = source() if callable(source) else source
        setattr(self, name, df)
        return df

    @staticmethod
    def names() -> tuple[str, ...]:
        return NAMES

    @classmethod
    def from_catalog(cls, spark: SparkSession, schema: str = "dbo") -> Tables:
        return cls(spark, {n: lambda n=n: spark.table(f"{schema}.{n}") for n in NAMES})

    def replaced(self, **frames: DataFrame) -> Tables:
        """The same tables with some of them exchanged."""
        return Tables(self.spark, {**self._sources, **frames})

    def items(self) -> Iterator[tuple[str, DataFrame]]:
        for name in NAMES:
            yield name, getattr(self, name)

    def register(self) -> None:
        """Expose every table as a temporary view, for questions asked in SQL."""
        for name, df in self.items():
            df.createOrReplaceTempView(name)
