"""What several queries share within one session: the flat table and its knowledge.

The engine works on flat stored datasets, so the joined ``sales`` table is written once
and scanned by the queries, as an uploaded file would be.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom import Snapshot, Workspace
from factloom.operators import catalog
from factloom.operators.derived import derived_columns
from factloom.plans.workspace import ROW_GROUP_BYTES
from factloom.sources.tables import scratch_dir
from workloads import views

SALES_ID = "sales"


class Prepared:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def sales_path(self) -> str:
        path = scratch_dir(self.spark, "sales")
        views.sales(self.spark, self.sf_dir).write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
        return path

    @property
    def sales(self) -> DataFrame:
        return self.spark.read.parquet(self.sales_path)

    @cached_property
    def derived(self) -> list[str]:
        return derived_columns(self.sales, views.SALES_ORDER)

    @cached_property
    def roles(self) -> list[catalog.ColumnRole]:
        described = catalog.semantic_roles(catalog.column_catalog(self.sales), self.derived)
        return catalog.collect_roles(described)

    @property
    def dimensions(self) -> list[str]:
        return catalog.dimension_names(self.roles)

    @property
    def measures(self) -> list[str]:
        return catalog.measure_names(self.roles)

    @property
    def measures_and_rates(self) -> list[str]:
        return catalog.measure_names(self.roles, with_rates=True)

    @cached_property
    def workspace(self) -> Workspace:
        """A workspace in which the sales dataset has been processed."""
        workspace = Workspace(self.spark, scratch_dir(self.spark, "knowledge"))
        workspace.register(self.sales_path, "parquet", "sales", SALES_ID)
        workspace.process(SALES_ID, views.SALES_ORDER)
        return workspace

    @cached_property
    def grown(self) -> tuple[Workspace, Snapshot]:
        """A workspace to which the sales came in three parts, and its state before the second."""
        workspace = Workspace(self.spark, scratch_dir(self.spark, "grown"))
        part = F.col("order_id") % 3
        workspace.add(self.sales.where(part == 0), "sales", SALES_ID)
        workspace.process(SALES_ID, views.SALES_ORDER)
        pinned = workspace.snapshot(SALES_ID)
        for i in (1, 2):
            workspace.append(SALES_ID, self.sales.where(part == i))
        return workspace, pinned

    def stored(self, table: str) -> DataFrame:
        return self.workspace.store.read(table, SALES_ID).drop("dataset_id")


_prepared: dict[tuple[str, str], Prepared] = {}


def prepared(spark: SparkSession, sf_dir: str) -> Prepared:
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _prepared:
        _prepared[key] = Prepared(spark, key[1])
    return _prepared[key]
