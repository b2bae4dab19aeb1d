"""The shape of the physical plans that matter at scale."""


from factloom.operators import catalog, cube, impact, profile, relationships as rel, retrieval
from workloads import views

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cube_reads_the_data_once_and_only_what_it_needs(spark, tmp_path):
    views.sales(spark, SF).write.parquet(str(tmp_path / "flat"))
    flat = spark.read.parquet(str(tmp_path / "flat"))
    text = plan(cube.cube(flat, ["region", "segment"], ["quantity", "sales_amount"]))
    assert text.count("FileScan parquet") == 1
    schema = text.split("ReadSchema: ")[1]
    assert "quantity" in schema and "brand" not in schema
    assert "partial_sum" in text and "CartesianProduct" not in text
    text = plan(catalog.column_catalog(flat))
    assert text.count("FileScan parquet") == 1 and "NestedLoop" not in text
    text = plan(rel.correlations(flat, ["quantity", "sales_amount", "discount"]))
    # Pairs are summed inside batches: no row is multiplied by the pairs of measures.
    assert text.count("FileScan parquet") == 1 and "MapInArrow" in text and "Generate" not in text
    text = plan(profile.top_values(flat, ["region", "segment"]))
    assert text.count("WindowGroupLimit") == 2


def test_rankings_do_not_sort_everything(spark, tmp_path):
    facts = cube.with_fact_hash(cube.facts(views.sales(spark, SF), ["region"], ["quantity"]))
    facts.write.partitionBy("dimension").parquet(str(tmp_path / "facts"))
    stored = spark.read.parquet(str(tmp_path / "facts"))
    text = plan(impact.evidence_from_facts(stored, "quantity", "region"))
    assert "TakeOrderedAndProject" in text
    assert "PartitionFilters: [isnotnull(dimension" in text
    assert "PushedFilters: [IsNotNull(metric)" in text


def test_short_lists_are_cut_before_the_shuffle(spark):
    facts = spark.createDataFrame(
        [], "dimension string, metric string, fact_id string, dimension_value string, is_null boolean,"
        " sum double, mean double, count bigint"
    )
    evidence = spark.createDataFrame(
        [], "column_a string, column_b string, rel_type string, strength_score double, relationship_id bigint"
    )
    text = plan(retrieval.best_facts(facts, evidence))
    assert "NestedLoop" not in text and "Cartesian" not in text
