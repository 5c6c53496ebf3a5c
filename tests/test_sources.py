from pyspark.sql import functions as F

from kinforge.sources import entities as src


def test_quoted_and_short_rows(spark, tmp_path):
    path = tmp_path / "e.tsv"
    path.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\n S1-1 \t"A ""b"" c"\t"x\ty"\tIndia\nS1-2\tShort\n', encoding="utf-8")
    rows = sorted(src.read_entities(spark, str(path)).collect())
    assert [tuple(r) for r in rows] == [("S1-1", 'A "b" c', "x\ty", "India"), ("S1-2", "Short", "", "")]
    raw = sorted(src.read_entities(spark, str(path), quoted=False).collect())
    assert raw[0].business_name == '"A ""b"" c"' and raw[0].business_address == '"x'


def test_ground_truth_last_row_wins(spark, tmp_path):
    path = tmp_path / "g.tsv"
    path.write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1\nS1-2\t\nS1-1\tS2-2, S3-4 ,,\n", encoding="utf-8")
    truth = src.read_ground_truth(spark, str(path))
    assert {r.source1_entity_id: r.matched for r in truth.collect()} == {"S1-1": ["S2-2", "S3-4"], "S1-2": []}
    assert {tuple(r) for r in src.links(truth).collect()} == {("S1-1", "S2-2"), ("S1-1", "S3-4")}
    s2, s3 = src.by_source(F.col("matched"))
    assert truth.filter("source1_entity_id = 'S1-1'").select(s2.alias("a"), s3.alias("b")).first() == (["S2-2"], ["S3-4"])


def test_subset_keeps_late_required_rows(spark):
    entities = spark.createDataFrame([(f"S2-{i}", i) for i in range(10)], "entity_id string, ordinal long")
    got = {r.entity_id for r in src.target_subset(entities, spark.createDataFrame([("S2-8",), ("S2-9",)], "id string"), 4).collect()}
    assert got == {"S2-0", "S2-1", "S2-2", "S2-3", "S2-8", "S2-9"}


def test_ids_and_ordinals(spark, tmp_path):
    ids = spark.createDataFrame([("b",), ("a",), (" ",)], "id string")
    src.write_ids(ids, str(tmp_path / "ids"))
    assert {r.entity_id for r in src.read_ids(spark, str(tmp_path / "ids")).collect()} == {"a", "b"}
    placed = src.with_ordinal(spark.range(100).repartition(5))
    assert sorted(r.ordinal for r in placed.collect()) == list(range(100))
    assert src.table_path("d", "validation", "source2").endswith("test/test_source2.tsv")
    assert '"n": 1' in src.report_text(spark.createDataFrame([(1,)], "n int"))
    assert src.report_text(spark.range(1500)).count('"id"') == 1500
    src.write_report(ids, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 3
