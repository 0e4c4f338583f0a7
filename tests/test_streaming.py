from kindred.operators.normalize import normalize_records
from kindred.streaming import arrivals

HEAD = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"


def test_arrivals(spark, tmp_path):
    raw = spark.createDataFrame([("S1-1", "Acme Inc", "1 Main St, Austin", "US"), ("S1-2", "Zeta", "9 Oak Rd", "US")], "entity_id string, business_name string, business_address string, country string")
    entities = normalize_records(raw)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tsv").write_text(HEAD + "S2-1\tACME\t1 Main Street Austin\tUS\nS2-2\tOther\tx\tUS\n")
    run = lambda: arrivals.start(arrivals.read_arrivals(spark, str(tmp_path / "in")), entities, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    got = lambda: {(r.s1_id, r.candidate_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got() == {("S1-1", "S2-1")}
    (tmp_path / "in" / "b.tsv").write_text(HEAD + "S3-7\tZeta LLC\t9 Oak Road\tUS\n")
    run()
    assert got() == {("S1-1", "S2-1"), ("S1-2", "S3-7")}
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
