import tempfile

from pyspark.sql import functions as F

from courtstats.sources.tables import TABLE_SCHEMAS, table
from courtstats.streaming import ingest_new_files

SF = "/root/testdata/sf0.001"


def test_incremental_ingest_is_exactly_once(spark):
    out = tempfile.mkdtemp(prefix="cs-stream-out-")
    ck = tempfile.mkdtemp(prefix="cs-stream-ck-")
    kw = dict(schema=TABLE_SCHEMAS["events"], out_path=out, name="events_ingest", checkpoint=ck,
              derive={"day": F.to_date("ts")}, partition_by=["day"])
    q = ingest_new_files(spark, f"{SF}/events*.parquet", **kw)
    q.awaitTermination(300)
    expected = table(spark, SF, "events").count()
    landed = spark.read.parquet(out)
    assert landed.count() == expected
    assert landed.select("source_file").distinct().count() == 1
    # a second run finds no new files and appends nothing
    q2 = ingest_new_files(spark, f"{SF}/events*.parquet", **kw)
    q2.awaitTermination(300)
    assert spark.read.parquet(out).count() == expected


def test_new_session_resumes_from_the_same_checkpoint(spark, tmp_path):
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    for session in (spark, spark.newSession()):
        ingest_new_files(session, f"{SF}/events*.parquet", TABLE_SCHEMAS["events"], out, "resume", ck).awaitTermination(300)
    assert spark.read.parquet(out).count() == table(spark, SF, "events").count()
