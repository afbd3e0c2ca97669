import json
import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from veritrail.sources import event_log, extraction, tables
from veritrail.streaming import logs


def test_event_logs_skip_what_is_no_object(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"event":"a","n":1}\nbroken{\n5\n[1]\n"x"\n\n{"event":"b"}\n')
    events = event_log.read_events(spark, str(tmp_path))
    assert [r.e for r in events.select(F.variant_get("event", "$.event", "string").alias("e")).collect()] == ["a", "b"]
    assert event_log.skipped(spark.read.text(str(tmp_path))).first() == (6, 2, 4)


def test_the_envelope_wins_over_the_payload(spark, tmp_path):
    df = spark.createDataFrame([("fake", 7)], "event string, detail int")
    line = event_log.typed_event(df.columns, {"event": F.lit("real"), "campaign_id": F.lit("c")})
    event_log.append_events(df.select(line.alias("line")), str(tmp_path / "log"))
    event_log.append_events(df.select(line.alias("line")), str(tmp_path / "log"))
    rows = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "log")).collect()]
    assert rows == [{"detail": 7, "event": "real", "campaign_id": "c"}] * 2


def test_types_and_texts_of_artifacts(spark, tmp_path):
    raws = {
        "a": (b"%PDF-1.7 x", "application/pdf"), "b": (b"<html><body>a &amp; b<script>no</script></body></html>", "text/html"), "c": (b"<?xml version='1.0'?><article><p>hi</p></article>", "application/xml"),
        "d": ("Grüße".encode(), "text/plain"), "e": (b"PK\x03\x04zz", "application/zip"), "f": (b"\xff\xfe\x00", "application/octet-stream"),
    }
    for name, (raw, _) in raws.items():
        (tmp_path / name).write_bytes(raw)
    found = {r.path.rsplit("/", 1)[1]: r for r in extraction.extracted(tables.read_artifacts(spark, str(tmp_path))).collect()}
    assert {k: r.mime for k, r in found.items()} == {k: mime for k, (_, mime) in raws.items()}
    assert found["b"].text == "a & b" and found["c"].text == "hi" and found["d"].text == "Grüße" and found["a"].extractor == "pdf:unavailable" and found["a"].lossy and not found["d"].lossy
    marked = spark.createDataFrame([("<?xml?><!-- c --><article x='1'>",), ("<html><article>",), ("x",)], "t string")
    assert [r[0] for r in marked.select(extraction.xml_is_article(F.col("t"))).collect()] == [True, False, False]


def test_yaml_and_json_objects(spark, tmp_path):
    for name, body in {"a.yml": "x: 1\ny: [a]", "b.yml": "- 1", "c.yml": "{x: ["}.items():
        (tmp_path / name).write_text(body)
    schema = StructType([StructField("x", IntegerType()), StructField("y", ArrayType(StringType()))])
    rows = {r.path.rsplit("/", 1)[1]: (r.x, r.problem) for r in tables.read_yaml_objects(spark, str(tmp_path), schema).collect()}
    assert rows == {"a.yml": (1, None), "b.yml": (None, "not_a_mapping"), "c.yml": (None, "not_yaml")}
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text('{"x": 3,\n "y": ["b"]}')
    assert tables.read_json_objects(spark, str(tmp_path / "j"), schema).first().x == 3


def test_a_store_takes_each_address_once(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "sha string, n int")
    path = str(tmp_path / "store")
    assert tables.append_new(df, path, "sha") == 2 and tables.append_new(df, path, "sha") == 0
    assert tables.append_new(spark.createDataFrame([("c", 1)], "sha string, n int"), path, "sha") == 1 and spark.read.parquet(path).count() == 3


def test_streams_equal_their_batches(spark, tmp_path):
    rows = [(k % 3, k, float(k % 7), f"2024-01-0{1 + k % 4} 10:00:00", ("approved", "rejected", "pending")[k % 3]) for k in range(60)]
    df = spark.createDataFrame(rows, "run long, ord long, amt double, at string, status string").withColumn("at", F.to_timestamp("at"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: logs.table_stream(spark, str(tmp_path / "in"), df.schema)
    run = lambda s, mode="append": (logs.drained(s, str(tmp_path / (n := uuid.uuid4().hex)), str(tmp_path / f"{n}-state"), mode), spark.read.parquet(str(tmp_path / n)))[1]
    days = {(str(r.day), float(r.total), r.n) for r in run(logs.daily_totals(stream(), "at", "amt"), "complete").collect()}
    assert days == {(str(r[0]), float(r[1]), r[2]) for r in df.groupBy(F.to_date("at")).agg(F.sum("amt"), F.count("*")).collect()}
    latest = {(r.run, r.status) for r in run(logs.latest_decisions(stream(), "run", "ord", "status"), "complete").collect()}
    assert latest == {(0, "approved"), (1, "rejected")}
    used, n = {}, {}
    expected = set()
    for run_id, ord_, amt, *_ in rows:
        fits = n.get(run_id, 0) < 5 and used.get(run_id, 0) + amt <= 12
        if fits:
            n[run_id], used[run_id] = n.get(run_id, 0) + 1, used.get(run_id, 0) + amt
        expected.add((ord_, fits, used.get(run_id, 0.0)))
    assert {(r.ord, r.admitted, r.used) for r in run(logs.admissions(stream(), "run", "ord", "amt", 12.0, 5)).collect()} == expected


def test_text_of_markup(spark):
    cases = [
        ("<p title='a > b'>one &lt;two&gt;</p><!-- <p>no</p> -->three", "one <two>\nthree"), ("<STYLE>x{}</STYLE><b> a </b>\n<i>b&#233;</i>", "a\nb\u00e9"),
        ("a < b and c", "a < b and c"), ("<script>var x = '<p>no</p>'", ""), ("<styles>kept</styles>", "kept"), ("", ""), (None, None),
    ]
    df = spark.createDataFrame(cases, "html string, want string")
    assert [r[0] for r in df.select(extraction.html_text("html")).collect()] == [c[1] for c in cases]
