"""Streams give what a batch gives, also when they are stopped midway."""

import duckdb
from pyspark.sql import functions as F

from treesift.operators.rules import Rule, scan
from treesift.streaming import drop_folder, observations

SCHEMA = "at timestamp, repo_id string, ecosystem string, name string, version string"


def of_events(spark, sf_dir):
    """Observations made of events: users are repositories, types are packages."""
    event = spark.read.parquet(f"{sf_dir}/events.parquet")
    return event.select(
        F.col("ts").alias("at"), F.concat(F.lit("r"), (F.col("user_id") % 5).cast("string")).alias("repo_id"), F.lit("npm").alias("ecosystem"), F.col("event_type").alias("name"),
        F.concat((F.col("event_id") % 7).cast("string"), F.lit(".0.0")).alias("version"),
    )


def test_a_stream_over_events_equals_sql_and_restarts(spark, sf_dir, tmp_path):
    """Events in order of time arrive in parts; the query ends after each and goes on, and some parts come twice."""
    rows = of_events(spark, sf_dir).orderBy("at").collect()
    parts = [rows[i : i + 100] for i in range(0, min(len(rows), 500), 100)]
    types = sorted({r.name for r in rows})
    table = spark.createDataFrame([("npm", types[0], "ADV-1", ["= 1.0.0", "= 2.0.0"]), ("NPM", types[1].upper(), "ADV-2", ["= 3.0.0"])], "ecosystem string, name string, advisory_id string, affected array<string>")
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        if i % 2:
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}-again")
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        observations.start(stream, table, f"{tmp_path}/out", f"{tmp_path}/state", "1000 days").awaitTermination()
    told = spark.read.parquet(f"{tmp_path}/out")
    sent = spark.createDataFrame([r for p in parts for r in p], SCHEMA)
    batch = observations.exposed(observations.told_once(sent), table)
    key = lambda df: sorted(tuple(r) for r in df.select(*observations.KEY, "advisory_id").collect())
    assert key(told) == key(batch)
    con = duckdb.connect()
    con.register("sent", sent.toPandas())
    plain = con.execute(f"""SELECT DISTINCT repo_id, ecosystem, name, version, CASE name WHEN '{types[0]}' THEN 'ADV-1' ELSE 'ADV-2' END FROM sent
        WHERE name = '{types[0]}' AND version IN ('1.0.0', '2.0.0') OR name = '{types[1]}' AND version = '3.0.0'""").fetchall()
    assert key(told) == sorted(plain) and plain
    assert observations.hourly(told).agg(F.sum("observations")).first()[0] == len(plain)


def test_state_ends_at_the_watermark(spark, tmp_path):
    row = lambda at: (at, "r", "npm", "b" if at.endswith("05:00") else "a", "1.0.0")
    table = spark.createDataFrame([("npm", "a", "ADV-1", ["= 1.0.0"])], "ecosystem string, name string, advisory_id string, affected array<string>")
    times = ["2024-01-01 00:00:00", "2024-01-01 00:30:00", "2024-01-02 00:05:00", "2024-01-02 00:10:00"]
    for i, at in enumerate(times):
        spark.createDataFrame([row(at)], "at string, repo_id string, ecosystem string, name string, version string").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        observations.start(stream, table, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    told = [str(r["at"]) for r in spark.read.parquet(f"{tmp_path}/out").orderBy("at").collect()]
    assert told == [times[0], times[3]]  # again once another observation has moved the watermark past it


def test_dropped_files_are_scanned_as_in_a_batch(spark, tmp_path):
    rules = [Rule("TXT-1", "c", "low", "low", "m", r"alpha beta"), Rule("TXT-2", "c", "low", "low", "m", r"(?s)begin.{0,20}end")]
    for name, body in {"r/a.txt": b"x\nalpha beta\n", "r/b.txt": b"begin\nmid\nend\n", "s/c.bin": b"alpha beta\0"}.items():
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body)
    query = drop_folder.start_scan(drop_folder.arriving_files(spark, f"{tmp_path}/in"), rules, f"{tmp_path}/out", f"{tmp_path}/state")
    query.processAllAvailable()
    query.stop()
    files = spark.createDataFrame([("r", "a.txt", "x\nalpha beta\n"), ("r", "b.txt", "begin\nmid\nend\n")], "repo_id string, path string, text string")
    columns = ("repo_id", "path", "rule_id", "start_line", "end_line")
    key = lambda df: sorted(map(repr, df.select(*columns).collect()))
    found = key(spark.read.parquet(f"{tmp_path}/out"))
    assert found == key(scan(files, rules)) and len(found) == 2
