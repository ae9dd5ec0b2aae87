import itertools
import random
import tracemalloc
import types

import pytest

from treesift.llm import common, url_filter

RULES = (*url_filter.RULES, ("a.b/x", "block"), ("b/x/y", "allow"), ("A.B/x/", "allow"))
LISTED = ("bad.com/", "c/xy", "b/")


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]

    def fits(entry):
        h, slash, p = entry.partition("/")
        return (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(slash + p)

    low = lambda e: e.partition("/")[0].lower() + "/" + e.partition("/")[2]
    rules = sorted((-len(e), low(e), v) for e, v in RULES if fits(e))
    listed = max((low(e) for e in LISTED if fits(e)), key=lambda e: (len(e), e), default=None)
    verdict = rules[0][2] if rules else "block" if listed else "allow"
    return host, path, rules[0][1] if rules else None, verdict, listed


def urls():
    hosts = ["net", "x.net", "example.net", "A.Example.NET", "example.com", "org", "fr.org", "a.b", "q.a.b", "b", "bad.com", "notbad.com", "c", "", "u@b:80", "é.b"]
    paths = ["", "/", "/en/", "/en/x", "/de/1?q=/fr/", "/fr/#a", "/x", "/x/y", "/xy", "?x", "#x", "/X"]
    out = [f"http://{h}{p}" for h, p in itertools.product(hosts, paths)]
    return out + [None, "", "no scheme", "mailto:x@b", "://", "a://b/x://c/y"]


def test_against_brute_force_with_collisions(spark):
    cases = urls()
    random.Random(1).shuffle(cases)
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(cases)] + [(0, cases[0], "h")], "page_id long, url string, html string")
    table = url_filter.entries(spark, RULES, LISTED)
    for bits in (64, 3):  # with 3 bits nearly all keys collide
        got = url_filter.url_report(pages, url_filter.publish(table, bits)).collect()
        assert len(got) == len(cases) + 1
        for r in got:
            assert (r["host"], r["path"], r["rule"], r["verdict"], r["listed"]) == brute(cases[r["page_id"]]), cases[r["page_id"]]


def test_empty_tables(spark):
    pages = spark.createDataFrame([(None, "http://net/", "h")], "page_id long, url string, html string")
    files = url_filter.publish(url_filter.entries(spark, RULES, LISTED).limit(0))
    (row,) = url_filter.url_report(pages, files).collect()
    assert (row["page_id"], row["rule"], row["verdict"]) == (None, None, "allow")
    assert url_filter.url_report(pages.limit(0), files).count() == 0


def test_very_long_urls(spark):
    long = ["http://" + "a." * 500_000 + "net/", "http://b/" + "x/" * 500_000, "http://" + "a" * 1_000_000, "x" * 1_000_000, "http://" + "b." * 500_000 + "bad.com/?" + "y" * 1000]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(long)], "page_id long, url string")
    files = url_filter.publish(url_filter.entries(spark, RULES, LISTED))
    tracemalloc.start()
    array = url_filter.DigestArray(files)
    for u in long:
        assert sum(map(len, array.candidates(*url_filter.host_and_path(u)))) < 1000
    assert tracemalloc.get_traced_memory()[1] < 20_000_000
    tracemalloc.stop()
    for r in url_filter.url_report(pages, files).collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"], r["listed"]) == brute(long[r["page_id"]])


def test_many_parts(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "ENTRIES_IN_PART", 40)
    listed = [f"h{i}.com/" for i in range(500)] + [f"h{i}.com/a" for i in range(0, 500, 7)]
    for bits in (64, 4):
        files = url_filter.publish(url_filter.entries(spark, (), listed), bits)
        assert len(files.names) > 5
        pages = spark.createDataFrame([(i, f"http://www.h{i}.com/abc") for i in range(600)], "page_id long, url string")
        for r in url_filter.url_report(pages, files).collect():
            i = r["page_id"]
            assert r["listed"] == (None if i >= 500 else f"h{i}.com/a" if i % 7 == 0 else f"h{i}.com/"), i


def test_no_folder_of_our_own_on_a_cluster():
    conf = types.SimpleNamespace(get=lambda key, default=None: default)
    context = types.SimpleNamespace(master="spark://somewhere:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(types.SimpleNamespace(conf=conf, sparkContext=context))
