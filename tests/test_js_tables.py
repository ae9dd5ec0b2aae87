"""Constant string tables: what is looked up, and what takes a table's values away."""

import pytest

from treesift.operators import active
from treesift.operators.js_tables import ROTATED, TWICE, UNSUPPORTED, table_values

TABLE = "const pieces = ['.ssh/', 'id_rsa'];\n"
FILES = "repo_id string, path string, text string"


def values(text):
    return [v[4] for v in table_values(text)[0]]


def test_lookups_are_joined_and_placed():
    (found,), trouble = table_values(TABLE + "const path = pieces[0] + pieces[1];\n")
    assert found == (2, 2, "string-table lookup (items on lines 1, 1)", "pieces[0] + pieces[1]", ".ssh/id_rsa") and not trouble
    assert values("var t = ['a',\n \"b\\x63\",];\nf(t[0x1], t[0]+t[1]+t[0]);") == ["bc", "abca"]
    assert values("let t = ['a', 'b'];\nlog(t.length, t.join(''), t[9], x.t[0]);") == []


@pytest.mark.parametrize(
    ("change", "reason"),
    [
        ("pieces.push('extra');", UNSUPPORTED), ("pieces['reverse']();", UNSUPPORTED), ("pieces[0] = 'x';", UNSUPPORTED), ("pieces[i]++;", UNSUPPORTED), ("pieces = other;", UNSUPPORTED),
        ("const alias = pieces; alias[0] = 'public/';", UNSUPPORTED), ("pieces['push'](pieces['shift']());", ROTATED), ("const pieces = ['x'];", TWICE),
    ],
)
def test_changes_take_the_values_away(change, reason):
    found, trouble = table_values(TABLE + change + " const path = pieces[0] + pieces[1];\n")
    assert found == [] and trouble == reason
    found, trouble = table_values(TABLE + "const path = pieces[0] + pieces[1];\n" + change)
    assert found == [] and trouble == reason


@pytest.mark.parametrize("text", ["if (pieces[0] == 'x') y();", "z = pieces[0] === a;", "// pieces.push('x')\n", "'pieces.push(1)';", "f(pieces);", "other.pieces.push(1);"])
def test_what_only_reads_leaves_them(text):
    assert ".ssh/id_rsa" in values(TABLE + text + "\npath = pieces[0] + pieces[1];\n")


def test_values_end_at_braces_and_at_a_distance():
    assert values(TABLE + "function f() { return pieces[0]; }") == []
    assert values(TABLE + " " * 1100 + "pieces[0]") == []
    assert values("// const t = ['a'];\nt[0]; `const u = ['a'];` u[0]; const v = ['a', f()]; v[0]; const w = ['a'].concat(x); w[0]") == []


def test_looked_up_text_meets_the_rules(spark):
    texts = {"a.js": TABLE + "const path = pieces[0] + pieces[1];\n", "b.js": TABLE + "pieces.push('x'); const path = pieces[0] + pieces[1];\n", "c.js": "const t = ['a', 'b']; t['push'](t['shift']());\n"}
    files = spark.createDataFrame([("r", p, t) for p, t in texts.items()], FILES)
    met = active.js_decoded_findings(files).select("path", "start_line", "contributing", "reason").collect()
    assert {(r.path, r.start_line) for r in met} == {("a.js", 2)} and any(r.contributing and r.contributing.startswith("CRED-") for r in met)
    assert all("items on lines 1, 1" in r.reason for r in met)
    assert sorted((r.path, r.reason) for r in active.skipped_files(files).collect()) == [("b.js", UNSUPPORTED), ("c.js", ROTATED)]


def test_many_tables_take_time_in_proportion():
    text = "\n".join(f"const t{i} = ['a{i}', 'b']; x(t{i}[0] + t{i}[1]);" for i in range(20_000))
    assert len(values(text)) == 20_000
