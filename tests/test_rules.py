"""Every rule on literal rows: what it finds, what it leaves alone, and what a comment suppresses."""

import pytest
from codequarry.operators import config_audit, confidence, dedupe, findings, imports, linerules, patches, pyflow, remediation, review, scripts
from codequarry.sources import files, manifests, sinks
from pyspark.sql import functions as F

FILES = "file_id int, repository_id string, relative_path string, content string, line string, copy_no string"


def table(spark, contents, repeats=1):
    rows = [(i, "r", name, text, "clash", "clash") for i, (name, text) in enumerate(contents.items())]
    return spark.createDataFrame(rows * repeats, FILES)


def lines(spark, contents, repeats=2):
    return files.delivered_lines(table(spark, contents, repeats))


SINKS = {
    "eval(x)": "JS001", "new Function(x)": "JS002", "<p dangerouslySetInnerHTML={x} />": "JS004", "a.innerHTML = x": "JS005", "a.outerHTML = x": "JS005",
    "a.insertAdjacentHTML('beforeend', x)": "JS005", "document.write(x)": "JS006", "child_process.exec(x)": "JS003", "childProcess.execSync(x)": "JS003",
}


def test_each_sink(spark):
    rows = scripts.sinks(lines(spark, {f"s{i}.ts": text for i, text in enumerate(SINKS)})).collect()
    assert {(r.file_id, r.rule_id) for r in rows} == set(enumerate(SINKS.values())) and len(rows) == len(SINKS)
    clean = ["evaluate(x)", "newFunction(x)", "a.innerHTMLx", "document.writeln(x)", "exec(x)", "// nothing"]
    assert scripts.sinks(lines(spark, {f"c{i}.js": t for i, t in enumerate(clean)} | {"a.py": "eval(x)"})).count() == 0


def test_a_suppressed_rule_gives_way_to_the_next_of_its_line(spark):
    text = "a.innerHTML = eval(x) // pragma: ignore JS001 reason: checked\na.innerHTML = eval(x)\neval(x) /* pragma: ignore js001 */\ndocument.write(x) // pragma: ignore JS001"
    got = {(r.line_no, r.rule_id) for r in scripts.sinks(lines(spark, {"a.js": text})).collect()}
    assert got == {(1, "JS005"), (2, "JS001"), (4, "JS006")}
    said = {(r.line_no, r.rule_id, r.reason) for r in linerules.suppressions(lines(spark, {"a.js": text})).collect()}
    assert said == {(1, "JS001", "checked"), (3, "JS001", None), (4, "JS001", None)}


def test_suppression_in_the_other_analyzers(spark):
    js = "console.log(1) // pragma: ignore QA003\nconsole.log(token) // pragma: ignore QA003\nconst API_KEY = 'abcd' // pragma: ignore SEC001\nconst PASSWORD = 'abcd'"
    assert {(r.line_no, r.rule_id) for r in scripts.quality(lines(spark, {"a.js": js})).collect()} == {(2, "SEC002")}
    assert [r.line_no for r in scripts.literal_secrets(lines(spark, {"a.js": js})).collect()] == [4]
    py = "eval(x)  # pragma: ignore PY001\neval(x)\nhashlib.md5(x)  # pragma: ignore CRY001\nhashlib.sha1(x)\n"
    assert [(r.line_no, r.rule_id) for r in pyflow.flows(table(spark, {"a.py": py}, 2)).collect()] == [(2, "PY001")]
    assert [r.algorithm for r in linerules.weak_hashes(lines(spark, {"a.py": py})).collect()] == ["sha1"]


def test_generic_rules_are_never_suppressed(spark):
    assert linerules.generic_hits(lines(spark, {"a.go": "fmt.Println(1) // pragma: ignore GO001"})).count() == 1


def test_weak_hashes_only_where_the_file_parses(spark):
    text = {"a.py": "hashlib.md5(x)\n", "b.py": "hashlib.md5(x\n", "c.js": "hashlib.md5(x)"}
    parsing = pyflow.parsing(table(spark, text))
    assert [r.path for r in linerules.weak_hashes(lines(spark, text), parsing).collect()] == ["a.py"]


PYTHON = {
    "eval(x)": "PY001", "compile(x)": "PY001", "exec(x)": "PY002", "subprocess.run(x)": "PY003", "subprocess.call(x)": "PY003", "subprocess.Popen(x)": "PY003",
    "subprocess.check_output(x)": "PY003", "os.system(x)": "PY004", "os.popen(x)": "PY004", "c.execute(f'select {x}')": "PY005", "p = request.args\nopen(p)": "PY006", "pickle.loads(x)": "PY007",
    "pickle.load(x)": "PY007", "yaml.load(x)": "PY008", "db_password = 'abcd1234'": "SEC001",
}


def test_each_python_rule(spark):
    got = {(r.file_id, r.rule_id) for r in pyflow.flows(table(spark, {f"a{i}.py": t for i, t in enumerate(PYTHON)})).collect()}
    assert got == set(enumerate(PYTHON.values()))
    clean = ["eval('1')", "exec('x = 1')", "subprocess.run(['ls'])", "os.system('ls')", "c.execute('select 1')", "open(p)", "db_password = 'changeme'", "db_password = x"]
    assert pyflow.flows(table(spark, {f"a{i}.py": t for i, t in enumerate(clean)})).count() == 0


K8S = "apiVersion: v1\nkind: {}\nspec:\n"
CONFIGURATION = {
    "a/Dockerfile": ("FROM x\nRUN y\n", "IAC001"), "b/Dockerfile": ("FROM x\nENV API_KEY=abcdefgh12\nUSER app\n", "IAC003"), "c/docker-compose.yml": ("  - PASSWORD=hunter22\n", "IAC004"),
    "d/compose.yaml": ("  - '0.0.0.0:6379:6379'\n", "IAC005"), ".github/workflows/e.yml": ("on:\n  pull_request_target:\n    branches: [a]\n", "IAC006"),
    ".github/workflows/f.yml": ("on: push\npermissions: write-all\n", "IAC007"), "g.yaml": (K8S.format("Pod") + "  containers:\n    - securityContext:\n        runAsUser: 0\n", "IAC009"),
    "h.yaml": (K8S.format("Deployment") + "  template:\n    spec:\n      containers:\n        - securityContext:\n            privileged: true\n", "IAC010"), "i.yml": (K8S.format("Job") + "  hostNetwork: true\n", "IAC011"),
    "j.tf": ('cidr_blocks = ["0.0.0.0/0"]\n', "IAC012"), "k.tf": ('password = "hunter2222"\n', "IAC013"), ".github/workflows/l.yml": ("on: push\n    uses: a/b@v1\n", "IAC014"),
    ".github/workflows/m.yml": ("on: push\n# ${{ github.event.pull_request.title }}\n", "IAC015"),
}


def test_each_configuration_rule(spark):
    rows = config_audit.audit(table(spark, {k: t for k, (t, _) in CONFIGURATION.items()}, 2)).collect()
    assert {(r.path, r.rule_id) for r in rows} == {(k, rule) for k, (_, rule) in CONFIGURATION.items()} and len(rows) == len(CONFIGURATION)
    assert {rule for _, rule in CONFIGURATION.values()} == set(config_audit.RULES)
    assert all((r.severity, r.confidence) == config_audit.RULES[r.rule_id] for r in rows)


def test_configuration_left_alone(spark):
    clean = {
        "Dockerfile": "FROM x\nUSER app\nENV API_KEY=${X}\n", "docker-compose.yml": "  - SECRET=$X\n  - '127.0.0.1:6379:6379'\n  - '8080:8080'\n", "a.tf": '# cidr_blocks = ["0.0.0.0/0"]\ntoken = "var.abcdefgh"\n',
        ".github/workflows/a.yml": "on: push\npermissions: read-all\n    uses: ./local@v1\n    uses: a/b@" + "a" * 40 + "\n", "k.yaml": K8S.format("Service") + "  hostNetwork: true\n", "broken.yaml": "kind: [\n",
        "node_modules/a/b.tf": 'cidr_blocks = ["0.0.0.0/0"]\n', "build/c.tf": 'cidr_blocks = ["0.0.0.0/0"]\n', "big.tf": 'cidr_blocks = ["0.0.0.0/0"]\n' + "#" * config_audit.MOST_BYTES, "none.tf": None,
    }
    assert config_audit.audit(table(spark, clean)).count() == 0


def test_manifests_are_looked_for_three_folders_deep(spark):
    paths = ["go.sum", "a/b/c/go.sum", "a/b/c/d/go.sum", "a/dist/go.sum", "node_modules/x/go.sum", "a\\b\\go.sum"]
    got = manifests.dependencies(table(spark, {p: f"m{i} v1.0.0 h1:x" for i, p in enumerate(paths)})).collect()
    assert {r.name for r in got} == {"m0", "m1", "m5"}


def test_imports_of_several_modules_in_a_line(spark):
    text = {"a.py": "import b as x, c.d, os\n", "b.py": "import c\n", "c/__init__.py": "", "c/d.py": "import a , b\n"}
    got = {(r.src, r.dst) for r in imports.import_edges(table(spark, text, 2)).collect()}
    assert got == {("a", "b"), ("a", "c.d"), ("b", "c"), ("c.d", "a"), ("c.d", "b")}
    parts = {(r.module, r.component, r.n_modules) for r in imports.import_components(imports.import_edges(table(spark, text))).collect()}
    assert parts == {("a", "a", 2), ("c.d", "a", 2)}


def test_unused_internal_imports(spark):
    text = {
        "app/__init__.py": "", "app/a.py": "from .b import used, unused, _private\nfrom .b import *\nimport app.c\nimport os\nfrom app.c import listed\n__all__ = ['listed']\nused()\n", "app/b.py": "from . import a\nimport app.c as c\nc.run()\n",
        "app/c.py": "def broken(:\n", "app/sub/d.py": "from ..b import x as y\n", "e.py": None,
    }
    got = {(r.path, r.name, r.module, r.line_no) for r in imports.unused_imports(table(spark, text, 2)).collect()}
    assert got == {("app/a.py", "unused", "app.b", 1), ("app/a.py", "app", "app.c", 3), ("app/b.py", "a", "app", 1), ("app/sub/d.py", "y", "app.b", 1)}


def test_remediation_fills_what_is_empty(spark):
    cols = "id string, rule_id string, why_risky string, impact string, remediation string, fix_example string, cwe string, patch_available boolean, line_number int, code_snippet string"
    rows = [
        ("1", "PY008", "w", "", None, None, "", None, 3, "  d = yaml.load(f)"), ("2", "PY008", None, "i", "m", "x", "CWE-1", True, 3, "yaml.load(f)"), ("3", "PY001", None, None, None, None, None, False, 3, "yaml.load(f)"),
        ("4", None, None, None, None, None, None, None, None, None), ("5", "PY008", "own", None, None, None, None, False, 0, "yaml.load(f)"),
    ]
    df = spark.createDataFrame(rows, cols)
    got = {r.id: r for r in remediation.remediated(df, remediation.rule_texts(df)).collect()}
    assert (got["1"].why_risky, got["1"].impact, got["1"].cwe, got["1"].patch_available, got["1"].patch_replacement) == ("w", "i", "CWE-1", True, "  d = yaml.safe_load(f)")
    assert (got["2"].why_risky, got["2"].impact, got["2"].patch_available, got["2"].patch_replacement) == ("w", "i", True, None)
    assert (got["3"].why_risky, got["3"].patch_available) == (None, False) and got["4"].patch_available is False
    assert (got["5"].why_risky, got["5"].patch_available) == ("own", False)
    assert remediation.remediated(df.limit(0), remediation.rule_texts(df.limit(0))).count() == 0


def test_patches_are_checked_by_the_line_rules(spark):
    rows = [("print(a)\nassert b", "print(a)", "log(a)", "py"), ("print(a)", "print(a)", "log(a)", "py"), ("print(a)", "print(a)", "log(a)", "go"), (None, "a", "b", "py")]
    df = spark.createDataFrame(rows, "content string, original string, replacement string, ext string")
    got = [r.status for r in patches.verified(df, lambda c: linerules.count_hits(c, F.col("ext"))).collect()]
    assert got == ["partially_verified", "verified", "failed", "failed"]


def test_merge_unites_transforms_and_levels(spark):
    texts = ", ".join(f"{c} string" for c in ("sink_label", "cwe", "language", "dependency_name", "advisory_id", "patch_text", *(c for c in dedupe.FIRST_TRUTHY if c != "sink_label")))
    cols = f"id string, scan_id string, rule_id string, category string, title string, description string, severity string, confidence int, file_path string, line_number int, analyzer string, patch_available boolean, transforms array<string>, {texts}"
    row = lambda i, path, conf, steps: (i, "s", "JS001", "xss", "t", "d", "low", conf, path, 3, "ast", None, steps, *[None] * texts.count("string"))
    df = spark.createDataFrame([row("1", "b.js", 85, ["trim", "lower"]), row("2", "b.js", 40, ["lower", "escape"]), row("3", "a.js", None, None)], cols)
    got = dedupe.in_order(dedupe.merge_duplicates(df)).collect()
    assert [(r.file_path, r.merged, r.confidence_level, r.transforms) for r in got] == [("a.js", 1, "low", []), ("b.js", 2, "high", ["escape", "lower", "trim"])]


def test_views_show_one_analyzer(spark):
    cols = ", ".join(f"{c} string" for c in findings.RESPONSE if c not in ("line_number", "confidence", "patch_available"))
    df = spark.createDataFrame([], f"{cols}, line_number int, confidence int, patch_available boolean, patch_text string")
    bad, good = '{"file_path": "a", "or', '{"file_path": "a", "original": "x", "replacement": "y"}'
    rows = spark.createDataFrame([("1", "secret_scanner", bad), ("2", "iac", good), ("2", "iac", good), (None, "iac", good)], "id string, analyzer string, patch_text string")
    df = df.unionByName(rows, allowMissingColumns=True)
    assert [r.id for r in findings.view(df, "secret").collect()] == ["1"] and [r.id for r in findings.view(df, "iac").collect()] == ["2"]
    got = {r.finding_id: r.patch and r.patch.replacement for r in findings.remediation_view(df).collect()}
    assert got == {"1": None, "2": "y"}
    steps = spark.range(1).select(findings.rendered_flow(F.array(*[F.struct(F.lit(n).alias("label"), F.lit(i).alias("line")) for i, n in enumerate("ab")])).alias("t"))
    assert steps.first().t == "a (line 0) → b (line 1)"


def test_written_reviews_and_rows_come_back(spark, tmp_path):
    rows = spark.createDataFrame([("1", "f", "h", "1", "real"), ("2", "f", "h", "1", "false")], "id string, finding_id string, request_hash string, analysis_version string, verdict string")
    review.write_reviews(rows.withColumn("created_at", F.col("id").cast("int").cast("timestamp")), str(tmp_path / "r"))
    review.write_reviews(rows.limit(1), str(tmp_path / "r"))
    assert [r.verdict for r in review.latest_reviews(spark.read.parquet(str(tmp_path / "r"))).collect()] == ["false"]
    sinks.append_rows(rows, str(tmp_path / "p"))
    sinks.append_rows(rows, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 4
    sinks.append_state(spark, str(tmp_path / "s"), "x", "running")
    assert [r.status for r in sinks.current_states(spark.read.parquet(str(tmp_path / "s"))).collect()] == ["running"]


def test_no_table_is_broadcast_by_force(spark):
    rules = spark.createDataFrame([(1, "A", 70, "CWE-1", "python")], "rule_no int, rule_id string, base_confidence int, cwe string, language string")
    rows = spark.createDataFrame([("1", "A", None, None, 50), ("2", "B", "c", None, None)], "id string, rule_id string, cwe string, language string, confidence int")
    got = {r.id: (r.cwe, r.base_confidence) for r in confidence.enrich(rows, rules).collect()}
    assert got == {"1": ("CWE-1", 70), "2": ("c", 50)} and "ResolvedHint" not in confidence.enrich(rows, rules)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("text, n", [("a [REDACTED_CREDENTIAL] [REDACTED_KEY]", 2), ("[REDACTED_DB_URL][REDACTED_TOKEN][REDACTED_PASSWORD][REDACTED_SECRET]", 4), ("[REDACTED_OTHER]", 0), ("", 0)])
def test_redactions_are_counted(spark, text, n):
    from codequarry.functions.redaction import redaction_count

    assert spark.range(1).select(redaction_count(F.lit(text)).alias("n")).first().n == n


def test_join_of_a_hot_key(spark):
    from codequarry.operators.skew import join_hot

    large = spark.range(1000).select(F.col("id").alias("item"), F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") % 2 == 0, F.col("id").cast("string")).alias("k"))
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("6", 3), (None, 4)], "k string, v int")
    for how in ("inner", "left"):
        want = sorted(map(str, large.join(small, "k", how).select("item", "k", "v").collect()))
        assert sorted(map(str, join_hot(large, small, "k", "item", how).select("item", "k", "v").collect())) == want


def test_heads_of_lines_are_shown(spark):
    text = {"a.tf": '   password = "hunter2222" # ' + "x" * 200, "b.js": "  eval(x) // " + "y" * 200}
    shown = config_audit.audit(table(spark, text)).first()
    assert shown.evidence.startswith('password = "***" #') and len(shown.evidence) <= 120
    assert len(scripts.sinks(lines(spark, text)).first().sink_label) == 80


def test_lists_are_sorted_and_show_an_id_once(spark):
    rows = spark.createDataFrame([("a", 1), ("c", 2), ("b", 3), ("c", 2), (None, 4)], "id string, n int")
    assert [r.id for r in findings.newest_first(rows).collect()] == ["c", "b", "a"]
