from codequarry.operators import advisories, config_audit, imports, linerules, patches, pyflow, pyquality, scripts
from codequarry.sources import files, manifests
from pyspark.sql import functions as F

FILES = "file_id int, repository_id string, relative_path string, content string, line string, extension string"


def table(spark, **contents):
    rows = [(i, "r", name, text, "clash", "clash") for i, (name, text) in enumerate(contents["files"].items())]
    return spark.createDataFrame(rows + rows[:1], FILES)


def test_read_tree(spark, tmp_path):
    for name, data in {"a.py": b"x = 1\n", "b.min.js": b"x", "node_modules/c.js": b"x", "d/e.png": b"\x89", "bad.go": b"package \xff\n", "f.bin2": b"\0" * 9, "big.js": b"y" * 600}.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(data)
    got = {r.relative_path: r for r in files.read_tree(spark, str(tmp_path), max_bytes=500).collect()}
    assert sorted(got) == ["a.py", "b.min.js", "bad.go", "big.js", "d/e.png", "f.bin2"]
    assert got["a.py"].content == "x = 1\n" and got["b.min.js"].is_generated and got["d/e.png"].is_binary and got["f.bin2"].is_binary
    assert got["big.js"].content is None and got["bad.go"].content == "package �\n"
    assert files.read_tree(spark, str(tmp_path), max_files=2).count() == 2


def test_lines_of_null_empty_and_repeated(spark):
    df = table(spark, files={"a.py": "x\n\ny", "b.py": None, "c.py": ""})
    assert [(r.file_id, r.line_no, r.line) for r in files.lines(df).orderBy("file_id", "line_no").collect()] == [(0, 1, "x"), (0, 2, ""), (0, 3, "y")]


def test_line_rules_positive_and_negative(spark):
    good = {
        "a.py": "# TODO\nexcept Exception:\n    except:\nprint(1)\nassert x\nlogger.info(password)\nhashlib.md5(x)", "b.js": "fetch('http://localhost:3000')\nconsole.log(1)\ndebugger",
        "C.java": 'catch (Exception e)\nx.printStackTrace()\n"SELECT a " + b\nSystem.out.println(1)', "d.go": 'v, _ := f()\nfmt.Println(1)\npassword := "abcd"', "e.rb": 'API_KEY = "abcdef"',
    }
    hits = linerules.generic_hits(files.lines(table(spark, files=good)))
    assert {r.title for r in hits.collect()} == {r.title for r in linerules.RULES} - {linerules.RULES[7].title, linerules.RULES[8].title}
    assert linerules.weak_hashes(files.lines(table(spark, files=good))).first().algorithm == "md5"
    none = {"a.py": "except ValueError:\nblueprint(1)\nassertion", "b.go": "v, err := f()", "C.java": "catch (IOException e)"}
    assert linerules.generic_hits(files.lines(table(spark, files=none))).count() == 0


def test_script_sinks_and_context(spark):
    far = "\n" * 12
    text = {"a.js": f"const q = req.query.x\neval(q){far}el.outerHTML = x{far}document.write(escapeHtml(y))", "b.js": "exec(cmd)", "c.js": f"const {{ exec }} = require('child_process')\n{far}exec(cmd)"}
    got = {(r.path, r.rule_id): (r.severity, r.has_source, r.has_sanitizer) for r in scripts.sinks(files.lines(table(spark, files=text))).collect()}
    assert got == {("a.js", "JS001"): ("high", True, False), ("a.js", "JS005"): ("medium", False, False), ("a.js", "JS006"): ("low", False, True), ("c.js", "JS003"): ("high", False, False)}


def test_suppressed_rules(spark):
    lines = files.lines(table(spark, files={"a.js": "eval(x) // pragma: ignore js001 reason: known\neval(y)"}))
    left = linerules.without_suppressed(scripts.sinks(lines), linerules.suppressions(lines))
    assert [r.line_no for r in left.collect()] == [2] and linerules.suppressions(lines).first().reason == "known"


def test_script_quality_looks_at_arguments(spark):
    lines = files.lines(table(spark, files={"a.ts": 'console.log("token")\nconsole.log(token)\n// console.log(token)\ndebugger;\nconst API_KEY = "abcd"'}))
    assert {(r.line_no, r.rule_id) for r in scripts.quality(lines).collect()} == {(1, "QA003"), (2, "SEC002"), (4, "QA003")}
    assert scripts.literal_secrets(lines).first().line_no == 5


def test_markup_provenance(spark):
    cases = {
        "user.js": "const a = event.target.value\nconst b = a\nel.innerHTML = b", "url.js": "el.innerHTML = location.hash", "api.js": "const r = await fetch(u)\nel.innerHTML = r;",
        "static.js": "el.innerHTML = '<b>x</b>';", "none.js": "el.innerHTML = something;", "around.js": "go(localStorage.getItem('x'))\nel.innerHTML = y + z",
        "clean.js": "el.innerHTML = DOMPurify.sanitize(userInput)", "ext.js": "el.insertAdjacentHTML('beforeend', event.data)",
    }
    got = {r.path: (r.source_class, r.severity, r.confidence_delta) for r in scripts.provenance(files.lines(table(spark, files=cases))).collect()}
    assert got == {
        "user.js": ("user_input", "high", 20), "url.js": ("url_data", "high", 15), "api.js": ("api_response", "medium", 5), "static.js": ("static_constant", "info", -30),
        "none.js": ("unknown", "medium", -5), "around.js": ("external_data", "medium", 5), "clean.js": ("user_input", "medium", 10), "ext.js": ("external_data", "medium", 5),
    }


def test_python_flows(spark):
    text = "\n".join([
        "cmd = request.args['c']", "alias = cmd", "subprocess.run(alias, shell=True)", "subprocess.run(['git', 'status'])", "eval('1')", "eval(alias)",
        "safe = shlex.quote(cmd)", "os.system(safe)", "api_key = 'abcd1234'", "password = 'changeme'", "db.execute(f'select {x}')", "db.execute('SELECT %s' % x)",
        "open(cmd)", "open(other)", "yaml.load(data)",
    ])
    got = {(r.line_no, r.rule_id, r.severity) for r in pyflow.flows(table(spark, files={"a.py": text, "bad.py": "def (", "c.js": "eval(x)"})).collect()}
    assert got == {(3, "PY003", "critical"), (6, "PY001", "high"), (8, "PY004", "high"), (9, "SEC001", "high"), (11, "PY005", "high"), (12, "PY005", "high"), (13, "PY006", "high"), (15, "PY008", "high")}


def test_configuration(spark):
    text = {
        "Dockerfile": "FROM a\nUSER app\nFROM b\nENV API_KEY=abcdefgh12\nENV OTHER=abcdefgh12", "x/Dockerfile.dev": "FROM a\nUSER app",
        "docker-compose.yml": "  - PASSWORD=hunter22\n  - SECRET=${X}\n  - '5432:5432'\n  - '127.0.0.1:6379:6379'",
        ".github/workflows/a.yml": "on: push\nrun: echo ${{ github.event.issue.title }}\n  - uses: a/b@v1\n  - uses: a/b@" + "a" * 40,
        "m.tf": 'cidr_blocks = ["0.0.0.0/0"]\npassword = "hunter2222"\ntoken = "var.token123"\n# password = "hunter2222"',
    }
    got = {(r.path, r.line_no, r.rule_id) for r in config_audit.audit(table(spark, files=text)).collect()}
    assert got == {
        ("Dockerfile", 3, "IAC001"), ("Dockerfile", 4, "IAC003"), ("docker-compose.yml", 1, "IAC004"), ("docker-compose.yml", 3, "IAC005"),
        (".github/workflows/a.yml", 2, "IAC015"), (".github/workflows/a.yml", 3, "IAC014"), ("m.tf", 1, "IAC012"), ("m.tf", 2, "IAC013"),
    }


def test_manifests_and_advisories(spark):
    text = {
        "package.json": '{"dependencies": {"lodash": "^4.17.10", "x": "github:a/b"}, "devDependencies": {"axios": "~1.5.0"}}', "broken/package.json": "{",
        "package-lock.json": '{"packages": {"": {}, "node_modules/a/node_modules/@s/qs": {"version": "6.10.0", "dev": true}}}',
        "requirements-dev.txt": "# c\nrequests==2.30.0\nurllib3\n-r x\nhttps://x\npkg[x]==1", "poetry.lock": '[[package]]\nname = "pillow"\nversion = "9.0.0"\n',
        "go.sum": "a.example/b v1.2.3 h1:abc=\na.example/b v1.2.3/go.mod h1:abc=", "pyproject.toml": '[project]\ndependencies = ["werkzeug>=2.0"]\n[tool.poetry.dependencies]\npython = "3"\ndjango = {version = "^4"}',
        "pom.xml": "<dependency><groupId>g</groupId><artifactId>a</artifactId><version>${v}</version><scope>test</scope></dependency>",
    }
    deps = manifests.dependencies(table(spark, files=text))
    got = {(r.name, r.version, r.ecosystem, r.is_direct) for r in deps.collect()}
    assert got == {
        ("lodash", "4.17.10", "npm", True), ("x", None, "npm", True), ("axios", "1.5.0", "npm", False), ("@s/qs", "6.10.0", "npm", False), ("requests", "2.30.0", "pypi", True),
        ("urllib3", None, "pypi", True), ("pkg", None, "pypi", True), ("pillow", "9.0.0", "pypi", False), ("a.example/b", "1.2.3", "go", False), ("werkzeug", "2.0", "pypi", True),
        ("django", "4", "pypi", True), ("g:a", None, "maven", False),
    }
    hits = {(r.name, r.advisory_id, r.confidence) for r in advisories.affected(deps, advisories.advisory_table(spark)).collect()}
    assert ("lodash", "CVE-2019-10744", 75) in hits and ("urllib3", "CVE-2023-45803", 40) in hits and ("axios", "CVE-2023-45857", 75) in hits and not any(n == "x" for n, *_ in hits)


def test_imports(spark):
    text = {
        "app/__init__.py": "", "app/a.py": "from .b import x\nimport app.c", "app/b.py": "from app.c import y", "app/c.py": "from . import a\nfrom .a import z\nimport os", "other/d.py": "from ..app.a import q",
        "x.py": "import x",
    }
    edges = imports.import_edges(table(spark, files=text))
    got = {(r.src, r.dst) for r in edges.collect()}
    assert {("app.a", "app.b"), ("app.a", "app.c"), ("app.b", "app.c"), ("app.c", "app.a"), ("other.d", "app.a")} <= got
    assert {r.members for r in imports.import_cycles(edges).collect()} == {"app.a > app.c", "app.a > app.b > app.c"}


def test_patches(spark):
    rows = spark.createDataFrame([("eval(a); eval(b)", "eval(a)", "f(a)"), ("eval(a)", "eval(a)", "f(a)"), ("x", "y", "z"), ("eval(a)", "eval(a)", "eval(c)"), (None, "a", "b")], "content string, original string, replacement string")
    got = [r.status for r in patches.verified(rows, lambda c: F.regexp_count(c, F.lit(r"eval\("))).collect()]
    assert got == ["partially_verified", "verified", "failed", "failed", "failed"]
    made = spark.createDataFrame([("PY008", "  d = yaml.load(f)"), ("PY008", "yaml.load(f, Loader=L)"), ("PY001", "yaml.load(f)")], "r string, s string")
    assert [r.x for r in made.select(patches.made_patch(F.col("r"), F.col("s")).alias("x")).collect()] == ["  d = yaml.safe_load(f)", None, None]


def test_python_quality(spark):
    text = "import os, sys\nfrom a import b as c, _d\ndef f(x, y=[]):\n    try:\n        raise\n    except E:\n        raise\n    return sys.path\ndef _g(): pass\ndef h() -> int: return 1\n__all__ = ['c']\n"
    got = {(r.line_no, r.rule, r.name) for r in pyquality.python_quality(table(spark, files={"a.py": text, "b.py": "def (", "c.py": None})).collect()}
    assert got == {(1, "unused_import", "os"), (3, "missing_return_annotation", "f"), (3, "mutable_default", "f"), (5, "bare_raise", "")}
