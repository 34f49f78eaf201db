import random

from codequarry.llm.handwritten import canonical, layout, not_handwritten

SCHEMA = "file_id long, relative_path string, content string, kind string, lines int"
HAND = 'import os\n\n\ndef load(path, limit=3):\n    """Read the rows."""\n    rows = []\n    with open(path) as fh:\n        for line in fh:\n            if len(rows) > limit:\n                break\n            rows.append(line.strip())\n    return sorted(rows)\n'


def kinds(spark, files):
    rows = [(i, p, c, "clash", 1) for i, (p, c) in enumerate(files)]
    got = not_handwritten(spark.createDataFrame(rows + rows[:1], SCHEMA))
    found = {r.file_id: r.kind for r in got.collect()}
    return [found.get(i) for i in range(len(files))]


def test_kinds(spark):
    r = random.Random(1)
    mini = "".join(f"var a{i}=function(b){{return b*{i}}};" for i in range(40))
    uniform = "".join(f"export function get{i}(m) {{\n  return m.values[{i}];\n}}\n" for i in range(20))
    data = "ROWS = [\n" + "".join("    " + ", ".join(f"{r.random():.5f}" for _ in range(6)) + ",\n" for _ in range(60)) + "]\n"
    icon = "export const icon = 'M" + " ".join(str(r.randrange(999)) for _ in range(200)) + "';\nexport function draw(c) {\n  c.stroke(icon);\n}\n"
    table = "LIMITS = [\n" + "".join(f'    ("name {i}", {i}),  # because\n' for i in range(20)) + "]\n"
    files = [
        ("web/yarn.lock", "a@1:\n  version 1\n"), ("src/x.pb.go", "package a\n"), ("src\\a.js", "// Code generated by tool v1. DO NOT EDIT.\nlet a = 1\n"), ("a/b.py", HAND + "\n# @generated by tool\n"),
        ("src/u.js", uniform), ("web/app.js", mini), ("src/data.py", data), ("vendor/lib/a.py", HAND.replace("load", "fetch")), ("app/b.py", "# a comment\r\n" + HAND.replace("load", "fetch").replace("\n", "\r\n")),
        ("x/c.go", "// SPDX-License-Identifier: MIT\n// tinygrid 5.3.4\npackage a\n"), ("libs/x/y.js", "/* corvid v2.5.6 | (c) corvid authors | MIT */\nlet a = 1\n"),
        ("app/own.go", "// SPDX-License-Identifier: MIT\npackage a\n"), ("app/own.py", "# Licensed under the Apache License, Version 2.0\n" + HAND.replace("rows", "parts")), ("libs/shared/own.py", HAND.replace("rows", "cells")), ("deps/own.py", HAND.replace("rows", "bits")),
        ("app/a.py", HAND), ("src/icon.js", icon), ("app/table.py", table), ("app/vendor_portal/x.py", HAND.replace("rows", "items")), ("tools/codegen/w.py", 'HEADER = "# Code generated by us. DO NOT EDIT."\n' + HAND),
        ("src/a.bundle.ts", "// ids are generated by the database, never here\nexport const a = 1;\n"), ("x.py", None), ("", ""), (None, "x"), ("data.json", data),
    ]
    assert kinds(spark, files) == ["lock file", "generated", "generated", "generated", "generated", "minified", "data", "third party", "third party", "third party", "third party"] + [None] * 14


def test_empty_and_long(spark):
    assert not_handwritten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert layout("x = '" + "\\'" * 200_000 + "'\n", "py")[0] == 1
    assert layout('"' * 9 + "\n/* open", "js")[0] >= 1


def test_emission_joins_and_splits_lines():
    lines, emitted = canonical("if (a) { b( 1 , 2 ); c() ; }\nreturn x", False)
    assert lines == ["if(a){b(1,2);c();}", "return x"] and emitted == ["if(a){", "b(1,2);", "c();", "}", "return x"]
    assert canonical("f(a,\n   b)\nx = [\n 1\n]\n", True)[1] == ["f(a,b)", "x=[1]"]


def test_layout_alone_tells_minified_generated_and_data(spark):
    """No notice, no path: the comparison with the canonical layout decides."""
    mini = "".join(f"var a{i}=function(b){{return b*{i}}};" for i in range(40))
    uniform = "".join(f"def get_{i}(m): return m.values[{i}]\n" for i in range(20))
    assert kinds(spark, [("a.js", mini), ("a.py", uniform), ("a.go", "package a\nvar x = \"" + "q8" * 900 + "\"\n"), ("b.py", HAND)]) == ["minified", "generated", "data", None]
