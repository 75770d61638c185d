"""Import rules on hand-written files."""

import pytest
from pyspark.sql import functions as F

from depgraph_spark.functions import paths
from depgraph_spark.operators import languages as langs
from depgraph_spark.operators import resolve
from depgraph_spark.operators.languages import Language, lines_starting, register_language, unregister_language
from depgraph_spark.operators.resolve import (
    dependency_edges,
    import_stems,
    resolution_index,
    resolve_imports,
    specifiers,
    unresolved_imports,
)
from depgraph_spark.sources.listing import source_dirs
from depgraph_spark.sources.manifests import declared_packages, path_aliases


def graph(spark, files, **options):
    """Edges as {(src, dst): n_refs} of one repository given as {path: text}."""
    rows = [("r", p, c) for p, c in files.items()]
    src = spark.createDataFrame(rows, "repo string, path string, content string")
    found = dependency_edges(
        src, packages=declared_packages(src), aliases=path_aliases(src), **options
    ).collect()
    return {(r["src"], r["dst"]): r["n_refs"] for r in found}


def test_typescript(spark):
    files = {
        "package.json": "{}",
        "tsconfig.json": '{"compilerOptions": {"paths": {"@/*": ["lib/*", "src/*"], "~x": ["src/d.ts"]}}} // end',
        "src/a.ts": "\n".join(
            [
                "import { b } from './b';",
                "  export * from \"./b\"  ",
                "import './side';",
                "const c = require('./sub');",
                "const { d } = require('./d');",
                "// import x from './d'",
                "* import x from './d'",
                "import {",
                "  d",
                "} from './d';",
                "import react from 'react';",
                "import e from '@/e';",
                "import f from '~x';",
                "let g = require ( '../src/g' ) ; let h = require('./d')",
                "import t from './types'; import v from './b'",
                "import gone from '../../x';",
                "import js from './data.json';",
                "import s from './a';",
            ]
        ),
        "src/b.ts": "",
        "src/b.js": "",
        "src/side.tsx": "",
        "src/sub/index.js": "",
        "src/d.ts": "",
        "src/e.ts": "",
        "lib/e.jsx": "",
        "src/g.js": "",
        "src/types.d.ts": "",
        "src/data.json": "",
        "src/data.json.ts": "",
        "src/node_modules/m/index.js": "import '../../b'",
    }
    assert graph(spark, files) == {
        ("src/a.ts", "src/b.ts"): 2,
        ("src/a.ts", "src/side.tsx"): 1,
        ("src/a.ts", "src/sub/index.js"): 1,
        ("src/a.ts", "lib/e.jsx"): 1,
        ("src/a.ts", "src/d.ts"): 1,
        ("src/a.ts", "src/g.js"): 1,
        ("src/a.ts", "src/a.ts"): 1,
    }


def test_typescript_folder_shadow(spark):
    files = {"package.json": "", "a.ts": "import './d'", "d/index.ts": "", "d/x.ts": ""}
    assert graph(spark, files) == {("a.ts", "d/index.ts"): 1}
    assert graph(spark, files, strict_dir_shadow=True) == {}


def test_python(spark):
    files = {
        "setup.py": "",
        "pkg/a.py": "\n".join(
            [
                "from . import x",
                "from .b import y",
                "from ..top import z",
                "from ...out import z",
                "import sub.c",
                "import b, d",
                "# import d",
                "\timport d as q\r",
                "from d import (",
                "fromd import z",
                "from .sub import e",
            ]
        ),
        "pkg/__init__.py": "",
        "pkg/b.py": "",
        "pkg/d.py": "",
        "pkg/sub/c.py": "",
        "pkg/sub/__init__.py": "",
        "top.py": "import pkg.b",
        "pkg.py": "",
    }
    assert graph(spark, files) == {
        ("pkg/a.py", "pkg/__init__.py"): 1,
        ("pkg/a.py", "pkg/b.py"): 1,
        ("pkg/a.py", "top.py"): 1,
        ("pkg/a.py", "pkg/sub/c.py"): 1,
        ("pkg/a.py", "pkg/d.py"): 2,
        ("pkg/a.py", "pkg/sub/__init__.py"): 1,
        ("top.py", "pkg/b.py"): 1,
    }


def test_dart_header(spark):
    files = {
        "pubspec.yaml": "name: app\n",
        "lib/a.dart": "\n".join(
            [
                "// note",
                "library a;",
                "",
                "import 'dart:io';",
                "import 'package:app/b.dart';",
                "import 'package:other/c.dart';",
                "  import \"sub/d.dart\";",
                "import '/b.dart';",
                "part 'p.dart';",
                "export 'c.dart';",
                "void main() {}",
                "import 'c.dart';",
            ]
        ),
        "lib/b.dart": "import\nimport 'c.dart';",
        "lib/c.dart": "/* x */\nimport 'b.dart';",
        "lib/sub/d.dart": "import '../c.dart';",
    }
    assert graph(spark, files) == {
        ("lib/a.dart", "lib/b.dart"): 1,
        ("lib/a.dart", "lib/sub/d.dart"): 1,
        ("lib/sub/d.dart", "lib/c.dart"): 1,
    }


def test_java_header(spark):
    files = {
        "pom.xml": "",
        "src/main/java/a/A.java": "\n".join(
            [
                "package a;",
                "/* c",
                " * d */",
                "import a.B;",
                "import a.sub.*;",
                "import static a.D.x;",
                "import java.util.List;",
                "import a.sub.C ;",
                "import javafx.D;",
                "class A {}",
                "import a.D;",
            ]
        ),
        "src/main/java/a/B.java": "",
        "src/main/java/a/D.java": "",
        "src/main/java/a/sub/C.java": "",
        "src/main/java/java/util/List.java": "",
        "src/main/java/javafx/D.java": "",
        "src/E.java": "import a.B;",
    }
    a = "src/main/java/a/A.java"
    assert graph(spark, files) == {
        (a, "src/main/java/a/B.java"): 1,
        (a, "src/main/java/a/sub/C.java"): 1,
        (a, "src/main/java/javafx/D.java"): 1,
    }


def test_go(spark):
    files = {
        "go.mod": "// m\nmodule ex.org/app\n",
        "main.go": "\n".join(
            [
                "package main",
                'import "ex.org/app/one"',
                "import (",
                '\t"fmt"',
                '\tq "ex.org/app/aliased"',
                '\t"ex.org/app/two"',
                '\t"ex.org/application/two"',
                ")",
                "import (",
                '\t"ex.org/app/late"',
                ")",
            ]
        ),
        "one/a.go": "",
        "one/deep/b.go": "",
        "one/a_test.go": "",
        "one/vendor/c.go": "",
        "two/x.go": "",
        "aliased/y.go": "",
        "late/z.go": "",
    }
    assert graph(spark, files) == {
        ("main.go", "one/a.go"): 1,
        ("main.go", "one/deep/b.go"): 1,
        ("main.go", "two/x.go"): 1,
    }


def test_rust_cpp_ruby(spark):
    rust = {
        "Cargo.toml": "",
        "src/main.rs": "use crate::a::b;\nuse crate::a::b::Item;\nuse crate::c::{x, y};\nmod d;\npub mod a;\npub use crate::e;\nmod  f ;",
        "src/a/b.rs": "",
        "src/a/mod.rs": "",
        "src/c.rs": "",
        "src/c/mod.rs": "",
        "src/d/mod.rs": "",
        "src/e.rs": "",
        "src/f.rs": "",
    }
    assert graph(spark, rust) == {
        ("src/main.rs", "src/a/b.rs"): 1,
        ("src/main.rs", "src/c/mod.rs"): 1,
        ("src/main.rs", "src/d/mod.rs"): 1,
        ("src/main.rs", "src/f.rs"): 1,
    }
    cpp = {
        "Makefile": "",
        "src/m/a.cpp": '#include "own.h"\n#include "top.h"\n#include "api.h"\n#include <own.h>\n#include "root.h"\n # include "own.h"\n#include "both.h"',
        "src/m/own.h": "",
        "src/top.h": "",
        "include/api.h": "",
        "include/both.h": "",
        "src/both.h": "",
        "root.h": "",
    }
    # A header in the root exists, so its search ends there, but it lies in no source folder.
    assert graph(spark, cpp) == {
        ("src/m/a.cpp", "src/m/own.h"): 1,
        ("src/m/a.cpp", "src/top.h"): 1,
        ("src/m/a.cpp", "include/api.h"): 1,
        ("src/m/a.cpp", "src/both.h"): 1,
    }
    ruby = {
        "Gemfile": "",
        "lib/a.rb": "require_relative 'b'\nrequire_relative \"../lib/c/d\"\n# require_relative 'e'\nrequire_relative 'e.rb'\nrequire 'e'",
        "lib/b.rb": "",
        "lib/c/d.rb": "",
        "lib/e.rb": "",
    }
    assert graph(spark, ruby) == {("lib/a.rb", "lib/b.rb"): 1, ("lib/a.rb", "lib/c/d.rb"): 1}


def test_unresolved(spark):
    rows = [("r", "package.json", ""), ("r", "a.ts", "import './no';\nimport './b';\nimport 'lib';"), ("r", "b.ts", "")]
    src = spark.createDataFrame(rows, "repo string, path string, content string")
    dirs = source_dirs(src)
    stems = import_stems(specifiers(src), dirs)
    done = resolve_imports(stems, resolution_index(src.select("repo", "path"), dirs))
    assert [(r["path"], r["spec"]) for r in unresolved_imports(stems, done).collect()] == [("a.ts", "./no")]


def test_register_language(spark):
    lua = Language(
        "lua",
        (".lua",),
        lines_starting("require"),
        lambda line: F.regexp_extract(line, r"^require '([^']+)'", 1),
        lambda spec, path, source_dir, package: F.array(F.translate(spec, ".", "/")),
        (".lua",),
        manifests=("init.lua",),
    )
    register_language(lua)
    try:
        files = {"init.lua": "require 'x.y'", "x/y.lua": "", "package.json": "", "a.ts": "import './b'", "b.ts": ""}
        assert graph(spark, files) == {("init.lua", "x/y.lua"): 1, ("a.ts", "b.ts"): 1}
    finally:
        unregister_language("lua")
    assert "lua" not in [k.id for k in langs.languages()]


@pytest.mark.parametrize("parts", [1, 7])
def test_same_edges_for_any_partitioning(spark, parts):
    rows = [("r", "package.json", "")] + [("r", f"f{i}.ts", f"import './f{(i * 7) % 50}'") for i in range(50)]
    src = spark.createDataFrame(rows, "repo string, path string, content string").repartition(parts)
    got = {(r["src"], r["dst"]) for r in dependency_edges(src).collect()}
    assert got == {(f"f{i}.ts", f"f{(i * 7) % 50}.ts") for i in range(50)}


def test_language_ids_are_taken_once():
    before = langs.languages()
    with pytest.raises(ValueError):
        langs.register_language(langs.language("go"))
    assert langs.languages() == before


def test_paths_without_odd_segments_resolve_as_the_others(spark):
    folders = ["", "a", "a/b", "./a", "a//b", ".a/b", "a/b/", "..", "a/.."]
    rests = ["", "x", "x/y.rb", "../x", "../x/y", "../../x", "..", "../", "./x", "x/", "x//y", "x/../y", ".x", "..x", "../.x", "/x", "../../../x"]
    pairs = spark.createDataFrame([(f, r) for f in folders for r in rests], "f string, r string")
    f, r = F.col("f"), F.col("r")
    rows = pairs.select("f", "r", paths.resolve_under(f, r).alias("got"), paths._shortened(F.concat(f, F.lit("/"), r)).alias("want"))
    assert [row for row in rows.collect() if row["got"] != row["want"]] == []
    names = spark.createDataFrame([(p,) for p in ["", "a", "/a", "a/b", "a/b/", "a//b", "é/ü.rb"]], "p string")
    assert [x["d"] for x in names.select(paths.dirname(F.col("p")).alias("d")).collect()] == ["", "", "", "a", "a/b", "a/", "é"]


def test_edges_of_one_language_hold_its_expressions_alone(spark):
    wide = "require_relative　'../b/é'\nrequire_relative 'c d'\nrequire_relative '../b/x'"
    rows = [("r", "Gemfile", ""), ("r", "a/m.rb", wide), ("r", "b/é.rb", ""), ("r", "b/x.rb", ""), ("r", "a/c.rb", "")]
    texts = spark.createDataFrame(rows, "repo string, path string, content string")
    edges = resolve.dependency_edges(texts, langs=["ruby"])
    assert {(e["src"], e["dst"]) for e in edges.collect()} == {("a/m.rb", "b/é.rb"), ("a/m.rb", "b/x.rb")}
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert "require_relative" in plan and "package:" not in plan and "= dart)" not in plan
