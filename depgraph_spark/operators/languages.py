"""Language table: what marks a project, which files count, and how an import line names a file.

A language is a record of column expressions. ``register_language`` adds one; nothing else has to change.

An import is resolved in two halves. ``bases`` turns a specifier into path stems, in order of preference, and
``suffixes`` lists what may follow a stem, in order. The suffixes are applied to the *files* (see ``resolve``), so a
specifier stays one row per stem instead of one per candidate path.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.paths import dirname, resolve_under

# Blank characters that the line rules trim and match.
_WIDE = [0x00A0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
BLANKS = "\t\n\x0b\x0c\r " + "".join(chr(c) for c in _WIDE)
_WIDE_CLASS = "".join(f"\\u{c:04X}" for c in _WIDE)
_BLANK_CLASS = r"\t\n\x0B\f\r " + _WIDE_CLASS
_SEPARATORS = r"\u2028\u2029"
S = f"[{_BLANK_CLASS}]"
GAP = S.replace(r"\n", "")
TEXT = f"[^{_BLANK_CLASS}]"
NS = f"[^{_BLANK_CLASS}]"
ANY = rf"[^\n\r{_SEPARATORS}]"
QUOTE = r"""['"]"""


@dataclass(frozen=True)
class Language:
    """One language.

    ``lines``: text -> candidate lines (array); ``spec``: trimmed line -> specifier, '' or null if there is none;
    ``bases``: specifier, path, source_dir, package -> stems (array, null for what is not ours).
    """

    id: str
    extensions: tuple[str, ...]
    lines: Callable[[Column], Column]
    spec: Callable[[Column], Column]
    bases: Callable[[Column, Column, Column, Column], Column]
    suffixes: tuple[str, ...] = ("",)
    manifests: tuple[str, ...] = ()
    manifest_depth: int = 0
    skip_endings: tuple[str, ...] = ()
    source_dirs: tuple[tuple[str, ...], ...] = ()
    fallback_root: bool = False
    spread_dirs: bool = False
    to_directory: bool = False
    aliases: bool = False


def trim_line(line: Column) -> Column:
    return F.trim(line, F.lit(BLANKS))


def _found(line: Column, pattern: str) -> Column:
    """Group 1 of a pattern. Characters beyond ASCII, which make classes slow, are left out where a line has none."""
    narrow = pattern.replace(_WIDE_CLASS, "").replace(_SEPARATORS, "")
    if narrow == pattern:
        return F.regexp_extract(line, pattern, 1)
    ascii_only = F.length(line) == F.octet_length(line)
    return F.when(ascii_only, F.regexp_extract(line, narrow, 1)).otherwise(F.regexp_extract(line, pattern, 1))


def _first(*found: Column) -> Column:
    return F.get(F.array_remove(F.array(*[F.coalesce(s, F.lit("")) for s in found]), F.lit("")), 0)


def lines_starting(*starts: str) -> Callable[[Column], Column]:
    """The lines whose first non-blank text matches one of the patterns: one scan of the text, no row per line."""
    pattern = rf"(?md)^{GAP}*+(?:{'|'.join(starts)})[^\n]*"
    return lambda content: F.regexp_extract_all(content, F.lit(pattern), 0)


def header_lines(words: tuple[str, ...], signs: tuple[str, ...]) -> Callable[[Column], Column]:
    """Import lines before the first non-blank line that starts with none of ``words`` (and a blank) or ``signs``."""
    known = [rf"(?:{'|'.join(words)}) {GAP}*+{TEXT}", *signs]
    body = rf"(?md)^{GAP}*+(?!{'|'.join(known)}){TEXT}[\s\S]*"
    imports = lines_starting("import")
    return lambda content: imports(F.regexp_replace(content, body, ""))


def _stem(folder: Column, rest: Column) -> Column:
    """Stem below a folder; a trailing '/' (or an empty rest) is kept, since it rules out a plain-file match."""
    return F.concat(resolve_under(folder, rest), F.when((rest == "") | rest.endswith("/"), F.lit("/")).otherwise(F.lit("")))


def _relative(folder: Column, rest: Column) -> Column:
    """Stem of a path relative to ``folder``; null for an absolute one, which no repository file matches."""
    return F.when(~rest.startswith("/"), resolve_under(folder, rest))


# --- TypeScript / JavaScript ---------------------------------------------------------------------------------------

TS_FROM = rf"(?:import|export){S}+{ANY}*?from{S}+{QUOTE}({ANY}+?){QUOTE}"
TS_BARE = rf"^import{S}+{QUOTE}({ANY}+?){QUOTE}"
TS_REQUIRE = rf"(?:const|let|var){S}+\w+{S}*={S}*require{S}*\({S}*{QUOTE}({ANY}+?){QUOTE}{S}*\)"


def _ts_spec(line: Column) -> Column:
    return _first(_found(line, TS_FROM), _found(line, TS_BARE), _found(line, TS_REQUIRE))


def _ts_bases(spec: Column, path: Column, _source_dir: Column, _package: Column) -> Column:
    return F.array(F.when(spec.startswith("."), resolve_under(dirname(path), spec)))


# --- Python --------------------------------------------------------------------------------------------------------


def _py_spec(line: Column) -> Column:
    return _first(_found(line, rf"^from{S}+({NS}+){S}+import"), _found(line, rf"^import{S}+({NS}+)"))


def _py_bases(spec: Column, path: Column, source_dir: Column, _package: Column) -> Column:
    named = F.ltrim(spec, F.lit("."))
    dots = F.length(spec) - F.length(named)
    rest = F.replace(named, F.lit("."), F.lit("/"))
    ups = F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0)))
    above = F.concat(dirname(path), F.lit("/"), ups)
    return F.array(F.when(dots > 0, _stem(above, rest)).otherwise(_stem(source_dir, F.replace(spec, F.lit("."), F.lit("/")))))


# --- Dart ----------------------------------------------------------------------------------------------------------


def _dart_spec(line: Column) -> Column:
    return _found(line, rf"^import{S}+{QUOTE}(?!dart:)({ANY}+?){QUOTE}")


def _dart_bases(spec: Column, path: Column, source_dir: Column, package: Column) -> Column:
    own = spec.startswith(F.concat(F.lit("package:"), package, F.lit("/")))
    inside = F.substring(spec, F.length(package) + 10, F.length(spec))
    return F.array(
        F.when(own, resolve_under(source_dir, inside)).when(
            ~spec.startswith("package:"), _relative(dirname(path), spec)
        )
    )


# --- Go ------------------------------------------------------------------------------------------------------------


def _go_lines(content: Column) -> Column:
    block = F.split(F.regexp_extract(content, rf"import{S}*\(([\s\S]*?)\)", 1), "\n")
    singles = F.regexp_extract_all(content, F.lit(rf'(?m)^import{S}+"([^"]+)"'), 1)
    return F.concat(block, F.transform(singles, lambda s: F.concat(F.lit('"'), s, F.lit('"'))))


def _go_spec(line: Column) -> Column:
    return _found(line, r'^"([^"]+)"')


def _go_bases(spec: Column, _path: Column, _source_dir: Column, package: Column) -> Column:
    own = (package != "") & spec.startswith(F.concat(package, F.lit("/")))
    return F.array(F.when(own, resolve_under(F.lit(""), F.substring(spec, F.length(package) + 2, F.length(spec)))))


# --- Rust ----------------------------------------------------------------------------------------------------------


def _rust_spec(line: Column) -> Column:
    declared = _found(line, rf"^mod{S}+(\w+){S}*;")
    return _first(_found(line, rf"^use{S}+(crate::{NS}+)"), F.concat(F.lit("self::"), F.nullif(declared, F.lit(""))))


def _rust_bases(spec: Column, path: Column, source_dir: Column, _package: Column) -> Column:
    used = F.substring(spec, 8, F.length(spec))
    used = F.regexp_replace(F.regexp_replace(F.replace(used, F.lit("::"), F.lit("/")), r";\z", ""), rf"\{{{ANY}*\z", "")
    declared = F.substring(spec, 7, F.length(spec))
    return F.array(
        F.when(spec.startswith("crate::"), _stem(source_dir, used)).otherwise(_stem(dirname(path), declared))
    )


# --- Java ----------------------------------------------------------------------------------------------------------

# Libraries whose imports are never looked up.
JAVA_SKIP = ("java.", "javax.", "org.springframework.", "lombok.")


def _java_spec(line: Column) -> Column:
    skip = "|".join(p.replace(".", r"\.") for p in JAVA_SKIP)
    return _found(line, rf"^import{S}+(?!{skip})([\w.]+){S}*;")


def _java_bases(spec: Column, _path: Column, source_dir: Column, _package: Column) -> Column:
    return F.array(resolve_under(source_dir, F.concat(F.replace(spec, F.lit("."), F.lit("/")), F.lit(".java"))))


# --- C and C++, Ruby -----------------------------------------------------------------------------------------------


def _cpp_spec(line: Column) -> Column:
    return _found(line, rf'^#include{S}+"({ANY}+?)"')


def _cpp_bases(spec: Column, path: Column, source_dir: Column, _package: Column) -> Column:
    return F.array(
        _relative(dirname(path), spec),
        resolve_under(source_dir, spec),
        resolve_under(F.lit("include"), spec),
        resolve_under(F.lit(""), spec),
    )


def _ruby_spec(line: Column) -> Column:
    return _found(line, rf"^require_relative{S}+{QUOTE}({ANY}+?){QUOTE}")


def _ruby_bases(spec: Column, path: Column, _source_dir: Column, _package: Column) -> Column:
    return F.array(_relative(dirname(path), F.concat(spec, F.lit(".rb"))))


# --- Registry ------------------------------------------------------------------------------------------------------

# Extensions, manifests and source folders per language; the order decides whose package name wins.
_BUILT_IN = [
    Language(
        "dart",
        (".dart",),
        header_lines(("import", "library", "part", "export"), ("//",)),
        _dart_spec,
        _dart_bases,
        manifests=("pubspec.yaml",),
        source_dirs=(("lib",),),
    ),
    Language(
        "typescript",
        (".ts", ".tsx", ".js", ".jsx"),
        lines_starting(r"""[iecvl][^\n'"]*['"]"""),
        _ts_spec,
        _ts_bases,
        ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js"),
        manifests=("tsconfig.json", "package.json"),
        manifest_depth=1,
        skip_endings=(".d.ts",),
        spread_dirs=True,
        aliases=True,
    ),
    Language(
        "python",
        (".py",),
        lines_starting("from", "import"),
        _py_spec,
        _py_bases,
        (".py", "/__init__.py"),
        manifests=("pyproject.toml", "requirements.txt", "setup.py", "setup.cfg"),
        manifest_depth=1,
        spread_dirs=True,
        fallback_root=True,
    ),
    Language(
        "go",
        (".go",),
        _go_lines,
        _go_spec,
        _go_bases,
        manifests=("go.mod",),
        skip_endings=("_test.go",),
        fallback_root=True,
        to_directory=True,
    ),
    Language(
        "rust",
        (".rs",),
        lines_starting("use", "mod"),
        _rust_spec,
        _rust_bases,
        (".rs", "/mod.rs"),
        manifests=("Cargo.toml",),
        source_dirs=(("src",),),
    ),
    Language(
        "java",
        (".java",),
        header_lines(("import", "package"), ("//", r"/\*", r"\*")),
        _java_spec,
        _java_bases,
        manifests=("pom.xml", "build.gradle", "build.gradle.kts"),
        source_dirs=(("src/main/java",), ("src",)),
    ),
    Language(
        "cpp",
        (".cpp", ".cc", ".cxx", ".c", ".h", ".hpp", ".hxx"),
        lines_starting("#include"),
        _cpp_spec,
        _cpp_bases,
        manifests=("CMakeLists.txt", "Makefile", "meson.build"),
        source_dirs=(("src", "include"),),
        fallback_root=True,
    ),
    Language(
        "ruby",
        (".rb",),
        lines_starting("require_relative"),
        _ruby_spec,
        _ruby_bases,
        manifests=("Gemfile",),
        source_dirs=(("lib",),),
        fallback_root=True,
    ),
]
_REGISTRY: list[Language] = list(_BUILT_IN)


def languages() -> list[Language]:
    """Registered languages in registration order."""
    return list(_REGISTRY)


def language(lang_id: str) -> Language:
    return next(lang for lang in _REGISTRY if lang.id == lang_id)


def register_language(lang: Language) -> None:
    """Add a language; its files, imports and manifests take part in every later job. An id may be taken only once."""
    if any(known.id == lang.id for known in _REGISTRY):
        raise ValueError(f"language {lang.id!r} is registered already")
    _REGISTRY.append(lang)


def unregister_language(lang_id: str) -> None:
    _REGISTRY[:] = [lang for lang in _REGISTRY if lang.id != lang_id]
