"""Package names and path aliases read from manifest texts ``(repo, path, content)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import join_path, normalize_path
from ..operators.languages import languages

# Where each language's package name stands.
NAME_RULES = {
    "dart": ("pubspec.yaml", r"(?m)^name:\s*(\S+)"),
    "python": ("pyproject.toml", r'name\s*=\s*"([^"]+)"'),
    "go": ("go.mod", r"(?m)^module\s+(\S+)"),
    "rust": ("Cargo.toml", r'name\s*=\s*"([^"]+)"'),
    "cpp": ("CMakeLists.txt", r"(?i)project\s*\(\s*(\w+)"),
}
GEMSPEC_NAME = r"""\.name\s*=\s*['"]([^'"]+)['"]"""
TSCONFIG = "struct<compilerOptions:struct<baseUrl:string,paths:map<string,array<string>>>>"


def is_manifest(path: Column) -> Column:
    """The root files that names and aliases are read from."""
    names = [name for name, _ in NAME_RULES.values()] + ["package.json", "pom.xml", "tsconfig.json"]
    return ~path.contains("/") & (path.isin(names) | path.endswith(".gemspec"))


def declared_packages(manifests: DataFrame) -> DataFrame:
    """``(repo, lang, package)`` for every root manifest that states a name."""
    path, content = F.col("path"), F.col("content")
    group = F.regexp_extract(content, r"<groupId>([^<]+)</groupId>", 1)
    artifact = F.regexp_extract(content, r"<artifactId>([^<]+)</artifactId>", 1)
    found = {lang: (path == name, F.regexp_extract(content, rule, 1)) for lang, (name, rule) in NAME_RULES.items()}
    found["typescript"] = (path == "package.json", F.get_json_object(content, "$.name"))
    found["java"] = (path == "pom.xml", F.when((group != "") & (artifact != ""), F.concat_ws(".", group, artifact)))
    found["ruby"] = (path.endswith(".gemspec"), F.regexp_extract(content, GEMSPEC_NAME, 1))
    named = F.array(
        *[
            F.when(where, F.struct(F.lit(lang).alias("lang"), F.nullif(name, F.lit("")).alias("package")))
            for lang, (where, name) in found.items()
        ]
    )
    return (
        manifests.where(~path.contains("/"))
        .select("repo", "path", F.explode(F.array_compact(named)).alias("n"))
        .groupBy("repo", F.col("n.lang").alias("lang"))
        .agg(F.min_by("n.package", "path").alias("package"))
        .where(F.col("package").isNotNull())
    )


def package_names(detected_langs: DataFrame, manifests: DataFrame) -> DataFrame:
    """``(repo, lang, package)`` of the first detected language; the repository's own name if none is stated."""
    order = F.lit(None).cast("int")
    for i, lang in enumerate(languages()):
        order = F.when(F.col("lang") == lang.id, F.lit(i)).otherwise(order)
    first = detected_langs.groupBy("repo").agg(F.min_by("lang", order).alias("lang"))
    return first.join(declared_packages(manifests), ["repo", "lang"], "left").select(
        "repo", "lang", F.coalesce("package", "repo").alias("package")
    )


def path_aliases(manifests: DataFrame) -> DataFrame:
    """``(repo, ord, prefix, target_ord, target)`` from the root tsconfig; none if it does not parse."""
    text = F.regexp_replace(F.col("content"), r"(?m)//[^\n\r]*$", "")
    text = F.regexp_replace(text, r",\s*([\]}])", "$1")

    def star(text):
        return F.when(text.endswith("/*"), F.substring(text, 1, F.length(text) - 1)).otherwise(text)

    options = F.from_json(text, TSCONFIG)["compilerOptions"]
    base = F.coalesce(F.nullif(options["baseUrl"], F.lit("")), F.lit("."))
    entries = manifests.where(F.col("path") == "tsconfig.json").select(
        "repo", base.alias("base"), F.posexplode(F.map_entries(options["paths"])).alias("ord", "entry")
    )
    return entries.select(
        "repo", "base", "ord", star(F.col("entry.key")).alias("prefix"),
        F.posexplode("entry.value").alias("target_ord", "target"),
    ).select(
        "repo", "ord", "prefix", "target_ord",
        normalize_path(join_path(F.col("base"), star(F.col("target")))).alias("target"),
    )
