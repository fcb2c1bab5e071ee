"""Scalar derivations as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Language by file extension.
LANGUAGES = {
    "py": "python", "js": "javascript", "ts": "typescript", "tsx": "typescript", "jsx": "javascript",
    "java": "java", "go": "go", "rs": "rust", "rb": "ruby", "php": "php", "c": "c", "cpp": "cpp", "h": "c",
    "hpp": "cpp", "cs": "csharp", "swift": "swift", "kt": "kotlin", "scala": "scala", "yml": "yaml",
    "yaml": "yaml", "json": "json", "toml": "toml", "md": "markdown", "sh": "bash", "bash": "bash",
    "sql": "sql", "dockerfile": "docker",
}
# File names and extensions that are not reviewed.
SKIPPED_NAMES = ["package-lock.json", "yarn.lock", "poetry.lock", "Pipfile.lock", "pnpm-lock.yaml", "go.sum"]
SKIPPED_EXTENSIONS = ["png", "jpg", "jpeg", "gif", "svg", "ico", "woff", "woff2", "ttf", "eot", "min.js", "min.css"]
# Extension of a snippet's file by language.
SNIPPET_EXTENSIONS = {"python": "py", "javascript": "js", "typescript": "ts", "java": "java", "go": "go", "rust": "rs", "ruby": "rb"}


def lookup(key: Column, values: dict[str, str], default: str | None = None) -> Column:
    """A literal map's value, null or a default where there is none."""
    pairs = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    found = F.try_element_at(pairs, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """After the last dot of the whole path, case kept; empty without a dot."""
    return F.when(F.contains(path, F.lit(".")), F.substring_index(path, ".", -1)).otherwise(F.lit(""))


def language(path: Column) -> Column:
    name = F.lower(basename(path))
    return F.when(name == "dockerfile", "docker").when(name == "makefile", "make").otherwise(lookup(F.lower(extension(path)), LANGUAGES))


def reviewable(path: Column, status: Column) -> Column:
    return ~basename(path).isin(SKIPPED_NAMES) & ~extension(path).isin(SKIPPED_EXTENSIONS) & (F.coalesce(status, F.lit("modified")) != "removed")


def hashed_id(*parts: Column | str) -> Column:
    """First 16 hexadecimal digits of the SHA-256 of the parts."""
    return F.substring(F.sha2(F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)), 256), 1, 16)


def strip(text: Column) -> Column:
    """Without white space at either end (Unicode white space, not only blanks)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def present_keys(**columns: Column) -> Column:
    """A map of the columns that aren't null."""
    return F.map_filter(F.create_map(*(x for k, v in columns.items() for x in (F.lit(k), v.cast("string")))), lambda _, v: v.isNotNull())


def snippet_extension(lang: Column) -> Column:
    return lookup(lang, SNIPPET_EXTENSIONS, "txt")


def collection(repo: Column) -> Column:
    return F.concat(F.lit("repository_code_"), F.replace(repo, F.lit("/"), F.lit("_")))


def score(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - distance)
