"""Path and name Column helpers (B1-B8, C1).  Pure expressions, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def project_of(path: Column) -> Column:
    """B1: first path segment."""
    return F.split_part(path, F.lit("/"), F.lit(1))


def relative_of(path: Column) -> Column:
    """B1: everything after the first '/'."""
    return F.regexp_extract(path, r"^[^/]*/(.*)$", 1)


def absolute_path(base: str, proj: Column, rel: Column) -> Column:
    """B2: ``base/proj/rel``."""
    return F.concat_ws("/", F.lit(base), proj, rel)


def repo_owner(url: Column) -> Column:
    """Second-to-last segment of a repository URL."""
    return F.try_element_at(F.split(url, "/"), F.lit(-2))


def repo_name(url: Column) -> Column:
    """Last segment of a repository URL."""
    return F.try_element_at(F.split(url, "/"), F.lit(-1))


def owner_repo(url: Column) -> Column:
    """``owner_repo``."""
    return F.concat_ws("_", repo_owner(url), repo_name(url))


def repo_from_owner_repo(p: Column) -> Column:
    """Drop the first ``_`` segment."""
    return F.regexp_replace(p, r"^[^_]*_?", "")


def class_file(rel: Column) -> Column:
    """Source path -> compiled class path."""
    return F.replace(F.replace(rel, F.lit("/src/main/java"), F.lit("/target/classes")),
                     F.lit(".java"), F.lit(".class"))


def qualified_class(rel: Column) -> Column:
    """Path after ``src/main/java/`` as a dotted name without extension."""
    tail = F.split_part(rel, F.lit("src/main/java/"), F.lit(2))
    return F.regexp_replace(F.replace(tail, F.lit("/"), F.lit(".")), r"\.java$", "")


def package_of(fq: Column) -> Column:
    """Qualified name without its last segment."""
    return F.regexp_replace(fq, r"\.?[^.]*$", "")


def module_dir(rel: Column) -> Column:
    """Module directory (before ``/src/main/java``)."""
    return F.split_part(rel, F.lit("/src/main/java"), F.lit(1))


def test_dir(base: str, proj: Column, rel: Column) -> Column:
    """Per-class generated-test output directory."""
    return F.concat_ws("/", F.lit(base), proj, module_dir(rel), F.lit("evosuite-tests"),
                       F.replace(qualified_class(rel), F.lit("."), F.lit("/")))


def is_main_source(rel: Column) -> Column:
    """Not containing ``test`` and containing ``src/main/java``."""
    return ~F.contains(rel, F.lit("test")) & F.contains(rel, F.lit("src/main/java"))
