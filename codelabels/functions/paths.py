"""Repository names, file keys and path tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import FILE_TYPE, PATH_LIMIT


def repository_name(url: Column) -> Column:
    """Text after the last slash without any ``.git`` in it."""
    return F.replace(F.substring_index(url, "/", -1), F.lit(".git"), F.lit(""))


def relevant_path(a_path: Column, b_path: Column) -> Column:
    """The new path, or the old one when a file was removed."""
    return F.coalesce(F.when(b_path != "", b_path), a_path)


def has_type(path: Column, file_type: str = FILE_TYPE) -> Column:
    return path.endswith(f".{file_type}")


def file_extension(path: Column) -> Column:
    """Last dot and what follows in the base name; leading dots do not count."""
    return F.regexp_extract(F.substring_index(path, "/", -1), r"(?s)^\.*[^.].*(\.[^.]*)$", 1)


def file_key(path: Column, sha: Column) -> Column:
    """Flat file name for one path in one commit (``a/b`` and ``a_b`` collide)."""
    flat = F.regexp_replace(F.replace(path, F.lit("/"), F.lit("_")), r"(?s)\.[^.]*\z", "")
    dashed = F.replace(flat, F.lit("."), F.lit("-"))
    return F.concat(dashed, F.lit("_"), F.substring(sha, 1, 7), file_extension(path))


def temp_path(path: Column, sha: Column, base: str) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/"), file_key(path, sha))


def path_fits(path: Column, limit: int = PATH_LIMIT) -> Column:
    return F.length(path) <= limit


def temp_path_fits(path: Column, sha: Column, base: str, limit: int = PATH_LIMIT) -> Column:
    """Does :func:`temp_path` fit? It adds nine characters to the path and the base at most, so few have to be made for that."""
    short = F.length(path) + len(base.rstrip("/")) + 9 <= limit
    return short | path_fits(temp_path(path, sha, base), limit)


def stem(path: Column) -> Column:
    """Base name up to its first dot: the identity of a file within a run."""
    return F.substring_index(F.substring_index(path, "/", -1), ".", 1)
