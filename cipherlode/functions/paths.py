"""What a file is, by its path: patterns that both the tree reader and Column expressions use."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: kind -> pattern of the base name; the first that fits. Fixed values.
KINDS = {
    "js": r"(?i)\.(js|mjs|cjs|jsx|ts|mts|cts|tsx)$",
    "manifest": r"^package\.json$",
    "lockfile": r"^(package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.yaml)$",
    "tls": r"(?i)(\.conf(\.[A-Za-z0-9_-]+)?|^(nginx|httpd|apache2?|ssl)[.A-Za-z0-9_-]*|^caddyfile[.A-Za-z0-9_-]*|\.caddyfile)$",
}
#: Folders that are never entered; folders that hold tests. Fixed values.
NEVER = ["node_modules", ".git"]
TEST_FOLDERS = ["test", "tests", "__tests__", "spec", "specs", "test-d"]
#: A larger file isn't read; a text with a zero character among the first ones is binary. Fixed values.
LARGEST, SNIFFED = 16 << 20, 8000


def kind_of_name(name: str) -> str | None:
    return next((k for k, p in KINDS.items() if re.search(p, name)), None)


def excludes(values: list[str] | tuple[str, ...]) -> list[str]:
    """Names or paths to leave out, as they are compared: with /, without ./ in front and / at the end."""
    out = [re.sub(r"/+$", "", re.sub(r"^\./", "", v.replace("\\", "/"))) for v in values]
    return [v for v in out if v]


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def kind(path: Column) -> Column:
    """js, manifest, lockfile, tls, or null for a file that isn't read."""
    name = base_name(path)
    return F.coalesce(*(F.when(name.rlike(p), k) for k, p in KINDS.items()))


def left_out(path: Column, values: list[str] | tuple[str, ...] = ()) -> Column:
    """Whether a path is below a folder that is never entered, or is excluded by a part's name or from the root on."""
    parts = F.split(path, "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    out = F.arrays_overlap(folders, F.array(*map(F.lit, NEVER)))
    for v in excludes(values):
        out = out | F.array_contains(parts, v) | (path == v) | path.startswith(f"{v}/")
    return out


def in_test(path: Column, texts: list[str] | tuple[str, ...] = ()) -> Column:
    """Whether a file is test code: by a folder above it, .test. or .spec. in its name, or one of texts in its path."""
    parts = F.split(path, "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    out = F.arrays_overlap(folders, F.array(*map(F.lit, TEST_FOLDERS))) | base_name(path).rlike(r"\.(test|spec)\.")
    for t in filter(None, texts):
        out = out | path.contains(t)
    return out


def why_skipped(size: Column, text: Column) -> Column:
    """larger than 16 MB, binary, or null."""
    return F.when(size > LARGEST, "larger than 16 MB").when(F.instr(F.substring(text, 1, SNIFFED), "\0") > 0, "binary")


def utf16(text: Column) -> Column:
    """A sort key that orders text by UTF-16 units."""
    return F.hex(F.encode(text, "UTF-16BE"))
