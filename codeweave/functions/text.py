"""Column functions over identifiers, metadata and paths of evidence rows. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Language ids by file extension, and their titles.
LANGUAGE_BY_EXTENSION = {
    ".cs": "csharp",
    ".cshtml": "razor",
    ".sql": "sql",
    ".tsql": "sql",
    ".js": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".html": "html",
    ".css": "css",
    ".scss": "scss",
    ".json": "json",
    ".xml": "xml",
    ".yml": "yaml",
    ".yaml": "yaml",
    ".md": "markdown",
}
LANGUAGE_TITLES = {"csharp": "C# / ASP.NET", "sql": "SQL / T-SQL", "typescript": "TypeScript", "javascript": "JavaScript", "html": "HTML / Angular Templates", "json": "JSON configuration"}


def lookup(table: dict[str, str], key: Column, default: Column) -> Column:
    """A literal map look-up with a default."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), default)


def language_title(language_id: Column) -> Column:
    """an id without a title stands for itself."""
    return lookup(LANGUAGE_TITLES, language_id, language_id)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"(\.[^.]*)$", 1))


def metadata_line(metadata: Column) -> Column:
    """the digits after the first ``line=``, or null."""
    digits = F.regexp_extract(metadata, r"(?i)line=(\d+)", 1)
    return F.when(digits != "", digits.cast("int"))


def metadata_value(metadata: Column, key: str) -> Column:
    """the value of the first ``key=`` part of ``k=v;k=v``; the key in any case; the value may hold ``=``."""
    parts = F.filter(F.split(metadata, ";"), lambda p: F.lower(F.trim(F.substring_index(p, "=", 1))) == key.lower())
    first = F.get(F.filter(parts, lambda p: p.contains("=")), F.lit(0))
    return F.trim(F.regexp_replace(first, r"^[^=]*=", ""))


def after_path(identifier: Column) -> Column:
    """what follows the last ``::``."""
    return F.substring_index(identifier, "::", -1)


def short_identifier(identifier: Column) -> Column:
    """the last path part, then what follows its last ``::``."""
    return after_path(F.regexp_extract(identifier, r"([^/\\]*)$", 1))


def readable_identifier(identifier: Column) -> Column:
    """F3 without .cs, .ts and .sql anywhere, each taken out in turn and in any case."""
    out = short_identifier(identifier)
    for ext in ("cs", "ts", "sql"):
        out = F.regexp_replace(out, rf"(?i)\.{ext}", "")
    return out


def member_name(identifier: Column) -> Column:
    """after the last ``::``, then after the last dot unless it ends the name."""
    tail = after_path(identifier)
    return F.when(tail.rlike(r"\.[^.]+$"), F.substring_index(tail, ".", -1)).otherwise(tail)


def without_global(identifier: Column) -> Column:
    return F.regexp_replace(after_path(identifier), r"^global::", "")


def trace_member(identifier: Column) -> Column:
    """F8: without path and ``global::``, what follows the last dot."""
    return F.substring_index(without_global(identifier), ".", -1)


def receiver_type(identifier: Column) -> Column:
    """F8: what stands before the last dot, or null."""
    name = without_global(identifier)
    head = F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)
    return F.when(head != "", head)


def source_file_path(identifier: Column) -> Column:
    """what stands before the last ``::`` if it looks like a path, else null."""
    head = F.regexp_extract(identifier, r"^(.*)::", 1)
    head = F.when(head != "", head).otherwise(identifier)
    return F.when(head.rlike(r"[/\\]|\.[A-Za-z0-9]+$"), head)


def readable_location(identifier: Column) -> Column:
    """what follows the first colon (the whole, if there is none): the file's name, and behind it the last part
    after ``::`` if there are several."""
    bare = F.when(identifier.contains(":"), F.regexp_replace(identifier, "(?s)^[^:]*:", "")).otherwise(identifier)
    parts = F.filter(F.split(bare, "::"), lambda p: p != "")
    name = F.regexp_extract(F.coalesce(F.get(parts, F.lit(0)), bare), r"([^/\\]*)$", 1)
    return F.when(F.size(parts) <= 1, name).otherwise(F.concat(name, F.lit(" / "), short_identifier(F.element_at(parts, -1))))


def display_locator(source: Column, metadata: Column, line: Column, rel_id: Column) -> Column:
    """line, member, up to two other parts of the metadata and the number of the evidence, each once in any case."""
    member = member_name(source)
    member = F.when((F.trim(member) != "") & (F.lower(member) != "azure-service-reference"), short_identifier(member))
    parts = F.filter(F.transform(F.split(F.coalesce(metadata, F.lit("")), ";"), F.trim), lambda p: (p != "") & ~F.lower(p).rlike("^(?:line|column)="))
    note = F.nullif(F.array_join(F.slice(parts, 1, 2), " - "), F.lit(""))
    shown = F.array_compact(F.array(F.concat(F.lit("Line "), line.cast("string")), member, note, F.concat(F.lit("Evidence #"), rel_id.cast("string"))))
    distinct = F.filter(shown, lambda x, i: (i == 0) | ~F.exists(F.slice(shown, F.lit(1), i), lambda y: F.lower(y) == F.lower(x)))
    return F.array_join(distinct, " - ")


def humanize(kind: Column) -> Column:
    """underscores and hyphens become spaces."""
    return F.translate(kind, "_-", "  ")


def flow_name(metadata: Column) -> Column:
    """a title from the back-end (else front-end) API of a match: words capitalised, slashes spaced."""
    value = F.coalesce(metadata_value(metadata, "backendApi"), metadata_value(metadata, "frontendApi"), metadata)
    value = F.regexp_replace(value, r"^[A-Za-z]+ ", "")
    value = F.regexp_replace(F.regexp_replace(value, r"^/+|/+$", ""), r"[{}]", "")
    value = F.regexp_replace(F.translate(value, "_-", "  "), r"/", " / ")
    words = F.filter(F.split(value, " "), lambda w: w != "")
    title = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), " ")
    return F.when(F.coalesce(title, F.lit("")) == "", "Detected flow").otherwise(title)


def component_stem(path: Column) -> Column:
    """F16: a template's path without ``.html`` if it is ``*.component.html``, else directory and name without extension."""
    return F.when(F.lower(path).endswith(".component.html"), F.regexp_replace(path, r"(?i)\.html$", "")).otherwise(F.regexp_replace(path, r"\.[^./\\]*$", ""))


def top_level_folder(path: Column) -> Column:
    return F.when(path.rlike(r"[/\\]"), F.regexp_extract(path, r"^([^/\\]*)", 1)).otherwise("(root)")


def pascal_split(name: Column) -> Column:
    """F16: the pieces of a PascalCase name."""
    return F.split(F.regexp_replace(name, r"(?<=[a-z0-9])(?=[A-Z])", " "), " ")


def comparable_route(route: Column) -> Column:
    """L3: the path of an absolute URL, without outer slashes, with one leading slash."""
    trimmed = F.trim(route)
    path = F.when(trimmed.rlike(r"(?i)^https?://"), F.regexp_extract(trimmed, r"(?i)^https?://[^/?#]*([^?#]*)", 1)).otherwise(trimmed)
    return F.concat(F.lit("/"), F.regexp_replace(path, r"^/+|/+$", ""))


def qualify(path: Column, identifier: Column) -> Column:
    """``global::`` names lose the prefix; names with a space, URLs and routes stay; others get the file path."""
    return (
        F.when(identifier.startswith("global::"), F.substring(identifier, 9, 1 << 20))
        .when(identifier.contains(" ") | identifier.startswith("/") | identifier.rlike(r"(?i)^https?://"), identifier)
        .otherwise(F.concat(path, F.lit("::"), identifier))
    )
