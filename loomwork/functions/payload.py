"""Expressions over raw JSON payloads, as variants inside the JVM; null where a field is missing or of another type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwork.functions.text import collapse, nonempty, truncate

#: Keys that hold a path, in order of preference; fixed values.
PATH_KEYS_A = ("file_path", "filePath", "path", "target_file", "notebook_path")
PATH_KEYS_B = ("path", "file_path", "filePath", "target_file", "targetFile", "notebook_path")
EVENT_PATH_KEYS = ("file_path", "target_file", "targetFile", "path", "filePath", "notebook_path", "notebookPath")
EVENT_TOP_KEYS = ("file_path", "target_file", "path")
#: Keys that sum an input up, in order of preference; fixed values.
SUMMARY_KEYS_A = ("command", "pattern", "query", "prompt", "description", "url")
SUMMARY_KEYS_B = ("command", "pattern", "query", "search_term", "glob_pattern", "description", "explanation")


def opened(text: Column) -> Column:
    """The variant of a JSON text, or of the JSON that a JSON string holds."""
    inner = F.when(F.ltrim(text).startswith('"'), F.try_variant_get(F.try_parse_json(text), "$", "string")).otherwise(text)
    return F.try_parse_json(inner)


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, ... of a variant; null of null."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def text_at(v: Column, path: str) -> Column:
    """The string at a path; null if something else is there."""
    at = F.try_variant_get(v, path, "variant")
    return F.when(kind(at) == "STRING", F.try_variant_get(v, path, "string"))


def parts(v: Column) -> Column:
    """content as an array of variants; string content as one text part; null if neither."""
    whole = text_at(v, "$.content")
    return F.coalesce(
        F.try_variant_get(v, "$.content", "array<variant>"),
        F.when(whole.isNotNull(), F.array(F.try_parse_json(F.to_json(F.struct(F.lit("text").alias("type"), whole.alias("text"))))))
    )


def content_text(v: Column, path: str = "$.content") -> Column:
    """A polymorphic content's text: the string, or the text parts one per line."""
    pieces = F.transform(F.try_variant_get(v, path, "array<variant>"), lambda p: F.when(text_at(p, "$.type") == "text", text_at(p, "$.text")))
    return F.coalesce(text_at(v, path), F.array_join(F.filter(pieces, lambda x: nonempty(x).isNotNull()), "\n"))


def _paths(v: Column, keys: tuple[str, ...]) -> Column:
    return F.filter(F.array(*[text_at(v, f"$.{k}") for k in keys]), lambda x: nonempty(x).isNotNull())


def files_of(v: Column, keys: tuple[str, ...] = PATH_KEYS_A, distinct: bool = False) -> Column:
    """Paths of a tool input: those of its own keys in order, then those of its edits, to any depth, in the order of the text.

    Edits that hold edits are opened level by level in their place; the text names as many levels at most as the word edits."""
    edits = lambda x: F.coalesce(F.try_variant_get(x, "$.edits", "array<variant>"), F.array().cast("array<variant>"))
    node = lambda x: F.struct(_paths(x, keys).alias("paths"), edits(x).alias("below"))
    opened_up = lambda n: F.concat(
        F.array(F.struct(n["paths"].alias("paths"), F.array().cast("array<variant>").alias("below"))), F.transform(n["below"], node)
    )
    levels = F.slice(F.sequence(F.lit(0), F.regexp_count(F.to_json(v), F.lit('"edits"'))), F.lit(2), F.lit(1 << 30))
    nested = F.aggregate(levels, F.array(node(v)), lambda nodes, _: F.flatten(F.transform(nodes, opened_up)))
    found = F.when(F.size(edits(v)) > 0, F.flatten(F.transform(nested, lambda n: n["paths"]))).otherwise(_paths(v, keys))
    return F.array_distinct(found) if distinct else found


def summary_of(v: Column, keys: tuple[str, ...] = SUMMARY_KEYS_A, size: int = 200) -> Column:
    """The first non-empty of the keys, single-spaced, at most size bytes; '' without one."""
    return truncate(F.coalesce(*[nonempty(collapse(text_at(v, f"$.{k}"))) for k in keys], F.lit("")), size)


def event_session(v: Column) -> Column:
    return F.coalesce(nonempty(text_at(v, "$.session_id")), nonempty(text_at(v, "$.conversation_id")))


def event_path(v: Column) -> Column:
    """The file that a touch event names: in its tool input, else at its top."""
    held = [nonempty(text_at(v, f"$.tool_input.{k}")) for k in EVENT_PATH_KEYS]
    return F.coalesce(*held, *[nonempty(text_at(v, f"$.{k}")) for k in EVENT_TOP_KEYS])


def event_dir(v: Column, fallback: Column) -> Column:
    """Where an event happened: its directory, its first workspace, its absolute file's directory, or the fallback."""
    path = event_path(v)
    return F.coalesce(
        nonempty(text_at(v, "$.cwd")),
        nonempty(text_at(v, "$.workspace_roots[0]")),
        F.when(path.startswith("/"), nonempty(F.regexp_replace(path, "/[^/]*$", ""))),
        fallback
    )
