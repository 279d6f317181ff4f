"""Typed, null-safe access to a JSON document held as VARIANT.

A missing key, a JSON null and a step through something that is not an object all read as null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def json_get(v: Column | str, path: str, as_type: str = "string") -> Column:
    """Value at a dotted path, cast to a Spark type (null where the cast does not apply)."""
    return F.try_variant_get(_column(v), f"$.{path}", as_type)


def json_node(v: Column | str, path: str) -> Column:
    """The sub-document at a dotted path, with JSON null turned into SQL null."""
    node = json_get(v, path, "variant")
    return F.when(~F.is_variant_null(node), node)


def json_first(v: Column | str, *paths: str) -> Column:
    """The first of several locations that holds something."""
    return F.coalesce(*[json_node(v, p) for p in paths])


def json_tree(v: Column | str, paths: Iterable[str], as_type: str) -> tuple[Column, Callable[[str], str]]:
    """All values at the dotted paths in one pass over the document, as nested structs, and where a path lies in them.

    One value is read as ``json_get`` reads it: null where a step meets no object or the cast does not apply. No path may
    be the beginning of another one.
    """
    tree: dict = {}
    for path in paths:
        *heads, last = path.split(".")
        at = tree
        for head in heads:
            at = at.setdefault(head, {})
        at[last] = None

    def ddl(at: dict) -> str:
        return "struct<" + ", ".join(f"`{k}`: {as_type if below is None else ddl(below)}" for k, below in at.items()) + ">"

    return F.try_variant_get(_column(v), "$", ddl(tree)), lambda path: ".".join(f"`{k}`" for k in path.split("."))


def kind(node: Column) -> Column:
    """Type name of a sub-document, such as STRING, BIGINT, BOOLEAN, ARRAY<..>, OBJECT<..>."""
    return F.schema_of_variant(node)


def _as(node: Column, as_type: str) -> Column:
    return F.try_variant_get(node, "$", as_type)


def is_object(node: Column) -> Column:
    """Whether a sub-document is an object; none of its entries is looked at."""
    return _as(node, "struct<>").isNotNull()


def is_number(node: Column) -> Column:
    return kind(node).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")


def to_text(node: Column) -> Column:
    """Strings as they are ('' stays ''), numbers and booleans as text, structures as sorted JSON."""
    return _as(node, "string")


def join_list(node: Column) -> Column:
    """A list as comma separated text ([] becomes ''); anything else as text."""
    return joined(_as(node, "array<string>"), to_text(node))


def joined(entries: Column, text: Column) -> Column:
    """Comma separated entries of a list; the text where there is none."""
    return F.coalesce(F.array_join(entries, ",", "None"), text)


def text_to_long(text: Column) -> Column:
    """A digit string as an integer; the same for the text of any integer. Null does not mean that ``to_long`` is null."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike("^-?[0-9]+$"), trimmed.try_cast("bigint"))


# A cast to double would also take a trailing type letter, as in 5f or 1d.
_NUMERIC = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(?i:inf|infinity|nan)$"


def text_to_double(text: Column) -> Column:
    """A numeric string, or the text of a number, as a double; the text of nothing else looks like a number."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(_NUMERIC), trimmed.try_cast("double"))


def text_to_bool(text: Column, number: Column) -> Column:
    """A boolean from its text and its cast to bigint: only booleans read as true or false and have a number too."""
    return F.when(text.isin("true", "false") & number.isNotNull(), text == "true")


def to_long(node: Column) -> Column:
    """Integers, truncated decimals and digit strings; booleans and the rest are null."""
    number = F.coalesce(_as(node, "bigint"), _as(node, "double").try_cast("bigint"))
    return F.coalesce(text_to_long(to_text(node)), F.when(is_number(node), number))


def to_double(node: Column) -> Column:
    """Numbers and numeric strings; booleans are not numbers, nor is text with anything beside the number."""
    return text_to_double(to_text(node))


def to_bool(node: Column) -> Column:
    """Real booleans only; 0, 1 and 'true' are not booleans."""
    return F.when(kind(node) == "BOOLEAN", _as(node, "boolean"))


def length_only(node: Column) -> Column:
    """Length of the text in code points (of the compact JSON for a structure), never the text."""
    return F.length(to_text(node)).cast("bigint")


def count_of(node: Column) -> Column:
    """Number of entries of a list or object, else the integer itself."""
    entries = F.coalesce(
        F.size(_as(node, "array<variant>")), F.size(_as(node, "map<string,variant>"))
    )
    return F.coalesce(entries.cast("bigint"), to_long(node))


def error_text(v: Column | str, type_path: str, error_path: str) -> Column:
    """Type of an error, or the error itself when it is plain text.

    An error object without a type is left null: written out whole it would carry the message.
    """
    error = json_node(v, error_path)
    return F.coalesce(json_get(v, type_path), F.when(kind(error) == "STRING", to_text(error)))


def usage_missing(v: Column | str, path: str = "usage_details") -> Column:
    """Usage details absent, not an object, or {}: the tokens are lost, which is not zero."""
    details = json_get(v, path, "map<string,variant>")
    return F.coalesce(F.size(details) == 0, F.lit(True)) | details.isNull()
