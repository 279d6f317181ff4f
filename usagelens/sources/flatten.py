"""From a JSON record to the typed columns of the request table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens import settings
from usagelens.contract import BLANK_AS_NULL, REQUEST_FIELDS, Field
from usagelens.functions import scalars, times
from usagelens.functions import variant as V

#: How a value comes out of its text. What the text alone does not tell is read beside it, see ``_read``.
_FROM_TEXT: dict[str, Callable[[Column], Column]] = {
    "int": V.text_to_long,
    "float": V.text_to_double,
    "length": lambda text: F.length(text).cast("bigint"),
    "time": times.parse_ts,
}


def _tree(v: str, paths: Sequence[str], as_type: str, name: str) -> tuple[list[Column], Callable[[str], Column]]:
    """Columns that hold the values of all paths, and the column of a path.

    A path that others go on from is a value and an object at once: it is read alone.
    """
    wanted = list(dict.fromkeys(paths))
    alone = [p for p in wanted if "[" in p or any(o.startswith(f"{p}.") for o in wanted)]
    together = [p for p in wanted if p not in alone]
    columns = [V.json_get(v, p, as_type).alias(f"{name}_{i}") for i, p in enumerate(alone)]
    field = None
    if together:
        tree, field = V.json_tree(v, together, as_type)
        columns.append(tree.alias(name))

    def at(path: str) -> Column:
        return F.col(f"{name}_{alone.index(path)}" if path in alone else f"{name}.{field(path)}")

    return columns, at


def _read(df: DataFrame, v: str, fields: Sequence[Field], keep: Sequence[str]) -> DataFrame:
    """Read every field that has a place in the record.

    The record is gone through once for the texts of all fields, not once for each field; lists and numbers behind
    booleans come from a pass each over their own fields. The text of a value that is there is never null, so the first
    text of several places is the text of the first value. Fields with the same reader are read as one array: written out
    per column, the generated code would outgrow what the JVM compiles.
    """
    groups: dict[str, list[Field]] = {}
    for f in fields:
        if f.sources:
            groups.setdefault(f.read, []).append(f)
    errors = {f.name: V.error_text(v, *f.sources) for f in groups.pop("error_text", [])}
    counts = groups.pop("count", [])

    def sources(*reads: str) -> list[str]:
        return [p for read in reads for f in groups.get(read, []) for p in f.sources]

    texts, text_at = _tree(v, sources(*groups), "string", "_texts")
    lists, list_at = _tree(v, sources("listed"), "array<string>", "_lists")
    numbers, number_at = _tree(v, sources("bool"), "bigint", "_numbers")

    def first(f: Field, of: Callable[[str], Column] = text_at) -> Column:
        return reduce(lambda rest, p: F.when(text_at(p).isNotNull(), of(p)).otherwise(rest), reversed(f.sources), F.lit(None))

    usage = V.usage_missing(v).alias("usage_missing")
    counted = F.transform(_nodes(v, counts), V.count_of).alias("_count") if counts else None
    carried = ["source_path", *keep, "usage_missing", *errors, *(["_count"] if counts else [])]
    rows = df.select(
        "source_path", *keep, usage, *[c.alias(n) for n, c in errors.items()], *([counted] if counts else []),
        F.col(v).alias("_v"), *texts, *lists, *numbers,
    )
    plain = {f.name: first(f) for f in groups.pop("text", [])}
    plain |= {f.name: first(f, lambda p: V.joined(list_at(p), text_at(p))) for f in groups.pop("listed", [])}
    plain |= {f.name: V.text_to_bool(first(f), first(f, number_at)) for f in groups.pop("bool", [])}
    arrays = [F.array(*[first(f) for f in group]).alias(f"_{read}_texts") for read, group in groups.items()]
    rows = rows.select(*carried, "_v", *[c.alias(n) for n, c in plain.items()], *arrays)
    read_all = [F.transform(f"_{read}_texts", _FROM_TEXT[read]).alias(f"_{read}") for read in groups]
    ints = groups.get("int", [])
    rows = rows.select(*carried, *plain, *(["_v", "_int_texts"] if ints else []), *read_all)
    if ints:
        # Decimals and whatever else has a text that is no integer: the values themselves tell what they are.
        n_texts, n_read = (F.size(F.filter(c, lambda x: x.isNotNull())) for c in ("_int_texts", "_int"))
        exact = F.when(n_texts == n_read, F.col("_int")).otherwise(F.transform(_nodes("_v", ints), V.to_long))
        rows = rows.select(*carried, *plain, *[exact.alias("_int") if r == "int" else f"_{r}" for r in groups])
    columns = [F.col(f"_{read}")[i].alias(f.name) for read, group in groups.items() for i, f in enumerate(group)]
    columns += [F.col("_count")[i].alias(f.name) for i, f in enumerate(counts)]
    return rows.select("source_path", *keep, "usage_missing", *errors, *plain, *columns)


def _nodes(v: str, fields: Sequence[Field]) -> Column:
    return F.array(*[V.json_first(v, *f.sources) for f in fields])


def flatten(
    df: DataFrame,
    ingested_at: Column,
    v: str = "v",
    fields: Sequence[Field] = REQUEST_FIELDS,
    tz: str = settings.TIMEZONE,
    version: str = settings.PIPELINE_VERSION,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per record in contract order and types; ``keep`` names columns to carry along.

    Blank ids become null before the client type is derived from the thread id.
    """
    base = _read(df, v, fields, keep)
    ids = [c for c in BLANK_AS_NULL if c in base.columns]
    base = base.withColumns({c: scalars.blank_to_null(F.col(c)) for c in ids})
    derived = {
        **times.local_calendar(F.col("ts_utc"), tz),
        "ts_created_local": times.wall_clock(F.col("ts_created_utc"), tz),
        "log_lag_ms": times.log_lag_ms(F.col("ts_utc"), F.col("ts_created_utc")),
        "source_file": scalars.basename(F.col("source_path")),
        "model_family": scalars.model_family(F.col("model_returned")),
        "client_type": scalars.client_type(F.col("thread_id")),
        "pipeline_version": F.lit(version),
        "ingested_at": ingested_at,
    }
    return to_typed(base.withColumns(derived), fields, keep)


def to_typed(
    df: DataFrame, fields: Sequence[Field] = REQUEST_FIELDS, keep: Sequence[str] = ()
) -> DataFrame:
    """Project to the declared columns, order and types; an all-null column keeps its type."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.spark_type).alias(f.name)
            for f in fields
        ],
        *keep,
    )
