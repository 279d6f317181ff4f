"""Secrets: fixed patterns, and parts of credentials that count only where complementary parts stand beside them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import ROW, Stored

KINDS = ("assign", "access", "hex")
#: Kinds of the spans that linking adds.
LINKED = ("secret", "identifier", "endpoint")
#: Code points on each side of a secret that its scope reaches, within the paragraph.
REACH = 300
#: A scope is joined with parts by the cells of so many code points that it covers.
_CELL = 512

# The patterns of the three kinds.
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_ASSIGN_LEAST = 6

_KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
#: A loose secret: no word boundary inside, and digits, small and capital letters together (checked apart).
_LOOSE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
_LABELLED = re.compile(
    r"(?<![A-Za-z0-9])(?:user(?:name)?|login|account|client_?id|key_?id|access_?key(?:_?id)?)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._@+-]{3,}",
    re.IGNORECASE | re.ASCII,
)
_MAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_SHORT_ACCESS = re.compile(r"(?<![A-Z0-9])A[KS]IA[A-Z0-9]{6,}")
_URL = re.compile(r"[a-z][a-z0-9+.-]{1,20}://[^\x00-\x20\"'<>]+")
_ADDRESS = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])(?::[0-9]{1,5})?")
_HOST_PORT = re.compile(r"(?<![A-Za-z0-9.-])[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}:[0-9]{2,5}(?![0-9])")
#: Patterns of weak parts, the more telling ones first: role as its place in LINKED, and a string that every match of some holds.
_WEAK = (
    (2, _URL, "://"), (2, _ADDRESS, "."), (2, _HOST_PORT, ":"), (1, _LABELLED, ""), (1, _MAIL, "@"), (1, _SHORT_ACCESS, "IA"), (0, _LOOSE, ""),
)
_BLANK_LINE = re.compile(r"\n[\x20\t\r]*\n")

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind as its place in KINDS), ascending; leftmost matches that do not overlap others of their kind."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= _ASSIGN_LEAST]
    found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


def _apart(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of ``spans`` that overlap none of ``taken``; both ascending, and none of either overlaps another of its own."""
    out, i = [], 0
    for start, end in spans:
        while i < len(taken) and taken[i][1] <= start:
            i += 1
        if i == len(taken) or taken[i][0] >= end:
            out.append((start, end))
    return out


def _is_loose(value: str) -> bool:
    return any(c.isdigit() for c in value) and any(c.islower() for c in value) and (any(c.isupper() for c in value) or len(value) >= 20)


def parts(text: str, base: list[Span]) -> list[tuple[int, int, int, bool, int, int]]:
    """(start, end, role as its place in LINKED, strong, scope from, scope to) of all that may be part of a credential.

    Base spans are strong: access keys identify, the others are secrets. Weak parts overlap no base span and no other part.
    Only secrets have a scope: REACH on both sides, up to the next blank line.
    """
    taken: list[tuple[int, int]] = []
    for s, e, _ in base:
        if taken and s < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
        else:
            taken.append((s, e))
    weak: list[Span] = []
    for role, pattern, holds in _WEAK:
        if not base and any(r not in {w[2] for w in weak} for r in range(role + 1, len(LINKED))):
            return []  # without a strong part all roles must be there
        if holds in text:
            spans = [m.span() for m in pattern.finditer(text) if role or _is_loose(m.group())]
            spans = _apart(spans, taken)
            weak += [(s, e, role) for s, e in spans]
            taken = sorted(taken + spans)
    if not base and {role for _, _, role in weak} != {0, 1, 2}:
        return []
    found = [(s, e, 1 if k == 1 else 0, True) for s, e, k in base] + [(s, e, role, False) for s, e, role in weak]
    if not any(role == 0 for _, _, role, _ in found) or len({role for _, _, role, _ in found}) < 2:
        return []
    breaks = [(m.start(), m.end()) for m in _BLANK_LINE.finditer(text)]
    out, at = [], 0
    for s, e, role, strong in sorted(found):
        if role:
            out.append((s, e, role, strong, -1, -1))
            continue
        while at < len(breaks) and breaks[at][1] <= s:
            at += 1
        lo = max(s - REACH, breaks[at - 1][1] if at else 0, 0)
        hi = min(e + REACH, next((b for b, _ in breaks[at : at + 1] if b >= e), len(text)))
        out.append((s, e, role, strong, lo, hi))
    return out


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


_SPAN = "struct<start:int,end:int,kind:int,linked:boolean>"
_PART = "struct<start:int,end:int,role:int,strong:boolean,low:int,high:int>"


def _scanned(docs: DataFrame) -> DataFrame:
    """_row, doc_id, counts and digest of the base, its spans, and the parts of credentials."""
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"{ROW} bigint, doc_id {kind}, " + ", ".join(f"n_{k} bigint" for k in KINDS)
    schema += f", base_sha256 string, base array<{_SPAN}>, parts array<{_PART}>"
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("linked", pa.bool_())]))
    part = pa.list_(
        pa.struct([("start", pa.int32()), ("end", pa.int32()), ("role", pa.int32()), ("strong", pa.bool_()), ("low", pa.int32()), ("high", pa.int32())])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            counts, digests, bases, found = [], [], [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                base = base_spans(text)
                counts.append([sum(s[2] == k for s in base) for k in range(len(KINDS))])
                digests.append(hashlib.sha256(_listed(base).encode()).hexdigest())
                bases.append([{"start": s, "end": e, "kind": k, "linked": False} for s, e, k in base])
                found.append([dict(zip(("start", "end", "role", "strong", "low", "high"), p)) for p in parts(text, base)])
            n = batch.num_rows
            columns = [pa.array(range(row, row + n), pa.int64()), batch.column("doc_id")]
            columns += [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(KINDS))]
            columns += [pa.array(digests, pa.string()), pa.array(bases, span), pa.array(found, part)]
            yield pa.RecordBatch.from_arrays(columns, [ROW, "doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "base", "parts"])
            row += n

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def linked_parts(found: DataFrame) -> DataFrame:
    """Weak parts to be reported (_row, start, end, role), given all parts (_row, start, end, role, strong, low, high).

    An interval join: the scope of each secret meets the identifiers and endpoints that lie in it, through the cells that the
    scope covers. A weak part is reported if in one scope it stands with a strong part of another role, or if all three roles
    are there. A scope holds at most some hundred parts, as parts do not overlap, so the join grows with the texts.
    """
    secrets = found.filter("role = 0").select(
        ROW, F.col("start").alias("at"), F.col("end").alias("until"), F.col("strong").alias("strong_secret"), "low", "high",
        F.explode(F.sequence(F.expr(f"low div {_CELL}"), F.expr(f"high div {_CELL}"))).alias("cell"),
    )
    others = found.filter("role > 0").select(ROW, "start", "end", "role", "strong", F.expr(f"start div {_CELL}").alias("cell"))
    met = secrets.join(others, [ROW, "cell"]).filter("start >= low and end <= high")
    of_scope = met.groupBy(ROW, "at", "until", "strong_secret").agg(
        F.max(F.col("role") == 1).alias("identified"), F.max(F.col("role") == 2).alias("located"), F.max("strong").alias("strong_other"),
        F.collect_list(F.struct("start", "end", "role", "strong")).alias("others"),
    )
    whole = F.col("identified") & F.col("located")
    secret = of_scope.filter(~F.col("strong_secret") & (whole | F.col("strong_other")))
    beside = of_scope.filter(F.col("strong_secret") | whole).select(ROW, F.explode("others").alias("o")).filter("not o.strong")
    return (
        secret.select(ROW, F.col("at").alias("start"), F.col("until").alias("end"), F.lit(0).alias("role"))
        .union(beside.select(ROW, "o.start", "o.end", "o.role"))
        .distinct()
    )


def secrets(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ..): secrets by fixed patterns, and weak parts of credentials by linking.

    Weak parts are loose secrets (16 characters or more of mixed kinds), identifiers (labelled names, mail addresses, short
    access keys) and endpoints (URLs, addresses, hosts with a port). Alone they say nothing, so each is reported only where
    complementary parts co-occur in the scope of one secret: a strong one of another role, or all three roles. Base spans
    always stay; added ones never overlap them. All texts are read whole, once; rows without any part leave before the join.

    Null text is empty and has no spans. Rows that repeat a doc_id, copies of a text and null ids are rows of their own. An
    empty table gives no rows. Parts that begin at the same place are listed by kind. Other columns are not read.

    Returns _row (its own numbering), doc_id, n_assign, n_access, n_hex (by fixed patterns), base_sha256, spans
    (kind:start:end of all, by start, then kind), found array<struct<start,end,kind,linked>>, where kind counts on from KINDS
    into LINKED.
    """
    store = Stored(docs.sparkSession)
    rows = store.keep(_scanned(docs), "secrets")
    found = rows.filter("size(parts) > 1").select(ROW, F.explode("parts").alias("p")).select(ROW, "p.*")
    added = linked_parts(found).withColumn("kind", F.col("role") + len(KINDS))
    added = added.groupBy(ROW).agg(F.collect_list(F.struct("start", "end", "kind", F.lit(True).alias("linked"))).alias("more"))
    both = rows.drop("parts").join(added, ROW, "left").withColumn("all", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", "more")))
    order = F.sort_array(F.transform("all", lambda m: F.struct(*(m[c].alias(c) for c in ("start", "kind", "end", "linked")))))
    names = F.array(*map(F.lit, KINDS + LINKED))
    listed = F.transform("found", lambda m: F.concat_ws(":", F.element_at(names, m["kind"] + 1), m["start"], m["end"]))
    return both.withColumn("found", order).select(
        ROW, "doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", F.array_join(listed, ",").alias("spans"), "found"
    )
