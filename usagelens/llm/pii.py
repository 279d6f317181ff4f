"""Personal data: fixed patterns, and contexts that are learned from what they find."""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import ROW, Stored, numbered

KINDS = ("email", "ip", "card", "phone")
#: Rounds of learning at most; it ends before when nothing new is found.
ROUNDS = 6
#: A context is trusted if so much of what stands in it is of one kind, and so many different known ones do.
MIN_CONFIDENCE = 0.85
MIN_SEEDS = 5
#: What nothing is known of counts so much against a context.
UNKNOWN = 0.2
#: Of a mention: a string that may be an identifier, and one that has the form of one but fails its test.
_OPEN, _FAILED = -1, -2

# The patterns of the four kinds.
_EMAIL_NAME = re.compile(r"[A-Za-z0-9._%+-]")
_EMAIL_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_DIGIT = re.compile(r"[0-9]")
#: Groups of digits with single blanks between them, or a string without blanks.
_CANDIDATE = re.compile(r"[+(]?[0-9](?:[0-9()./-]*[0-9)])?(?: \(?[0-9](?:[0-9()./-]*[0-9)])?)+|[0-9A-Za-z+(][0-9A-Za-z@._%+()-]*[0-9A-Za-z]")
_WORD = re.compile(r"[^\W\d_]+")
#: What may stand between a label and its value.
_CUE = re.compile(r"[:=#][\x20\"']{0,3}\Z")
_RUN = re.compile(r"([0-9]+)|([A-Za-z]+)")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind as its place in KINDS), ascending; leftmost matches that do not overlap others of their kind."""
    found = []
    at, done = text.find("@"), 0
    while at >= 0:
        # The name is the whole run before the sign, as the pattern matches from the left.
        first = at
        while first > done and _EMAIL_NAME.match(text, first - 1):
            first -= 1
        host = _EMAIL_HOST.match(text, at + 1) if first < at else None
        if host:
            found.append((first, host.end(), 0))
            done = host.end()
        at = text.find("@", max(at + 1, done))
    if not _DIGIT.search(text):
        return sorted(found)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            found.append((m.start(), m.end(), 2))
    for m in _PHONE.finditer(text):
        if 10 <= sum(map(str.isdigit, m.group())) <= 15:
            found.append((m.start(), m.end(), 3))
    return sorted(found)


def _instance(value: str) -> str:
    """One name for the ways to write an identifier: its last ten digits if it has no letters, else lower case."""
    digits = "".join(_DIGIT.findall(value))
    if any(c.isalpha() or c == "@" for c in value):
        return value.lower()
    return f"{len(digits)}:{digits}" if len(digits) < 10 or len(digits) > 13 or "." in value else digits[-10:]


def _shape(value: str) -> str:
    if "@" in value:
        return "@"
    if any(c.isalpha() for c in value):
        return "mixed"
    return "dotted" if value.count(".") > 1 else "digits"


def _form(value: str) -> str:
    """The finer shape: runs of digits by their length, runs of letters, and the signs between them."""
    return "@" if "@" in value else _RUN.sub(lambda m: f"{len(m.group(1))}d" if m.group(1) else "a", value)


def contexts(text: str, start: int, end: int, words: list[tuple[int, int]]) -> list[str]:
    """Lexical patterns that an identifier stands in, from narrow to wide; ``words`` are all words of the text.

    Two words before it, one on each side, a label before it (with a sign such as a colon), each with its shape; then, for want
    of more, one word before or after it with its form. The ends of the text count as words.
    """
    value = text[start:end]
    shape, form = _shape(value), _form(value)
    i = bisect.bisect_right(words, (start, start))
    while i and words[i - 1][1] > start:
        i -= 1
    j = bisect.bisect_left(words, (end, end))
    b2, b1 = ((text[slice(*words[k])].lower() if k >= 0 else "^") for k in (i - 2, i - 1))
    after = text[slice(*words[j])].lower() if j < len(words) else "$"
    out = [f"{b2} {b1} <{shape}>", f"{b1} <{shape}> {after}", f"{b1} <{form}>", f"<{form}> {after}"]
    if _CUE.search(text, max(0, start - 5), start):
        out.append(f"{b1}: <{shape}>")
    return out


def _fails(value: str) -> bool:
    """Whether a string that is no base span has the form of an address or of a card number, and so is none."""
    return bool(_IP.fullmatch(value) or _CARD.fullmatch(value) and 14 <= len(_DIGIT.findall(value)) <= 19)


def mentions(text: str | None) -> list[tuple[int, int, int, str, list[str]]]:
    """(start, end, kind, instance, contexts) of what the base finds and of other strings that look like identifiers.

    Those have four digits or more, or an at sign, and do not overlap a base span; their kind is _OPEN or _FAILED.
    """
    text = text or ""
    out = base_spans(text)
    if "@" in text or _DIGIT.search(text):
        # Between the base spans; what touches one is part of it.
        at, gaps = 0, []
        for start, end, _ in out:
            if start > at:
                gaps.append((at, start))
            at = max(at, end)
        for lo, hi in [*gaps, (at, len(text))]:
            for m in _CANDIDATE.finditer(text, lo, hi):
                value, apart = m.group(), (m.start() > lo or not lo) and (m.end() < hi or hi == len(text))
                if apart and ("@" in value or len(_DIGIT.findall(value)) >= 4):
                    out.append((m.start(), m.end(), _FAILED if _fails(value) else _OPEN))
    words = [m.span() for m in _WORD.finditer(text)] if out else []
    return [(s, e, k, _instance(text[s:e]), contexts(text, s, e, words)) for s, e, k in sorted(out)]


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def _mention_rows(docs: DataFrame) -> DataFrame:
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"{ROW} bigint, doc_id {kind}, " + ", ".join(f"n_{k} bigint" for k in KINDS)
    schema += ", base_sha256 string, mentions array<struct<start:int,end:int,kind:int,instance:string,contexts:array<string>>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row, doc_id, text in zip(batch[ROW].tolist(), batch["doc_id"].astype(object).tolist(), batch["text"]):
                found = mentions(text)
                base = [m[:3] for m in found if m[2] >= 0]
                counts = [sum(m[2] == k for m in base) for k in range(len(KINDS))]
                out.append((row, doc_id, *counts, hashlib.sha256(_listed(base).encode()).hexdigest(), found))
            yield pd.DataFrame(out, columns=[ROW, "doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "mentions"])

    return numbered(docs, "doc_id", "text").mapInPandas(run, schema)


def trusted_contexts(mentioned: DataFrame, store: Stored, rounds: int = ROUNDS) -> DataFrame:
    """(context, kind, confidence, seeds) of the contexts that tell what stands in them.

    The graph links contexts with the different instances in them; what the base finds is known. In each round a context's
    confidence in a kind is the share of known instances of that kind among all it holds: those of other kinds, and those
    that fail a kind's test, count in full against it, unknown ones by UNKNOWN, and one more for good measure. Unknown instances in a trusted context are known from
    the next round on, and so bring trust to further contexts, until a round finds nothing new. Shares are aggregates over links: a
    context that a third of all mentions share is summed up before it moves.
    """
    links = mentioned.select("instance", "kind", F.explode("contexts").alias("context"))
    links = store.keep(links.groupBy("context", "instance").agg(F.max("kind").alias("kind")), "links")
    sizes = store.keep(links.groupBy("context").agg(F.count("*").alias("instances")), "sizes")
    known = mentioned.filter(F.col("kind") != _OPEN).groupBy("instance").agg(F.max("kind").alias("kind"))
    known, n_known = store.keep(known, "known"), -1
    trusted = None
    for _ in range(rounds):
        met = links.select("context", "instance").join(known, "instance")
        seeds = met.groupBy("context", "kind").agg(F.count("*").alias("seeds"))
        seeds = store.keep(seeds, "seeds")
        all_known = seeds.groupBy("context").agg(F.sum("seeds").alias("all_known"))
        rated = seeds.filter((F.col("kind") >= 0) & (F.col("seeds") >= MIN_SEEDS)).join(all_known, "context").join(sizes, "context")
        against = (F.col("all_known") - F.col("seeds")) + UNKNOWN * (F.col("instances") - F.col("all_known")) + 1
        rated = rated.withColumn("confidence", F.col("seeds") / (F.col("seeds") + against))
        trusted = store.keep(rated.filter(F.col("confidence") >= MIN_CONFIDENCE).select("context", "kind", "confidence", "seeds"), "trusted")
        told = links.select("context", "instance").join(trusted, "context").join(known.select("instance"), "instance", "left_anti")
        best = told.groupBy("instance").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "kind"))["kind"].alias("kind"))
        known = store.keep(known.union(best), "known")
        n_before, n_known = n_known, known.count()
        if n_known == n_before:
            break
    return trusted


def personal_data(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ..): personal data by fixed patterns, and more by learned contexts.

    Bootstrapped extraction: what the fixed patterns find seeds a graph of contexts and instances, which Spark scores in
    rounds (``trusted_contexts``); strings like identifiers that stand in a context of high confidence are taken for that
    context's kind, and are seeds themselves from then on. Contexts of equal confidence yield the kind that is listed first.
    Candidates are strings with an at sign or four digits, with single blanks between groups of digits; others are never
    found. Where contexts tell nothing, as in text whose words follow no pattern, nothing is learned. Base
    spans always stay; learned ones never overlap them. All texts are read whole, once.

    Null text is empty and has no spans. Rows that repeat a doc_id are rows of their own; copies of a text count once as
    evidence, since contexts count different instances. An empty table gives no rows. Other columns are not read.

    Returns _row, doc_id, n_email, n_ip, n_card, n_phone (by fixed patterns), base_sha256, spans
    (kind:start:end of all, by start, then kind), found array<struct<start,end,kind,learned>>.
    """
    store = Stored(docs.sparkSession)
    rows = store.keep(_mention_rows(docs), "mentions")
    mentioned = rows.select(ROW, F.explode("mentions").alias("m")).select(ROW, "m.*")
    trusted = trusted_contexts(mentioned, store, rounds)
    unknown = mentioned.filter(F.col("kind") == _OPEN).select(ROW, "start", "end", F.explode("contexts").alias("context"))
    rated = unknown.join(trusted.select("context", F.col("kind").alias("as_kind"), "confidence"), "context")
    best = rated.groupBy(ROW, "start", "end").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "as_kind"))["as_kind"].alias("kind"))
    learned = best.groupBy(ROW).agg(F.collect_list(F.struct("start", "end", "kind", F.lit(True).alias("learned"))).alias("more"))
    base = F.transform(
        F.filter("mentions", lambda m: m["kind"] >= 0),
        lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["kind"].alias("kind"), F.lit(False).alias("learned")),
    )
    all_ = rows.join(learned, ROW, "left").withColumn("all", F.when(F.col("more").isNull(), base).otherwise(F.concat(base, "more")))
    order = F.sort_array(F.transform("all", lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end"), m["learned"].alias("learned"))))
    names = F.array(*map(F.lit, KINDS))
    listed = F.transform("found", lambda m: F.concat_ws(":", F.element_at(names, m["kind"] + 1), m["start"], m["end"]))
    return all_.withColumn("found", order).select(
        ROW, "doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", F.array_join(listed, ",").alias("spans"), "found"
    )
