"""Quality rules with thresholds that adapt to each language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagelens.llm.common import ROW, SPACE, WORD, Stored, numbered

#: Words of a window, and of the base rule: fewer words fail, and so does a larger part of repeated words.
WINDOW_WORDS = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
#: A sketch counts values in buckets whose bounds grow by 2 ** (1 / 16): quantiles are within 4.5 % of the true value.
BUCKETS_PER_DOUBLING = 16
#: Fences lie so many spreads beyond the quartiles; a signal that hardly varies has at least the spread given here.
FENCE = 3.0
LEAST_SPREAD = {"symbols": 0.1, "upper": 0.05, "marks": 0.1, "dup_lines": 0.1, "repeated": 0.1, "word_length": 1.0}
#: Signals with a fence below, too.
TWO_SIDED = ("word_length",)
#: A (language, source) with fewer documents takes the thresholds of its language, and that those of all documents.
MIN_DOCS = 100


def _windows(words: Column) -> Column:
    """A hash of each window of consecutive words."""
    starts = F.sequence(F.lit(1), F.size(words) - WINDOW_WORDS + 1)
    grams = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WINDOW_WORDS)))
    return F.when(F.size(words) >= WINDOW_WORDS, grams)


def base_counts(docs: DataFrame, *columns: str) -> DataFrame:
    """One row per row of ``docs`` with the counts that rules build on; null text has none.

    n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words, n_upper (A-Z and other capitals),
    n_marks (code points in words that are neither letter nor digit). Repeated windows are found within the row by sorting
    their 64-bit hashes, so that nothing is shuffled.
    """
    rows = numbered(docs, "doc_id", *columns, F.coalesce("text", F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    rows = rows.select(
        ROW, "doc_id", *columns, "text", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"), lines.alias("lines")
    )
    solid = F.regexp_replace("text", SPACE, "")
    rows = rows.select(
        ROW, "doc_id", *columns, "words",
        F.length(solid).alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).alias("n_symbols"),
        F.length(F.regexp_replace("text", r"[^\p{Lu}]+", "")).alias("n_upper"),
        F.length(F.regexp_replace(solid, r"[\p{L}\p{M}\p{N}]+", "")).alias("n_marks"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        _windows(F.col("words")).alias("grams"),
    )
    counted = [ROW, "doc_id", *columns, F.size("words").alias("n_words"), "word_chars", "n_symbols", "n_upper", "n_marks", "n_lines", "n_dup_lines"]
    at = F.sort_array(F.transform("grams", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    rows = rows.select(*counted, F.when(F.size("grams") > F.size(F.array_distinct("grams")), at).alias("at"))

    def again(p: Column, k: Column) -> Column:
        before, after = F.get("at", k - 1)["x"], F.get("at", k + 1)["x"]
        return F.coalesce(p["x"] == before, F.lit(False)) | F.coalesce(p["x"] == after, F.lit(False))

    names = [c if isinstance(c, str) else "n_words" for c in counted]
    rows = rows.select(*names, F.sort_array(F.transform(F.filter("at", again), lambda p: p["i"])).alias("starts"))
    start = F.struct(F.lit(0).alias("total"), F.lit(-WINDOW_WORDS).alias("last"))
    covered = F.aggregate(
        "starts",
        start,
        lambda s, x: F.struct((s["total"] + F.least(F.lit(WINDOW_WORDS), x - s["last"])).alias("total"), x.alias("last")),
        lambda s: s["total"],
    )
    counts = [c for c in names if c.startswith("n_") or c == "word_chars"]
    return rows.select(
        ROW, "doc_id", *columns, *(F.col(c).cast("long").alias(c) for c in counts), F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words")
    )


def _signals() -> dict[str, Column]:
    words = F.col("n_words")
    return {
        "symbols": F.col("n_symbols") / words,
        "upper": F.col("n_upper") / F.col("word_chars"),
        "marks": F.col("n_marks") / words,
        "dup_lines": F.col("n_dup_lines") / F.col("n_lines"),
        "repeated": F.col("n_repeat_words") / words,
        "word_length": F.col("word_chars") / words,
    }


def sketches(values: DataFrame, keys: list[str], signals: list[str]) -> DataFrame:
    """Quantile sketches as rows (keys, signal, bucket, n): merging sketches is adding up ``n``.

    Bucket k holds values in (2 ** ((k - 1) / 16), 2 ** (k / 16)]; bucket null holds zero.
    """
    long = values.select(*keys, F.explode(F.array(*(F.struct(F.lit(s).alias("signal"), F.col(s).alias("value")) for s in signals))).alias("s"))
    bucket = F.when(F.col("s.value") > 0, F.ceil(F.round(F.log2("s.value") * BUCKETS_PER_DOUBLING, 6))).cast("int")
    return long.groupBy(*keys, F.col("s.signal").alias("signal"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches of coarser groups."""
    return sketch.groupBy(*keys, "signal", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, signal, docs, q25, q75): the upper bounds of the buckets that hold the quartiles."""
    group = Window.partitionBy(*keys, "signal")
    upto = group.orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = sketch.withColumn("docs", F.sum("n").over(group)).withColumn("upto", F.sum("n").over(upto))
    value = F.coalesce(F.pow(F.lit(2.0), F.col("bucket") / F.lit(float(BUCKETS_PER_DOUBLING))), F.lit(0.0))
    return ranked.groupBy(*keys, "signal").agg(
        F.max("docs").alias("docs"),
        *(F.min(F.when(F.col("upto") * 4 >= F.col("docs") * k, value)).alias(f"q{25 * k}") for k in (1, 3)),
    )


def thresholds(sketch: DataFrame) -> DataFrame:
    """(lang, source, signal, low, high, docs): fences of each (language, source) that occurs; coarser ones where it is small."""
    fine = quartiles(sketch, ["lang", "source"])
    lang = quartiles(merged(sketch, ["lang"]), ["lang"])
    all_ = quartiles(merged(sketch, []), [])
    names = {"docs": "docs", "q25": "q25", "q75": "q75"}
    lang = lang.select(F.col("lang").alias("l"), F.col("signal").alias("l_signal"), *(F.col(c).alias(f"l_{c}") for c in names))
    all_ = all_.select(F.col("signal").alias("a_signal"), *(F.col(c).alias(f"a_{c}") for c in names))
    rows = fine.join(lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("signal") == F.col("l_signal"))).join(
        all_, F.col("signal") == F.col("a_signal")
    )

    def chosen(c: str) -> Column:
        return F.when(F.col("docs") >= MIN_DOCS, F.col(c)).when(F.col("l_docs") >= MIN_DOCS, F.col(f"l_{c}")).otherwise(F.col(f"a_{c}"))

    least = F.element_at(F.create_map(*(F.lit(x) for kv in LEAST_SPREAD.items() for x in kv)), F.col("signal"))
    spread = F.greatest(F.col("hi") - F.col("lo"), least) * FENCE
    return rows.select("lang", "source", "signal", "docs", chosen("q25").alias("lo"), chosen("q75").alias("hi")).select(
        "lang", "source", "signal", "docs",
        F.when(F.col("signal").isin(*TWO_SIDED), F.col("lo") - spread).alias("low"),
        (F.col("hi") + spread).alias("high"),
    )


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang, source, ..): counts, whether the base rule fails, and the verdict.

    Signals of documents that pass the base rule (symbols, capitals and marks for each word, share of repeated lines and
    words, word length) go into mergeable quantile sketches, one for each language, source and signal: counts by
    logarithmic bucket, which add up whatever the order, so that reruns agree. Sketches of small sources merge into their
    language's, and those into one of all documents. Fences three spreads (quartile to quartile) beyond the quartiles
    replace fixed cutoffs; documents are joined with the fences of their language and source, and dropped beyond one.

    Null text has no words and fails the base rule, as does empty text. Null lang and null source are groups like any
    other. Rows that repeat a doc_id are rows of their own. An empty table gives no rows. Other columns are not read.

    Returns _row, doc_id, lang, source, the counts, base_failed, kept, failed (names of the signals beyond a fence).
    """
    store = Stored(docs.sparkSession)
    counts = store.keep(base_counts(docs, "lang", "source"), "counts")
    words = F.col("n_words")
    failed = (words < MIN_WORDS) | (F.col("n_repeat_words") * 100 > words * MAX_REPEATED_PERCENT)
    judged = counts.withColumn("base_failed", failed)
    signals = _signals()
    passed = judged.filter("not base_failed").withColumns(signals)
    fences = thresholds(store.keep(sketches(passed, ["lang", "source"], list(signals)), "sketch"))
    wide = fences.groupBy("lang", "source").agg(
        *(F.max(F.when(F.col("signal") == s, F.col(side))).alias(f"{side}_{s}") for s in signals for side in ("low", "high"))
    )
    wide = wide.withColumnsRenamed({"lang": "of_lang", "source": "of_source"})
    joined = judged.join(wide, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left")
    beyond = [F.when((v > F.col(f"high_{s}")) | F.coalesce(v < F.col(f"low_{s}"), F.lit(False)), F.lit(s)) for s, v in signals.items()]
    out = joined.withColumn("failed", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*beyond))))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)).select(
        ROW, "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_upper", "n_marks", "n_lines", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "failed",
    )
