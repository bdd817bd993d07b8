"""Quality rules with thresholds that adapt to language and source, from mergeable quantile sketches."""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import Workspace, arrow_rows, fresh, load

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
#: Relative accuracy of the sketches: bucket b holds values up to GAMMA ** b; bucket ZERO those that are 0.
GAMMA = 1.005
ZERO = -10_000
#: For each rule the upper quantile (in thousandths) that its spread is read from, and how many spreads beyond the median the fence
#: lies. Repetition has long tails in good texts, so its spread is read further out than that of what most texts lack.
RULES = {"symbols": (900, 6.0), "dup_lines": (990, 4.0), "repeats": (990, 4.0), "echoes": (900, 6.0), "long_words": (900, 6.0), "short_words": (900, 6.0)}
#: Rules that count events: what is counted, in what, the scale of the rate, and what one event counts at most (a window found again is twice its words).
COUNTED = {"symbols": ("n_symbols", "word_chars", 1000.0, 1.0), "dup_lines": ("n_dup_lines", "n_words", 5000.0, 1.0), "repeats": ("n_repeat_words", "n_words", 1000.0, 2.0 * WINDOW), "echoes": ("n_echoes", "n_words", 1000.0, 1.0)}
#: The least spread of word lengths, as a share of the median.
LEAST_SPREAD = 0.02
#: A group's sketch is mixed with that of its language as if it had so many rows of it, and a language's with the whole corpus's.
SHRINK = 100
#: A group's fence is at most so many times its language's, so that a group full of junk does not excuse itself.
LOOSEST = 4.0
_UNIT = 1_000_000
#: What is measured of each text. n_echoes: words equal to the word before.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_echoes")


def _repeat_words(words: list[bytes], code: dict[bytes, int]) -> int:
    """Words inside windows of WINDOW words that the text has twice or more.

    Windows are compared by numbering pairs, then pairs of pairs: exact, and a sort of integers each time."""
    n = len(words)
    if n <= WINDOW or len(code) == n:
        return 0
    ids = np.fromiter(map(code.__getitem__, words), np.int64, n)
    step = 1
    while step < WINDOW:
        both = (ids[:-step] << 32) | ids[step:]
        order = np.argsort(both, kind="stable")
        ranked = both[order]
        new = np.empty(len(ranked), bool)
        new[0] = True
        np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
        if new.all():
            return 0
        ids = np.empty(len(ranked), np.int64)
        ids[order] = np.cumsum(new) - 1
        step *= 2
    many = np.bincount(ids)[ids] > 1
    if not many.any():
        return 0
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.flatnonzero(many), 1)
    np.add.at(edge, np.flatnonzero(many) + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


_TO_COUNT = bytes(range(256)).translate(None, SYMBOLS)
_SPACES = b" \t\n\x0b\x0c\r"
_NOT_START = bytes(range(0x80, 0xC0))


def measure(text: bytes) -> tuple[int, ...]:
    """MEASURES of a text in UTF-8."""
    words = text.split()
    chars = len(text.translate(None, _SPACES + _NOT_START))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()] if b"\n" in text else []
    repeats = _repeat_words(words, {w: i for i, w in enumerate(dict.fromkeys(words))})
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeats, sum(map(eq, words, words[1:]))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measure(t.as_buffer().to_pybytes()) for t in batch.column("text")]
        counts = np.array(rows, np.int64).reshape(-1, len(MEASURES))
        kept = [c for c in batch.schema.names if c != "text"]
        columns = [batch.column(c) for c in kept] + [pa.array(counts[:, i]) for i in range(len(MEASURES))]
        yield pa.RecordBatch.from_arrays(columns, [*kept, *MEASURES])


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def _values() -> dict[str, Column]:
    """The rules' values: rates of what is counted, lengths of words, and the sizes that the counts are held against."""
    size = lambda c: F.greatest(F.col(c), F.lit(1)).cast("double")
    mean = F.col("word_chars") * 1000.0 / size("n_words")
    rates = {name: F.col(count) * scale / size(of) for name, (count, of, scale, _) in COUNTED.items()}
    return rates | {"long_words": mean, "short_words": F.lit(1_000_000.0) / F.greatest(mean, F.lit(1.0)), "n_words": size("n_words"), "word_chars": size("word_chars")}


def _bucket(value: Column) -> Column:
    return F.when(value <= 0, F.lit(ZERO)).otherwise(F.ceil(F.log(value) / F.lit(math.log(GAMMA)))).cast("int")


def _shares(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bucket, share) of a sketch (keys, bucket, n): parts of _UNIT, rounded so that they add up to it."""
    run = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.floor(F.sum("n").over(run).cast("double") * _UNIT / F.sum("n").over(Window.partitionBy(*keys)).cast("double")).cast("long")
    cut = cells.select(*keys, "bucket", upto.alias("upto"))
    return cut.select(*keys, "bucket", (F.col("upto") - F.coalesce(F.lag("upto").over(Window.partitionBy(*keys).orderBy("bucket")), F.lit(0))).alias("share"))


def _shrunk(cells: DataFrame, keys: list[str], parent: DataFrame, parent_keys: list[str]) -> DataFrame:
    """The sketches (keys, bucket, n), in parts of _UNIT, with SHRINK rows of the parent's sketch added to each."""
    named = parent.select(*[F.col(k).alias(f"p_{k}") for k in parent_keys], "bucket", (F.col("share") * SHRINK).alias("n"))
    on = [F.col(k).eqNullSafe(F.col(f"p_{k}")) for k in parent_keys]
    more = cells.select(*keys).distinct().join(named, on).select(*keys, "bucket", "n")
    return cells.select(*keys, "bucket", (F.col("n") * _UNIT).alias("n")).unionByName(more).groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))


def _quantiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, mid, high, zeros): the median, the rule's upper quantile, and the share of rows whose value is 0."""
    run = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n").over(Window.partitionBy(*keys)).cast("double")
    ranked = sketches.select(*keys, "bucket", "n", F.sum("n").over(run).cast("double").alias("upto"), total.alias("total"))
    quantile = F.coalesce(F.create_map(*[x for k, v in RULES.items() for x in (F.lit(k), F.lit(v[0]))])[F.col("name")], F.lit(500))
    at = lambda q: F.min(F.when(F.col("upto") * 1000 >= F.col("total") * q, F.col("bucket")))
    value = lambda b: F.when(F.col(b) == ZERO, 0.0).otherwise(F.pow(F.lit(GAMMA), F.col(b)))
    zeros = F.coalesce(F.sum(F.when(F.col("bucket") == ZERO, F.col("n"))), F.lit(0)).cast("double") / F.max("total")
    found = ranked.groupBy(*keys).agg(at(F.lit(500)).alias("mid"), at(quantile).alias("high"), zeros.alias("zeros"))
    return found.select(*keys, F.struct(value("mid").alias("mid"), value("high").alias("high"), "zeros").alias("found"))


def _fence(name: str, found: Column) -> Column:
    """The median plus so many spreads, from the median to the upper quantile."""
    mid, spread = found["mid"], found["high"] - found["mid"]
    if name not in COUNTED:
        spread = F.greatest(spread, mid * LEAST_SPREAD)
    return mid + F.lit(RULES[name][1]) * spread


def _rate(name: str, group: Column) -> Column:
    """Events in a unit of size, where most texts of the group have none: the rate at which as many have none by chance."""
    zeros = group[name]["zeros"]
    return F.when(group[name]["mid"] == 0, -F.log(zeros) / group[COUNTED[name][1]]["mid"]).otherwise(0.0)


def thresholds(features: DataFrame, ws: Workspace) -> DataFrame:
    """(lang, source, fences) for every language and source that comes; fences maps each rule to its threshold, and what is counted also to
    its rate by chance (0 where most texts of the group have some: then quantiles tell).

    The sketch of a group is its counts per logarithmic bucket: sketches merge by adding counts, so one
    aggregation with partial sums makes them, in any order and with the same result. Sketches of languages and of
    the corpus are sums of theirs. A small group leans on its language, by weight and not by a limit: SHRINK rows
    of the language's sketch are added to every group's, and SHRINK rows of the corpus's to every language's."""
    pairs = F.array(*[F.struct(F.lit(k).alias("name"), _bucket(v).alias("bucket")) for k, v in _values().items()])
    usable = features.where(~base_failed()).select("lang", "source", F.inline(pairs))
    own, lang = ["lang", "source", "name"], ["lang", "name"]
    cells = ws.stage(usable.groupBy(*own, "bucket").agg(F.count("*").alias("n")), "cells")
    whole = _shares(cells.groupBy("name", "bucket").agg(F.sum("n").alias("n")), ["name"])
    by_lang = ws.stage(_shrunk(cells.groupBy(*lang, "bucket").agg(F.sum("n").alias("n")), lang, whole, ["name"]), "languages")
    as_map = lambda found, keys: found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("name", "found"))).alias("found"))
    limits = as_map(_quantiles(by_lang, lang), ["lang"]).select(F.col("lang").alias("l_lang"), F.col("found").alias("l_found"))
    groups = as_map(_quantiles(_shrunk(cells, own, _shares(by_lang, lang), lang), own), ["lang", "source"])
    joined = groups.join(limits, F.col("lang").eqNullSafe(F.col("l_lang")))
    least = lambda f: F.least(f(F.col("found")), f(F.col("l_found")) * LOOSEST)
    fences = [F.struct(F.lit(name).alias("name"), least(lambda g, name=name: _fence(name, g[name])).alias("fence")) for name in RULES]
    rates = [F.struct(F.lit(f"{name} by chance").alias("name"), least(lambda g, name=name: _rate(name, g)).alias("fence")) for name in COUNTED]
    return ws.stage(joined.select("lang", "source", F.map_from_entries(F.array(*fences, *rates)).alias("fences")), "fences")


def judge(features: DataFrame, fences: DataFrame) -> DataFrame:
    """features with base_failed and kept; groups all of whose rows failed have no thresholds and nothing to keep.

    A count is within its fence times the text's size, and within what the group's rate gives by chance in a text of that size: one event
    more than the mean, and so many standard deviations. So a single event is never too many."""
    t = fences.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), "fences")
    joined = features.join(t, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    within = F.lit(True)
    for name, value in _values().items():
        if name in COUNTED:
            count, of, scale, event = COUNTED[name]
            mean = F.col("fences")[f"{name} by chance"] * F.col(of)
            chance = F.lit(event) * (F.lit(1.0) + mean + F.lit(RULES[name][1]) * F.sqrt(mean))
            within &= F.col(count) <= F.greatest(F.col("fences")[name] * F.col(of) / scale, chance)
        elif name in RULES:
            within &= value <= F.col("fences")[name]
    failed = base_failed()
    return joined.withColumn("base_failed", failed).withColumn("kept", F.coalesce(~failed & within, F.lit(False))).drop("t_lang", "t_source", "fences")


def _with_measures(raw: DataFrame) -> T.StructType:
    """The schema of raw without its text, with the measures."""
    return T.StructType([f for f in raw.schema if f.name != "text"] + [T.StructField(m, T.LongType()) for m in MEASURES])


def _features(docs: DataFrame, ws: Workspace) -> DataFrame:
    raw = docs.select("doc_id", "lang", "source", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return ws.stage(raw.mapInArrow(_measure, _with_measures(raw)), "features", batch_rows=500)


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """One row per document with its measures, base_failed and kept; needs doc_id, text, lang and source.

    A null or empty text has no words and fails; a very long text is measured whole, by one task. Null languages and
    sources are groups of their own. Rows that repeat are judged alike; other columns are not read. No documents
    give no rows. A value equal to its fence is within it."""
    ws = Workspace(docs.sparkSession, "quality")
    features = _features(docs, ws)
    return judge(features, thresholds(features, ws))


def quality_filter(docs: DataFrame) -> DataFrame:
    """The documents that quality_verdicts keeps, with all their columns, whatever their names.

    Each text is measured once, next to its row, so rows need no identifier."""
    ws = Workspace(docs.sparkSession, "quality")
    carried = fresh(docs, "carried")
    row = F.struct(*[F.col(c) for c in docs.columns])
    raw = docs.select(row.alias(carried), "lang", "source", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    features = ws.stage(raw.mapInArrow(_measure, _with_measures(raw)), "features", batch_rows=500)
    return judge(features, thresholds(features, ws)).where("kept").select(*[F.col(carried)[c].alias(c) for c in docs.columns])


def op5_quality_rules(spark, sf_dir):
    """Measures and verdict of every document."""
    return quality_verdicts(load(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _oracle() -> str:
    values = {name: f"{count} * {scale}::DOUBLE / greatest({of}, 1)" for name, (count, of, scale, _) in COUNTED.items()} | {
        "long_words": "word_chars * 1000.0::DOUBLE / greatest(n_words, 1)",
        "short_words": "1000000.0::DOUBLE / greatest(word_chars * 1000.0::DOUBLE / greatest(n_words, 1), 1.0::DOUBLE)",
        "n_words": "greatest(n_words, 1)::DOUBLE", "word_chars": "greatest(word_chars, 1)::DOUBLE",
    }
    own, lang = "lang, source, name", "lang, name"
    shares = lambda cells, keys: f"""SELECT {keys}, bucket, upto - coalesce(lag(upto) OVER (PARTITION BY {keys} ORDER BY bucket), 0) AS share FROM (
  SELECT {keys}, bucket, floor((sum(n) OVER (PARTITION BY {keys} ORDER BY bucket))::DOUBLE * {_UNIT} / (sum(n) OVER (PARTITION BY {keys}))::DOUBLE)::BIGINT AS upto FROM {cells})"""  # noqa: E731
    shrunk = lambda cells, keys, parent, parent_keys: f"""SELECT {keys}, bucket, sum(n)::BIGINT AS n FROM (
  SELECT {keys}, bucket, n * {_UNIT} AS n FROM {cells} UNION ALL
  SELECT {", ".join("k." + x for x in keys.split(", "))}, bucket, share * {SHRINK} FROM (SELECT DISTINCT {keys} FROM {cells}) k JOIN {parent} p
    ON {" AND ".join(f"k.{x} IS NOT DISTINCT FROM p.{x}" for x in parent_keys.split(", "))}) GROUP BY {keys}, bucket"""  # noqa: E731
    quantile = "CASE name " + " ".join(f"WHEN '{k}' THEN {v[0]}" for k, v in RULES.items()) + " ELSE 500 END"
    times = "CASE name " + " ".join(f"WHEN '{k}' THEN {v[1]}::DOUBLE" for k, v in RULES.items()) + " END"
    spread = f"CASE WHEN name IN ('long_words', 'short_words') THEN greatest(high - mid, mid * {LEAST_SPREAD}::DOUBLE) ELSE high - mid END"
    size = "CASE name " + " ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in COUNTED.items()) + " END"
    value = lambda at: f"CASE WHEN min(bucket) FILTER ({at}) = {ZERO} THEN 0.0::DOUBLE ELSE pow({GAMMA}::DOUBLE, min(bucket) FILTER ({at})) END"
    found = lambda cells, keys: f"""SELECT {keys}, {value("upto * 1000 >= total * 500")} AS mid, {value(f"upto * 1000 >= total * {quantile}")} AS high,
    coalesce(sum(n) FILTER (bucket = {ZERO}), 0)::DOUBLE / max(total) AS zeros FROM (
    SELECT {keys}, bucket, n, (sum(n) OVER (PARTITION BY {keys} ORDER BY bucket))::DOUBLE AS upto, (sum(n) OVER (PARTITION BY {keys}))::DOUBLE AS total FROM {cells}) GROUP BY {keys}"""  # noqa: E731
    fence = lambda cells, keys: f"""SELECT a.*, mid + {times} * {spread} AS fence, CASE WHEN mid = 0 THEN -ln(zeros) / b_mid ELSE 0.0::DOUBLE END AS rate
    FROM {cells} a LEFT JOIN (SELECT {", ".join(f"{k} AS b_{k}" for k in keys.split(", "))}, mid AS b_mid FROM {cells}) b ON b_name = {size.replace("CASE name", "CASE a.name")}
    AND {" AND ".join(f"a.{k} IS NOT DISTINCT FROM b_{k}" for k in keys.split(", ") if k != "name")} WHERE a.name NOT IN ('n_words', 'word_chars')"""  # noqa: E731
    counted = "CASE name " + " ".join(f"WHEN '{k}' THEN {v[0]}" for k, v in COUNTED.items()) + " END"
    of = "CASE name " + " ".join(f"WHEN '{k}' THEN {v[1]}" for k, v in COUNTED.items()) + " END"
    scale = "CASE name " + " ".join(f"WHEN '{k}' THEN {v[2]}::DOUBLE" for k, v in COUNTED.items()) + " END"
    event = "CASE name " + " ".join(f"WHEN '{k}' THEN {v[3]}::DOUBLE" for k, v in COUNTED.items()) + " END"
    within = f"""CASE WHEN name IN ({", ".join(f"'{k}'" for k in COUNTED)})
    THEN {counted} <= greatest(fence * {of} / {scale}, {event} * (1.0::DOUBLE + rate * {of} + {times} * sqrt(rate * {of}))) ELSE value <= fence END"""
    return rf"""
WITH d AS MATERIALIZED (SELECT doc_id, lang, source, row_number() OVER () AS r, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, unnest(range(1, len(ws) - {WINDOW - 2})) AS i, ws FROM d WHERE len(ws) >= {WINDOW}),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(ws[i:i + {WINDOW - 1}], ' ')) AS c FROM w),
m AS (SELECT r, i, coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i), {WINDOW}) AS step FROM g WHERE c > 1),
rep AS (SELECT r, sum(least(step, {WINDOW})) AS n FROM m GROUP BY r),
ln AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
a AS MATERIALIZED (SELECT doc_id, lang, source, d.r, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len([1 FOR i IN range(2, len(ws) + 1) IF ws[i] = ws[i - 1]]) AS n_echoes
  FROM d LEFT JOIN rep USING (r) LEFT JOIN dup ON dup.r = d.r),
b AS MATERIALIZED (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM a),
v AS MATERIALIZED ({" UNION ALL ".join(f"SELECT r, lang, source, n_symbols, n_dup_lines, n_repeat_words, n_echoes, n_words, word_chars, '{k}' AS name, {x} AS value FROM b WHERE NOT base_failed" for k, x in values.items())}),
c AS MATERIALIZED (SELECT lang, source, name, CASE WHEN value <= 0 THEN {ZERO} ELSE ceil(ln(value) / ln({GAMMA}::DOUBLE)) END::INT AS bucket, count(*) AS n FROM v GROUP BY ALL),
c0 AS (SELECT name, bucket, sum(n) AS n FROM c GROUP BY ALL),
s0 AS MATERIALIZED ({shares("c0", "name")}),
c1 AS (SELECT lang, name, bucket, sum(n) AS n FROM c GROUP BY ALL),
m1 AS MATERIALIZED ({shrunk("c1", lang, "s0", "name")}),
s1 AS MATERIALIZED ({shares("m1", lang)}),
m2 AS MATERIALIZED ({shrunk("c", own, "s1", lang)}),
q1 AS MATERIALIZED ({found("m1", lang)}),
q2 AS MATERIALIZED ({found("m2", own)}),
f1 AS MATERIALIZED ({fence("q1", lang)}),
f2 AS MATERIALIZED ({fence("q2", own)}),
f AS MATERIALIZED (SELECT f2.lang, f2.source, f2.name, least(f2.fence, f1.fence * {LOOSEST}::DOUBLE) AS fence, least(f2.rate, f1.rate * {LOOSEST}::DOUBLE) AS rate FROM f2 JOIN f1 ON f1.lang IS NOT DISTINCT FROM f2.lang AND f1.name = f2.name),
j AS (SELECT v.*, f.fence, f.rate FROM v JOIN f ON f.lang IS NOT DISTINCT FROM v.lang AND f.source IS NOT DISTINCT FROM v.source AND f.name = v.name),
k AS (SELECT r, bool_and({within}) AS fits FROM j GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(fits, false) AS kept FROM b LEFT JOIN k USING (r)"""


ORACLE = _oracle()
