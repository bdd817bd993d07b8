"""Mixing sources to target weights: repetition rates per source, floor plus a seeded Bernoulli copy."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Workspace, fresh, load, word_count

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"
#: Each source takes that of so many seeds whose draws bring it nearest to its target.
SEEDS = 64
_STEP, _RANGE = 2654435761, 1 << 32
_WIDE = "decimal(38,0)"


def source_plan(sized: DataFrame, ws: Workspace, weights=WEIGHTS, cap: int = CAP, rank_parts: int = 16) -> DataFrame:
    """(source, source_size, target, whole, fraction) from rows (source, size).

    Sources are ranked by code point with null last and take the weights in turn. Their shares of the
    total stop at cap times the source's size and the excess is shared again by weight. The ranking is a
    range sort with an offset per part, and each round of sharing is one aggregate of one row: no task
    holds all sources. An empty input gives an empty plan; sources of size 0 get target and rate 0."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    parts = ws.stage(
        totals.repartitionByRange(rank_parts, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()),
        "sources",
    )
    # one row per part, at most rank_parts of them
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    within = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(within) - 1 + F.col("skip")
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    ranked = ws.stage(
        parts.join(F.broadcast(offsets), "part").select("source", F.col("source_size").cast(_WIDE).alias("s"), weight.cast(_WIDE).alias("w")),
        "weights",
    )
    wide = lambda x: F.lit(Decimal(x)).cast(_WIDE)
    # the level num / den is what a weight of 1 gets; it only rises, so this ends
    num = den = None
    while True:
        capped = F.lit(False) if num is None else F.col("s") * cap * wide(den) < F.col("w") * wide(num)
        got = ranked.agg(
            F.sum("s").alias("total"),
            F.sum(F.when(capped, F.col("s") * cap).otherwise(0)).alias("fixed"),
            F.sum(F.when(capped, 0).otherwise(F.col("w"))).alias("open"),
        ).first()
        if got.total is None or int(got.open) == 0:
            num, den = num or 0, den or 1
            break
        level = int(got.total - got.fixed), int(got.open)
        if level == (num, den):
            break
        num, den = level
    top = F.col("s") * cap
    target = F.when(top * wide(den) < F.col("w") * wide(num), top.cast("double")).otherwise((F.col("w") * wide(num)).cast("double") / F.lit(float(den)))
    rate = F.when(F.col("s") > 0, F.col("target") / F.col("s").cast("double")).otherwise(0.0)
    return ws.stage(
        ranked.withColumn("target", target).withColumn("rate", rate).select(
            F.col("source").alias("plan_source"), F.col("s").cast("long").alias("source_size"), "target",
            F.floor("rate").cast("long").alias("whole"), (F.col("rate") - F.floor("rate")).alias("fraction"),
        ),
        "plan",
    )


def draw(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number of 32 bits that depends on the seed and the doc_id only; where that is null, on the text."""
    known = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), known)), 1, 8), 16, 10).cast("long")


def _extra(drawn: Column, number: Column, fraction: Column) -> Column:
    """1 with probability fraction, else 0: the draw of seed number is the first one moved on by so many steps of a circle."""
    return F.when(((drawn + number * _STEP) % _RANGE).cast("double") / F.lit(float(_RANGE)) < fraction, 1).otherwise(0)


def with_seeds(sized: DataFrame, plan: DataFrame, ws: Workspace) -> DataFrame:
    """plan with number: of the SEEDS seeds the one whose extra copies bring the source nearest to its target (the first of equals).

    One aggregation with a sum for each seed and source, from rows (source, size, drawn); the same rows give the same seeds."""
    joined = sized.join(plan, F.col("source").eqNullSafe(F.col("plan_source")))
    sums = [F.sum(F.col("size") * _extra(F.col("drawn"), F.lit(k), F.col("fraction"))).cast("double").alias(f"s{k}") for k in range(SEEDS)]
    want = F.col("target") - (F.col("whole") * F.col("source_size")).cast("double")
    off = F.array(*[F.struct(F.abs(F.col(f"s{k}") - want).alias("off"), F.lit(k).alias("number")) for k in range(SEEDS)])
    by_source = joined.groupBy(*plan.columns).agg(*sums)
    return ws.stage(by_source.select(*plan.columns, F.array_min(off)["number"].alias("number")), "seeded")


def _measured(docs: DataFrame, ws: Workspace, seed: str) -> DataFrame:
    return ws.stage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), draw(F.col("doc_id"), F.col("text"), seed).alias("drawn")), "sized")


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The mixture: each document as often as it is taken, with the columns of docs.

    Needs doc_id, text and source. Null texts have size 0, as empty ones; a very long text is taken whole or not at
    all, so a source of few such texts may miss its target by part of one. Null sources are a source of their own,
    equal rows are drawn alike (rows without doc_id by their text), and other columns, whatever their names, pass
    through. No documents give no rows."""
    ws = Workspace(docs.sparkSession, "mix")
    sized = _measured(docs, ws, seed)
    plan = with_seeds(sized, source_plan(sized.select("source", "size"), ws, weights, cap), ws)
    names = {c: fresh(docs, c) for c in ("plan_source", "whole", "fraction", "number", "copy")}
    plan = plan.select(*[F.col(c).alias(names[c]) for c in ("plan_source", "whole", "fraction", "number")])
    copies = F.col(names["whole"]) + _extra(draw(docs["doc_id"], docs["text"], seed), F.col(names["number"]), F.col(names["fraction"]))
    taken = docs.join(plan, docs["source"].eqNullSafe(F.col(names["plan_source"]))).withColumn(names["copy"], copies).where(F.col(names["copy"]) > 0)
    return taken.withColumn(names["copy"], F.explode(F.sequence(F.lit(1).cast("long"), F.col(names["copy"])))).select(*[docs[c] for c in docs.columns])


def op8_mix_sources(spark, sf_dir):
    """How many words of each document the mixture of all documents takes."""
    ws = Workspace(spark, "op8")
    sized = _measured(load(spark, sf_dir, "documents"), ws, SEED)
    plan = with_seeds(sized, source_plan(sized.select("source", "size"), ws), ws)
    taken = sized.join(plan, F.col("source").eqNullSafe(F.col("plan_source")))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("whole") + _extra(F.col("drawn"), F.col("number"), F.col("fraction")))).alias("taken"))


def shares_sql(docs: str, prefix: str = "") -> str:
    """CTEs for DuckDB: {prefix}sized (doc_id, source, size, ...) of a relation, and {prefix}mixed with copies."""
    return rf"""
{prefix}sized AS (
  SELECT *, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))), 1, 8))::BIGINT AS drawn FROM {docs}),
{prefix}per AS (
  SELECT source, sum(size)::BIGINT AS s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM {prefix}sized GROUP BY source),
{prefix}weighed AS (
  SELECT *, ([5, 2, 1])[(k % 3 + 1)::INT]::BIGINT AS w FROM {prefix}per),
{prefix}sorted AS (
  SELECT *, row_number() OVER o AS i, sum(s) OVER () - 3 * coalesce(sum(s) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS num,
         sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS den
  FROM {prefix}weighed WINDOW o AS (ORDER BY s::DOUBLE / w, k)),
{prefix}level AS (
  SELECT arg_min(num, i) AS num, arg_min(den, i) AS den FROM {prefix}sorted WHERE num * w <= 3 * s * den),
{prefix}targets AS (
  SELECT source, s AS source_size, CASE WHEN 3 * s * l.den < w * l.num THEN (3 * s)::DOUBLE ELSE (w * l.num)::DOUBLE / l.den::DOUBLE END AS target
  FROM {prefix}sorted, {prefix}level l),
{prefix}rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0.0 END AS rate FROM {prefix}targets),
{prefix}tries AS (
  SELECT d.source, k, abs(sum(CASE WHEN ((d.drawn + k * {_STEP}) % {_RANGE})::DOUBLE / {float(_RANGE)}::DOUBLE < r.rate - floor(r.rate) THEN d.size ELSE 0 END)::DOUBLE
         - (any_value(r.target) - (floor(any_value(r.rate))::BIGINT * any_value(r.source_size))::DOUBLE)) AS off
  FROM {prefix}sized d JOIN {prefix}rates r ON d.source IS NOT DISTINCT FROM r.source, range({SEEDS}) t(k) GROUP BY d.source, k),
{prefix}seeds AS (
  SELECT source, min(struct_pack(off := off, k := k)).k AS k FROM {prefix}tries GROUP BY source),
{prefix}mixed AS (
  SELECT d.*, r.source_size, r.target,
         (floor(r.rate) + CASE WHEN ((d.drawn + s.k * {_STEP}) % {_RANGE})::DOUBLE / {float(_RANGE)}::DOUBLE < r.rate - floor(r.rate) THEN 1 ELSE 0 END)::BIGINT AS copies
  FROM {prefix}sized d JOIN {prefix}rates r ON d.source IS NOT DISTINCT FROM r.source JOIN {prefix}seeds s ON d.source IS NOT DISTINCT FROM s.source)"""


ORACLE = f"WITH {shares_sql('documents')}\nSELECT doc_id, size, source_size, target, size * copies AS taken FROM mixed"
