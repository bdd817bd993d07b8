"""Cross-site boilerplate: lines spread over many distinct sites, by HyperLogLog sketches; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exact_dedup import split, text_key
from .shared import SPACE, Workspace, fresh, load

#: A line on so many distinct sites is boilerplate.
MIN_SITES = 10
#: Standard error of the sketches (128 registers), and how many of them above the threshold are still counted exactly.
ERROR, NEAR = 0.1, 3.0


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _hashes(value: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes with seeds of their own: in Spark's hash of several columns each one's hash is the seed of the next,
    so the constant must come first, as after the value it would make the second a function of the first."""
    return F.xxhash64(value), F.xxhash64(F.lit(1), value)


def _line_key(line: Column) -> list[Column]:
    """128 bits of a line whose white space is made single spaces; null where it has no word."""
    norm = F.trim(F.regexp_replace(line, SPACE, " "))
    return [F.when(norm != "", h).alias(name) for name, h in zip(("h1", "h2"), _hashes(norm), strict=True)]


def _text_key() -> list[Column]:
    return [h.alias(name) for name, h in zip(("k1", "k2"), _hashes(F.col("text")), strict=True)]


def line_table(docs: DataFrame, ws: Workspace, site: str) -> DataFrame:
    """(id, k1, k2, site, place, h1, h2): every line with a word, read once and written to the shared folder."""
    # the texts' hashes in a step of their own: beside the generator they would be computed again for each line
    keyed = docs.select(F.col("doc_id").alias("id"), *_text_key(), F.col(site).alias("site"), "text")
    each = keyed.select("id", "k1", "k2", "site", F.posexplode(_lines(F.col("text"))).alias("place", "line"))
    return ws.stage(each.select("id", "k1", "k2", "site", "place", *_line_key(F.col("line"))).where("h1 is not null"), "lines")


def boilerplate(lines: DataFrame, ws: Workspace, min_sites: int = MIN_SITES) -> DataFrame:
    """(h1, h2) of the lines that come on min_sites distinct sites or more.

    A sketch of the sites of each line is built and merged by one aggregation with partial results, so that a
    line on all pages is one row per task. Lines whose estimate is not beyond NEAR standard errors above the
    threshold get an exact count, of distinct (line, site) pairs, however low it is: any number of sites may share
    registers. Only lines that come less often than min_sites are left out before. A null site is none."""
    keyed = lines.select("site", "h1", "h2")
    sketched = ws.stage(
        keyed.groupBy("h1", "h2").agg(F.approx_count_distinct("site", ERROR).alias("sites"), F.count("site").alias("times")).where(F.col("times") >= min_sites), "sketched"
    )
    sure = sketched.where(F.col("sites") > min_sites * (1 + NEAR * ERROR)).select("h1", "h2")
    near = sketched.where(F.col("sites") <= min_sites * (1 + NEAR * ERROR)).select("h1", "h2")
    exact = keyed.where("site is not null").join(near, ["h1", "h2"], "left_semi").distinct().groupBy("h1", "h2").agg(F.count("*").alias("sites"))
    return ws.stage(sure.unionByName(exact.where(F.col("sites") >= min_sites).select("h1", "h2")), "boilerplate")


def _strip(docs: DataFrame, ws: Workspace, site: str, min_sites: int, names: dict[str, str]) -> DataFrame:
    """docs with two more columns: the lines, and the places of those that go.

    The places come back by (doc_id, 128 bits of the text): rows equal in both lose the same lines. Texts that lose
    none stay where they are, by a filter of the identifiers of those that do; only these are shuffled."""
    lines = line_table(docs, ws, site)
    hit = lines.join(boilerplate(lines, ws, min_sites), ["h1", "h2"], "left_semi")
    places = ws.stage(
        hit.groupBy("id", "k1", "k2").agg(F.collect_set("place").alias("places")).select(*[F.col(c).alias(names[c]) for c in ("id", "k1", "k2", "places")]), "places"
    )
    ws.drop("lines", "sketched", "boilerplate")
    whole, touched = split(docs, text_key("doc_id"), places.select(text_key(names["id"]).alias("key")), "key")
    key = _text_key()
    joined = touched.join(places, F.col("doc_id").eqNullSafe(F.col(names["id"])) & (key[0] == F.col(names["k1"])) & (key[1] == F.col(names["k2"])), "left")
    whole = whole.withColumn(names["places"], F.lit(None).cast("array<int>"))
    return joined.select(*whole.columns).unionByName(whole).withColumn(names["lines"], _lines(F.col("text")))


def _kept(names: dict[str, str]) -> Column:
    """The lines that stay, in time that is linear in their number: places are taken from a set, lines by their place.

    The lines are bound to a lambda's variable, as an expression inside a lambda would split the text again for each line."""
    lines, places = F.col(names["lines"]), F.col(names["places"])
    rest = lambda own: F.array_except(F.sequence(F.lit(0), F.size(own) - 1), places)
    return F.when(places.isNull(), lines).otherwise(F.transform(F.array(lines), lambda own: F.transform(rest(own), lambda i: F.get(own, i)))[0])


_OWN = ("id", "k1", "k2", "places", "lines")


def line_dedup(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """docs with boilerplate lines cut out of text; needs doc_id, text and the site's column.

    A text all of whose lines go is left empty; null texts become empty; a very long text is cut whole, by one task, in time
    linear in its lines. A line on exactly min_sites sites is boilerplate. A null site counts for no line. Rows
    that repeat are treated alike, other columns pass through whatever their names. No documents give no rows."""
    names = {c: fresh(docs, f"line_{c}") for c in _OWN}
    found = _strip(docs, Workspace(docs.sparkSession, "lines"), site, min_sites, names)
    return found.withColumn("text", F.array_join(_kept(names), "\n")).select(*[F.col(c) for c in docs.columns])


def op4_line_dedup(spark, sf_dir):
    """All documents: their lines, how many are boilerplate, and the digest of what stays."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "source")
    names = {c: fresh(docs, f"line_{c}") for c in _OWN}
    found = _strip(docs, Workspace(spark, "op4"), "source", MIN_SITES, names)
    n = F.size(F.col(names["lines"]))
    return found.select(
        "doc_id", n.cast("long").alias("n_lines"), F.coalesce(F.size(F.col(names["places"])), F.lit(0)).cast("long").alias("n_removed"),
        F.sha2(F.array_join(_kept(names), "\n"), 256).alias("kept_sha256"),
    )


ORACLE = rf"""
WITH s AS (SELECT doc_id, source, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, source, r, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS place FROM s),
n AS (SELECT *, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')) AS norm FROM l),
b AS (SELECT norm FROM n WHERE norm <> '' GROUP BY norm HAVING count(DISTINCT source) >= {MIN_SITES}),
m AS (SELECT n.*, b.norm IS NOT NULL AS gone FROM n LEFT JOIN b USING (norm))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id"""
