"""Sites that share a register of the sketches count as the sites they are."""

from pyspark.sql import functions as F

from tilewright.llm import line_dedup


def test_ten_sites_in_one_register(spark):
    names = spark.range(20_000).select(F.concat(F.lit("site-"), F.col("id").cast("string")).alias("site"))
    same = [r.site for r in names.where(F.expr("shiftrightunsigned(xxhash64(site), 57) = 0")).limit(10).collect()]
    rows = [(i, f"shared line\nonly {i}\nnine sites" if i < 9 else f"shared line\nonly {i}", s) for i, s in enumerate(same)]
    rows += [(10 + i, "nine sites\nmany times", same[0]) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert docs.where("text like 'shared%'").agg(F.approx_count_distinct("source", line_dedup.ERROR)).first()[0] < 4
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(docs).collect()}
    assert got == {i: t.replace("shared line\n", "") for i, t, _ in rows}
