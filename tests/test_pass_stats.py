"""Figures of passes and folders of table files."""

from pyspark.sql import functions as F

from tilewright.operators import gradient, lut
from tilewright.plans import pass_stats
from tilewright.sources import tables
from tilewright.sources.files import write_files
from tilewright.sources.rasters import blank_images, lut_bank, mixed_image


def jobs(spark, group, call):
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = call()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)), out


def test_figures_take_no_job_of_their_own(spark, tmp_path):
    image = mixed_image(spark, "/root/testdata/sf0.001").where("y < 8").cache()
    image.count()
    plain, tiles = jobs(spark, "plain", lambda: gradient.cascade(image, ["r", "g", "b"], 64, 8))
    run = pass_stats.PassStats("one")
    seen, _ = jobs(spark, "seen", lambda: gradient.cascade(image, ["r", "g", "b"], 64, 8, observe=run.observe))
    assert seen == plain
    want = {(str(r["pass"]), r.tw * r.th): r.n for r in tiles.groupBy("pass", "tw", "th").agg(F.count("*").alias("n")).collect()}
    assert {(x["technique"], x["tile"]): x["tiles"] for x in run.figures()} == want and want
    run.append(spark, str(tmp_path))
    run.append(spark, str(tmp_path))  # again: the same file
    other = pass_stats.PassStats("two")
    other.seen = run.seen
    other.append(spark, str(tmp_path))
    read = pass_stats.read_stats(spark, str(tmp_path))
    assert {r.run for r in read.collect()} == {"one", "two"} and read.count() == 2 * len(want)
    total = pass_stats.totals(read).where("technique = 'all' and tile = 'all'").first()
    assert total.tiles == 2 * sum(want.values()) and total.pixels == 2 * sum(n * size for (_, size), n in want.items())


def test_folders_of_table_files(spark, tmp_path):
    """As the driver writes them; broken files are rows of their own."""
    bank = lut_bank(spark)
    for channels in (3, 2):
        folder = tmp_path / str(channels)
        write_files(tables.table_files(lut.factors(bank).withColumn("file", F.lit("a")), channels), str(folder))
        tables.write_tables(bank, str(tmp_path / f"{channels}.one"), channels)
        assert (folder / "a.lut").read_bytes() == (tmp_path / f"{channels}.one").read_bytes()
        (folder / "b.lut").write_bytes((folder / "a.lut").read_bytes()[:-1])
        (folder / "c.lut").write_bytes(b"LU")
        read = tables.read_table_files(spark, str(folder), channels)
        assert sorted(r.path.rpartition("/")[2] for r in read.where("error is not null").collect()) == ["b.lut", "c.lut"]
        good = read.where("error is null").drop("path", "error")
        assert sorted(good.collect()) == sorted(tables.read_tables(spark, str(folder / "a.lut"), channels).select(*good.columns).collect())


def test_blank_images(spark):
    sizes = spark.createDataFrame([(1, 2, 3, 9), (2, 0, 5, 1), (3, 1, 1, None)], "image_id int, width int, height int, value int")
    got = sorted((r.image_id, r.y, r.x, r.v) for r in blank_images(sizes, ["v"]).where("image_id < 3").collect())
    assert got == [(1, y, x, 9) for y in range(3) for x in range(2)]
    assert [tuple(r) for r in blank_images(sizes, ["v"]).where("image_id = 3").collect()] == [(3, 0, 0, None)]
