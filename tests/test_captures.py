"""Captured patterns: broken files, short and long ones, and a folder that is scanned as it grows."""

from pyspark.sql import functions as F

from tilewright.sources import captures


def file_of(points):
    return bytes([len(points), *[p[k] for k in range(3) for p in points]])


def code(p):
    return sum((v >> b & 1) << (3 * b + a) for a, v in enumerate(p) for b in range(8))


def pattern(points):
    ordered = sorted(points, key=code)
    n = len(ordered)
    if n <= 64:
        return dict(enumerate(ordered))
    buckets = {}
    for i, p in enumerate(ordered):
        buckets.setdefault(i * 64 // n, []).append(p)
    return {i: tuple(sum(p[k] for p in ps) // len(ps) for k in range(3)) for i, ps in buckets.items()}


def test_files_of_all_sizes(spark, tmp_path):
    files = {"none": [], "few": [(5, 6, 7), (1, 2, 3)], "same": [(9, 9, 9)] * 70, "many": [(i * 7 % 64, i * 5 % 64, i % 64) for i in range(200)]}
    for name, points in files.items():
        (tmp_path / f"{name}.lut").write_bytes(file_of(points))
    (tmp_path / "short.lut").write_bytes(b"\x03\x01\x02")
    (tmp_path / "other.txt").write_bytes(b"\x00")
    read = captures.read_captures(spark, str(tmp_path))
    assert [r.path.rpartition("/")[2] for r in read.where("error is not null").collect()] == ["short.lut"]
    got = {}
    for r in captures.patterns(read).collect():
        got.setdefault(r.path.rpartition("/")[2][:-4], {})[r.idx] = (r.x, r.y, r.z)
    assert got == {n: pattern(p) for n, p in files.items() if p}


def test_each_file_is_read_once(spark, tmp_path):
    """Three scans: one file, none more, two more; what a batch has written before a failure is written over."""
    folder, table, kept = (str(tmp_path / n) for n in ("in", "table", "kept"))
    (tmp_path / "in").mkdir()
    points = {n: [(i + k, i, k) for i in range(5)] for k, n in enumerate("abc")}
    (tmp_path / "in" / "a.lut").write_bytes(file_of(points["a"]))
    assert captures.scan_captures(spark, folder, table, kept).count() == 5
    assert captures.scan_captures(spark, folder, table, kept).count() == 5
    for n in "bc":
        (tmp_path / "in" / f"{n}.lut").write_bytes(file_of(points[n]))
    got = captures.scan_captures(spark, folder, table, kept).collect()
    assert sorted((r.path.rpartition("/")[2], r.idx) for r in got) == sorted((f"{n}.lut", i) for n in "abc" for i in range(5))
    assert len({r.batch for r in got}) == 2


def test_drawn_patterns(spark):
    rows = [("p", y, x, int(y * 10 + x > 20)) for y in range(10) for x in range(10)] + [("q", 0, 0, 0)]
    points = captures.image_patterns(spark.createDataFrame(rows, "path string, y int, x int, r int"))
    lit = [(y, x) for y in range(10) for x in range(10) if y * 10 + x > 20][:64]
    assert sorted((r.n, r.y, r.x, r.size) for r in points.collect()) == [(i, y, x, 64) for i, (y, x) in enumerate(lit)]
    assert captures.patterns(points, "xy").where(F.col("path") == "p").count() == 64
