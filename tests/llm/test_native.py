"""The native operators on odd rows, and against their DuckDB twins."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ODD

from tilewright.llm import exact_dedup, line_dedup, mixing, registry, warc
from tilewright.llm.shared import Workspace

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({registry.ORACLES[name]})").fetchall()
    assert Counter(tuple(r) for r in got.select(*columns).collect()) == Counter(want)


@pytest.mark.parametrize("name", ["op2_exact_dedup", "op8_mix_sources", "op9_warc_revisits", "op4_line_dedup"])
def test_empty_tables(spark, tmp_path, name):
    for table in ("documents", "pages"):
        spark.read.parquet(f"{SF}/{table}.parquet").limit(0).write.parquet(str(tmp_path / f"{table}.parquet"))
    assert registry.QUERIES[name](spark, str(tmp_path)).collect() == []


def norm(t):
    return re.sub("[ \t\n\x0b\x0c\r]+", " ", t or "")


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.substring(F.sha2(t, 256), 1, 1)])
def test_exact_dedup(spark, make_docs, digest):
    """Also with a digest that many texts share, which the bytes must tell apart."""
    rows = ODD + [(20 + i, f"t{i % 7}  x") for i in range(40)]
    docs = make_docs(rows)
    got = exact_dedup.exact_dedup(docs, digest)
    assert got.columns == docs.columns
    first = {}
    for i, t in rows:
        k = norm(t)
        first[k] = i if k not in first or first[k] is None else min(first[k], i) if i is not None else first[k]
    assert Counter((r.doc_id, norm(r.text)) for r in got.collect()) == Counter((i, k) for k, i in first.items())
    sizes = Counter(norm(t) for _, t in rows)
    classes = exact_dedup._classes(docs, Workspace(spark, "t"), digest).collect()
    assert sum(r.kept for r in classes) == len(first)
    assert Counter(r.group_size for r in classes) == Counter(sizes[norm(t)] for _, t in rows)


def test_index_merges_runs_and_levels(spark):
    ws = Workspace(spark, "lsm")
    index = exact_dedup.DigestIndex(ws)
    schema = "doc_id long, digest string, row long"
    for at in range(3):
        index.flush(spark.createDataFrame([(10 * k + at, f"d{k}", 100 * at + k) for k in range(5)], schema))
    assert [len(level) for level in index.levels] == [1, 1]  # two runs have become one of the next level
    hits = index.lookup(spark.createDataFrame([("d0",), ("d4",), ("none",)], "digest string")).groupBy("digest").agg(F.min("first.doc_id").alias("least"), F.sum("size").alias("size"))
    assert {(r.digest, r.least, r["size"]) for r in hits.collect()} == {("d0", 0, 3), ("d4", 40, 3)}
    index.compact()
    index.flush(spark.createDataFrame([(-1, "d0", 7), (99, "d9", 8)], schema))
    got = {r.digest: (r["first"].doc_id, r["size"]) for r in index.compact().collect()}
    assert got == {"d0": (-1, 4), "d9": (99, 1)} | {f"d{k}": (10 * k, 3) for k in range(1, 5)}


def test_a_probe_keeps_rows_from_the_join(spark):
    """Of rows that a run does not have, its filter lets few pass; of those that it has, it keeps none back."""
    ws = Workspace(spark, "probe")
    run = ws.stage(spark.range(3000).select(F.sha2(F.col("id").cast("string"), 256).alias("digest")), "run")
    rows = spark.range(30000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    absent, perhaps = exact_dedup.split(rows, F.col("digest"), run, "digest")
    ids = {r.id for r in perhaps.collect()}
    assert set(range(3000)) <= ids and len(ids) < 3000 + 27000 / 8
    assert absent.count() + len(ids) == 30000
    assert exact_dedup.filter_bits(10**12) == exact_dedup.MOST_BITS


def test_split_without_a_filter(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MOST_BITS", 10)
    rows = spark.range(30).select(F.col("id").cast("string").alias("digest"))
    absent, perhaps = exact_dedup.split(rows, F.col("digest"), rows, "digest")
    assert absent.count() == 0 and perhaps.count() == 30


def test_mixture(spark, make_docs):
    rows = [(i, "w " * (1 + i % 9), "en", f"s{i % 5}" if i % 6 else None) for i in range(600)] + [(1000, None, "en", "empty"), (1001, "", "en", "empty")]
    docs = make_docs(rows)
    got = mixing.mix(docs)
    assert got.columns == docs.columns
    times = Counter(r.doc_id for r in got.select("doc_id").collect())
    assert max(times.values()) <= 3
    assert times == Counter(r.doc_id for r in mixing.mix(docs).select("doc_id").collect())
    size, taken = defaultdict(int), defaultdict(int)
    for i, t, _, s in rows:
        size[s] += len((t or "").split())
        taken[s] += times[i] * len((t or "").split())
    # ranks by code point, null last: weights 1 5 2 1 5 2 over empty(first), s0.., null
    order = sorted(s for s in size if s is not None) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, capped = sum(size.values()), set()
    while True:
        level = (total - 3 * sum(size[s] for s in capped)) / sum(weight[s] for s in size if s not in capped)
        more = {s for s in size if s not in capped and level * weight[s] > 3 * size[s]}
        if not more:
            break
        capped |= more
    for s in size:
        target = 3 * size[s] if s in capped else level * weight[s]
        assert abs(taken[s] - target) <= 0.05 * max(target, 1), (s, taken[s], target)
    assert mixing.mix(make_docs([])).collect() == []


def test_every_source_comes_near_its_target(spark):
    """On the test tables too, with their few long documents; and rows without doc_id are not all drawn alike."""
    got = mixing.op8_mix_sources(spark, SF)
    sums = got.join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most")).collect()
    assert sums and all(abs(r.taken - r.target) <= max(0.02 * r.target, r.most / 8) for r in sums), sums
    rows = [(None, f"one two {i}", "en", "a") for i in range(200)] + [(i, "x " * 50, "en", "b") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    texts = Counter(r.text for r in mixing.mix(docs).where("doc_id is null").collect())
    assert sum(texts.values()) == 600
    plan = mixing.source_plan(docs.select("source", mixing.word_count(F.col("text")).alias("size")), Workspace(spark, "t"), (2, 5), 3)
    rates = {r.plan_source: r.whole + r.fraction for r in plan.collect()}
    texts = Counter(r.text for r in mixing.mix(docs, (2, 5)).where("doc_id is null").collect())
    assert abs(sum(texts.values()) - 200 * rates["a"]) <= 10 and len(set(texts.values())) > 1 - (rates["a"] % 1 == 0)


def test_lines(spark, make_docs):
    rows = [(i, f"own {i}\n All rights   reserved\nown too {i}\n\nfew", "en", f"s{i}" if i else None) for i in range(12)]
    rows += [(100 + i, "few but seen\nx", "en", "s1") for i in range(30)] + [(200, None, "en", "s"), (201, "", "en", "s"), (None, "All rights reserved", "en", None)]
    rows[9] = (9, "nothing", "en", "s9")
    docs = make_docs(rows)
    got = line_dedup.line_dedup(docs)
    assert got.columns == docs.columns
    sites = defaultdict(set)
    for _, t, _, s in rows:
        for line in (t or "").split("\n"):
            if norm(line).strip():
                sites[norm(line).strip()].add(s)
    gone = {k for k, v in sites.items() if len(v - {None}) >= line_dedup.MIN_SITES}
    assert gone == {"All rights reserved", "few"}
    want = Counter((i, "\n".join(x for x in (t or "").split("\n") if norm(x).strip() not in gone)) for i, t, _, _ in rows)
    assert Counter((r.doc_id, r.text) for r in got.collect()) == want


def test_line_keys_have_128_bits(spark):
    """The second hash does not follow from the first, as it does where the constant comes last."""
    rows = spark.range(200).select(F.concat(F.lit("line "), "id").alias("text"))
    keys = rows.select(*line_dedup._line_key(F.col("text")), *line_dedup._text_key(), F.xxhash64("text", F.lit(1)).alias("chained")).collect()
    assert all(r.h2 != r.chained and (r.h1, r.h2) == (r.k1, r.k2) for r in keys)
    assert len({r.h2 for r in keys}) == 200


def test_a_text_of_many_lines(spark, make_docs):
    """60,000 lines, half of them boilerplate."""
    common = [f"common {i}" for i in range(30_000)]
    long = "\n".join(x for i, c in enumerate(common) for x in (c, f"own {i}"))
    docs = make_docs([(0, long, "en", "s0"), (1, "\n".join(common), "en", "s1"), (2, "none of them", "en", "s2")])
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(docs, min_sites=2).collect()}
    assert got == {0: "\n".join(f"own {i}" for i in range(30_000)), 1: "", 2: "none of them"}


def test_warc_round_trip(spark):
    rows = [(1, "http://a", "<p>é\r\n\r\nx</p>"), (2, "http://b\r\nX: y", "<p>é\r\n\r\nx</p>"), (3, None, None), (4, "u", ""), (None, "n", "z"), (5, "v", "z"), (6, "w", "WARC/1.1\r\n\r\n" * 9), (5, "v", "z"), (7, "long", "y" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("payload", F.lit(1))
    for least in (0, 2):
        ws = Workspace(spark, "warc")
        got = warc.read_archives(spark, warc.write_archives(pages, ws, min_bytes=least)).collect()
        assert Counter(r.page_id for r in got) == Counter(r[0] for r in rows)
        groups = defaultdict(list)
        for r in got:
            groups[r.payload_digest].append(r)
        assert len(groups) == len({h or "" for _, _, h in rows})
        by_page = {(i, (h or "").encode()) for i, _, h in rows}
        for own in groups.values():
            top = [r for r in own if r.record_type == "response"]
            if own[0].payload_bytes >= least:
                assert len(top) == 1 and top[0].page_id == max((r.page_id for r in own if r.page_id is not None), default=None)
                assert all(r.refers_to == top[0].page_id for r in own if r.record_type == "revisit")
            else:
                assert len(top) == len(own)
            assert all((r.page_id, bytes(r.payload)) in by_page for r in top)
            assert all(len(r.payload) == r.payload_bytes and warc.b32encode(hashlib.sha1(r.payload).digest()).decode() == r.payload_digest for r in top)


def test_broken_archives_are_refused():
    good = b"WARC/1.1\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    assert [b for _, b in warc._records(iter([good[:9], good[9:], good]))] == [b"ab", b"ab"]
    for bad in (good[:-6], good[:12], b"x" + good, good.replace(b": 2", b": 1")):
        with pytest.raises(ValueError):
            list(warc._records(iter([bad])))
