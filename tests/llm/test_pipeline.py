"""The pipeline against plain Python, stage by stage on what each stage is given."""

from collections import Counter, defaultdict

import corpus_pipeline
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.llm.test_against_bruteforce import brute_components, brute_pieces, brute_verdicts
from tests.llm.test_native import norm

SF = "/root/testdata/sf0.001"


def rows_of(frame):
    return [(r.doc_id, r.text, r.lang, r.source) for r in frame.select("doc_id", "text", "lang", "source").collect()]


def near(rows):
    """brute_components for shingles of five words at 80 percent."""
    import tests.llm.test_against_bruteforce as b

    sets = b.brute_sets
    try:
        b.brute_sets = lambda r, n=3: sets(r, corpus_pipeline.NEAR_WORDS)
        return brute_components(rows, corpus_pipeline.NEAR_PERCENT)
    finally:
        b.brute_sets = sets


def test_each_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, given = docs.columns, rows_of(docs)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == columns, name
            kept = rows_of(docs)
        if k == 0:
            verdict = brute_verdicts(given)
            assert sorted(kept, key=str) == sorted((r for r in given if verdict[r[0]]), key=str)
            assert len(kept) > len(given) // 2
        elif k == 1:
            least = {}
            for i, t, *_ in given:
                least[norm(t)] = min(i, least.get(norm(t), i))
            assert Counter(r[0] for r in kept) == Counter(least.values())
        elif k == 2:
            components = near([r[:2] for r in given])
            alone = Counter(i for i, n, _ in components.elements() if n == 0)
            assert Counter(r[0] for r in kept) == Counter(set(c for _, n, c in components if n)) + alone
        elif k == 3:
            times = Counter(r[0] for r in kept)
            assert max(times.values()) <= 3 and set(times) <= {r[0] for r in given}
            size, taken = defaultdict(int), defaultdict(int)
            for i, t, _, s in given:
                size[s] += len((t or "").split())
                taken[s] += times[i] * len((t or "").split())
            assert abs(sum(taken.values()) - sum(size.values())) < 0.05 * sum(size.values())
        else:
            got = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in docs.collect())
            assert got == brute_pieces([r[:2] for r in given])
        given = kept


def test_run_gives_the_last_stage(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0 and "sequence_id" in got.columns
    used = got.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert used.where("n > 2048").isEmpty()


def test_empty_documents(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("repeat", [1, 3])
def test_nulls_repeats_and_odd_columns(spark, make_docs, repeat):
    from tests.llm.conftest import ODD

    docs = make_docs(ODD * repeat)
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), stage(spark, docs, "").schema)
        assert docs.count() <= 3 * len(ODD) * repeat + 99, name


@pytest.mark.parametrize("repeat", [1, 3])
def test_each_stage_on_odd_rows(spark, make_docs, repeat):
    """Nulls, empty and long texts, repeated rows, clashing columns: the rows that each stage must keep, and what it takes of them."""
    from tests.llm.conftest import ODD

    given = [r for r in ODD for _ in range(repeat)] + [(30, "enough words to pass the base rules of quality in a text that says nothing twice and ends after twenty words or so for good")] * repeat
    docs = make_docs(given)
    stages = [stage(spark, docs, "").collect() for _, stage in corpus_pipeline.STAGES]
    full = [(i, t, "en", "s") for i, t in given]
    verdict = brute_verdicts(full)
    assert Counter(r.doc_id for r in stages[0]) == Counter(i for i, _ in given if verdict[i])
    assert {r.doc_id for r in stages[0]} == {30}
    least = {}
    for i, t in given:
        least[norm(t)] = min((x for x in (i, least.get(norm(t))) if x is not None), default=None)
    assert Counter((r.doc_id, norm(r.text)) for r in stages[1]) == Counter((i, t) for t, i in least.items())
    components = near(given)
    alone = Counter(i for i, n, _ in components.elements() if n == 0)
    assert Counter(r.doc_id for r in stages[2]) == Counter(set(c for _, n, c in components if n)) + alone
    taken, source = Counter((r.doc_id, r.text) for r in stages[3]), Counter(given)
    assert set(taken) <= set(source) and all(taken[k] % n == 0 and taken[k] <= 3 * n for k, n in source.items())
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in stages[4]) == brute_pieces(given)
    for rows in stages[:4]:
        assert not rows or rows[0].asDict().keys() == docs.first().asDict().keys()
