"""The context tree against plain recursion and held-out text, the machine against held-out labels."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import xxhash

from tests.llm.conftest import ODD

from tilewright.llm import context_tree, toxicity


def table(name, sf="/root/testdata/sf0.01"):
    return pq.read_table(f"{sf}/{name}.parquet")


def brute_base(rows):
    words = [(i, (t or "").encode().lower().split()) for i, t in rows]
    train = [w for i, w in words if not context_tree.held_out(i)]
    c = Counter(x for w in train for x in w)
    n, v, ends = sum(c.values()) + len(train), len(c) + bool(train), len(train)
    out = []
    for i, w in words:
        score = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w) + math.log10((ends + 0.5) / (n + 0.5 * (v + 1)))
        out.append((i, context_tree.held_out(i), len(w) + 1, sum(c[x] > 0 for x in w) + bool(ends), n, round(score, 6)))
    return Counter(out)


def brute_tree(train, texts):
    """Context-tree weighting by recursion over a dictionary of counts."""
    d = context_tree.DEPTH
    counts: dict = {}
    bits = lambda s: [(s >> (7 - k)) & 1 for k in range(8)]
    def steps(text):
        t = b"\n" * d + text
        for p in range(d, len(t)):
            yield t[p - d : p][::-1], t[p]
    children: dict = {}
    for text in train:
        for ctx, s in steps(text):
            node = 1
            for b in bits(s):
                for n in range(d + 1):
                    counts.setdefault((ctx[:n], node), [0, 0])[b] += 1
                    if n:
                        children.setdefault((ctx[: n - 1], node), set()).add((ctx[:n], node))
                node = 2 * node + b
    def log_kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    memo: dict = {}
    def log_pw(key):
        if key not in memo:
            own = log_kt(*counts[key])
            memo[key] = own if len(key[0]) == d else np.logaddexp(own, sum(map(log_pw, children[key]))) - math.log(2)
        return memo[key]
    def p(ctx, node, b, n=0):
        key = (ctx[:n], node)
        c = counts[key]
        kt = (c[b] + 0.5) / (sum(c) + 1)
        if n == d or (ctx[: n + 1], node) not in counts:
            return kt
        w = 1 / (1 + math.exp(min(700, max(-700, sum(map(log_pw, children[key])) - log_kt(*c)))))
        return w * kt + (1 - w) * p(ctx, node, b, n + 1)
    scores = []
    for text in texts:
        total = 0.0
        for ctx, s in steps(text):
            node = 1
            for b in bits(s):
                total += math.log10(p(ctx, node, b) if ((b"", node) in counts) else 0.5)
                node = 2 * node + b
        scores.append(total)
    return scores


def test_scores_on_odd_rows(spark, make_docs, monkeypatch):
    rows = [(i, t) for i, t in ODD if i != 7] + [(7, "word " * 50)] * 2 + [(i, f"the cat {i} sat on the mat and the dog {i % 3}") for i in range(20, 60)]
    for chunk in (16 << 20, 200):
        monkeypatch.setattr(context_tree, "CHUNK", chunk)
        monkeypatch.setattr(context_tree, "_PIECE", max(64, chunk // 4))
        got = context_tree.context_tree_scores(make_docs(rows)).collect()
        assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == brute_base(rows)
        texts = [context_tree.canonical((t or "").encode().lower().split()) for _, t in rows]
        want = brute_tree([x for (i, _), x in zip(rows, texts, strict=True) if not context_tree.held_out(i)], texts)
        assert np.allclose(sorted(r.score for r in got), sorted(want), rtol=1e-4, atol=1e-4)


def test_scores_of_no_documents(spark, make_docs):
    assert context_tree.context_tree_scores(make_docs([])).collect() == []


def test_held_out_texts_get_shorter_codes_than_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 2 = 0")
    got = context_tree.context_tree_scores(docs).toPandas()
    t = docs.toArrow()
    rows = list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got.itertuples()) == brute_base(rows)
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_probabilities_of_a_context_sum_to_one():
    rng = np.random.default_rng(0)
    text = bytes(rng.choice(list(b"abc \n"), 3000))
    keys, n = np.unique(context_tree.gram_keys(text + b"\n"), return_counts=True)
    context = np.unique(keys >> np.uint64(8))[::50]
    every = np.unique(np.r_[(context[:, None] << np.uint64(8) | np.arange(256, dtype=np.uint64)).ravel(), keys])
    counts = np.zeros(len(every), np.int64)
    counts[np.searchsorted(every, keys)] = n
    tree = context_tree.Tree(every, counts)
    p = 10 ** tree.log10_probability(context_tree.Top(*tree.tops()))
    for c in context:
        assert abs(p[every >> np.uint64(8) == c].sum() - 1) < 1e-9


def test_toxicity_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 3 < 2")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = toxicity.toxicity_scores(docs, labels)
    found = got.join(labels, "doc_id").where("held_out").toPandas()
    hit = found[found.predicted == 1]
    assert (hit.toxic == 1).mean() > 0.95
    assert (found[found.toxic == 1].predicted == 1).mean() > 0.85
    assert all((zlib.crc32(str(i).encode()) % 3 == 1) for i in found.doc_id)
    again = toxicity.toxicity_scores(docs, labels).toPandas().sort_values("doc_id")
    assert np.allclose(again.score, got.toPandas().sort_values("doc_id").score)


def plain_toxicity(machine, text):
    """The machine's score by its formula, over all pairs of terms."""
    counts: Counter = Counter()
    for word in (text or "").lower().split():
        core = word.encode().strip(toxicity._STRIP)
        terms = {b"=" + core} | {b"^" + core[:n] for n in toxicity.PREFIXES if len(core) >= n} if core else set()
        counts.update({xxhash.xxh3_64_intdigest(t) % toxicity.BUCKETS for t in terms})
    x = {int(machine.place[t]): 1 + math.log(n) for t, n in counts.items() if machine.place[t] >= 0}
    total = machine.bias + sum(float(machine.w[i]) * v for i, v in x.items())
    for i in x:
        total += sum(float(machine.v[i].astype(float) @ machine.v[j].astype(float)) * x[i] * x[j] for j in x if j > i)
    return 1 / (1 + math.exp(-max(-40, min(40, total))))


def test_toxicity_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    machine = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    rows = table("documents").to_pylist()
    assert len(got) == len(rows)
    for row in rows[::5]:
        want = plain_toxicity(machine, row["text"])
        assert abs(got[row["doc_id"]].score - want) < 1e-4 and got[row["doc_id"]].predicted == (got[row["doc_id"]].score >= 0.7)


def test_toxicity_counts_are_not_cut(spark):
    """A word that comes 100,000 times weighs in the fit as it does in scoring."""
    docs = spark.createDataFrame([(1, "spam " * 100_000), (2, "fine words")], "doc_id long, text string")
    batch = docs.where("doc_id = 1").selectExpr("1 toxic", "cast(text as binary) text").toArrow().to_batches()
    counts = next(iter(toxicity._describe(iter(batch)))).column("counts")[0].as_py()
    assert set(np.frombuffer(counts, "<u4").tolist()) == {100_000}


def test_toxicity_learns_pairs():
    """A label that two terms make only together, and weights alone cannot."""
    rng = np.random.default_rng(1)
    a, b = rng.random(3000) < 0.5, rng.random(3000) < 0.5
    rows = np.r_[np.flatnonzero(a), np.flatnonzero(b), np.arange(3000)]
    buckets = np.r_[np.full(a.sum(), 10), np.full(b.sum(), 20), rng.integers(100, 200, 3000)]
    label = (a & b).astype(float)
    machine = toxicity.fit(rows, buckets, np.ones(len(rows), np.int64), label)
    c = machine.place[buckets]
    s = machine.score(rows[c >= 0], c[c >= 0], np.ones((c >= 0).sum()), 3000)
    assert ((s > 0.5) == (label > 0)).mean() > 0.99
    pair = machine.place[[10, 20]]
    assert machine.v[pair[0]] @ machine.v[pair[1]] > 0.1


def test_toxicity_odd_rows(spark, make_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (8, 1), (8, 0)], "doc_id long, toxic int")
    got = toxicity.toxicity_scores(make_docs(ODD), labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in ODD)
    assert all(0 <= r.score <= 1 for r in got)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert len({r.score for r in toxicity.toxicity_scores(make_docs(ODD), none).collect()}) == 1
    assert toxicity.toxicity_scores(make_docs([]), labels).collect() == []
