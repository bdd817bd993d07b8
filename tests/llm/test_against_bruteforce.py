"""Whole results on the small tables and on odd rows against plain Python."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from tests.llm.conftest import ODD

from tilewright.llm import jaccard, packing, quality

SPACES = b" \t\n\x0b\x0c\r"


def corpus(sf="/root/testdata/sf0.001"):
    t = pq.read_table(f"{sf}/documents.parquet")
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))


def words(text):
    return (text or "").encode().split()


# ---- op3


def brute_pieces(rows, capacity=2048):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_vocab())
    out = []
    for doc_id, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            out.append((doc_id, k, at, len(ids[at : at + capacity]), zlib.crc32(ids[at : at + capacity].tobytes())))
    return Counter(out)


@pytest.mark.parametrize("rows", [corpus(), ODD, [(1, "It's <|endoftext|> O'NEIL'LL don't naïve é ǅ İstanbul ½ 12345 ...!?"), (2, "Ä Ö. ß, ñandú; x.y,,")]])
def test_pack_pieces_and_layout(spark, make_docs, rows):
    got = packing.pack(make_docs(rows), packing.default_vocab()).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == brute_pieces(rows)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for items in bins.values():
        end = 0
        for offset, length in sorted(items):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(bins) <= np.ceil(sum(r.length for r in got) / 2048) * 1.05 + 1
    assert all(sum(3 * n > 2048 for _, n in items) <= 2 for items in bins.values())


def test_pack_empty(spark, make_docs):
    assert packing.pack(make_docs([]), packing.default_vocab()).collect() == []


# ---- op5


def brute_quality(text):
    w = words(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = set()
    for i in range(len(w) - 7):
        if windows[tuple(w[i : i + 8])] > 1:
            inside |= set(range(i, i + 8))
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside)


@pytest.mark.parametrize("rows", [corpus(), ODD, [(i, ("a b c d e f g h i " * i + "\n") * 3 + "tail\n tail") for i in range(1, 5)]])
def test_quality_measures(spark, make_docs, rows):
    got = quality.quality_verdicts(make_docs(rows)).collect()
    found = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    assert found == Counter((i, *brute_quality(t)) for i, t in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def brute_verdicts(rows):
    """The rules again in plain Python: counts per bucket, quantiles by walking them."""
    import math

    measured = [(i, t, lang, source, *brute_quality(t), sum(a == b for a, b in zip(words(t), words(t)[1:], strict=False))) for i, t, lang, source in rows]

    def counts(m):
        n, chars, symbols, lines, repeats, echoes = m[4:]
        return {"symbols": (symbols, chars, 1000.0, 1), "dup_lines": (lines, n, 5000.0, 1), "repeats": (repeats, n, 1000.0, 16), "echoes": (echoes, n, 1000.0, 1)}

    def values(m):
        mean = m[5] * 1000.0 / max(m[4], 1)
        rates = {k: c * scale / max(size, 1) for k, (c, size, scale, _) in counts(m).items()}
        return rates | {"long_words": mean, "short_words": 1_000_000.0 / max(mean, 1.0), "n_words": max(m[4], 1), "word_chars": max(m[5], 1)}

    def failed(m):
        return m[4] < 20 or 100 * m[8] > 30 * m[4]

    sketches = defaultdict(Counter)
    for m in measured:
        if not failed(m):
            for name, v in values(m).items():
                bucket = -math.inf if v == 0 else math.ceil(math.log(v) / math.log(quality.GAMMA))
                for key in ((m[2], m[3], name), (m[2], name), (name,)):
                    sketches[key][bucket] += 1

    def lean(own, parent):
        """own in millionths, with the parent's sketch scaled to SHRINK rows."""
        total, run, before, out = sum(parent.values()), 0, 0, Counter({b: n * 1_000_000 for b, n in own.items()})
        for b in sorted(parent):
            run += parent[b]
            upto = math.floor(float(run) * 1_000_000 / float(total))
            out[b] += (upto - before) * quality.SHRINK
            before = upto
        return out

    def quantile(sketch, q):
        run = 0
        for b in sorted(sketch):
            run += sketch[b]
            if run * 1000 >= sum(sketch.values()) * q:
                return quality.GAMMA**b

    def fence(sketches, name):
        q, times = quality.RULES[name]
        mid, high = quantile(sketches[name], 500), quantile(sketches[name], q)
        return mid + times * (high - mid if name in ("symbols", "dup_lines", "repeats", "echoes") else max(high - mid, mid * quality.LEAST_SPREAD))

    def chance(sketches, name):
        size = "word_chars" if name == "symbols" else "n_words"
        none = sketches[name][-math.inf] / sum(sketches[name].values())
        return -math.log(none) / quantile(sketches[size], 500) if quantile(sketches[name], 500) == 0 else 0.0

    names = [k for k in values(measured[0])] if measured else []
    limits = {}
    for lang, source in {(m[2], m[3]) for m in measured if not failed(m)}:
        whole = {n: lean(sketches[lang, n], sketches[n,]) for n in names}
        own = {n: lean(sketches[lang, source, n], whole[n]) for n in names}
        for n in quality.RULES:
            limits[lang, source, n] = min(fence(own, n), quality.LOOSEST * fence(whole, n))
            if n not in ("long_words", "short_words"):
                limits[lang, source, n, "rate"] = min(chance(own, n), quality.LOOSEST * chance(whole, n))

    def within(m, n):
        limit = limits[m[2], m[3], n]
        if n in ("long_words", "short_words"):
            return values(m)[n] <= limit
        count, size, scale, event = counts(m)[n]
        mean = limits[m[2], m[3], n, "rate"] * size
        return count <= max(limit * size / scale, event * (1 + mean + quality.RULES[n][1] * math.sqrt(mean)))

    return {m[0]: not failed(m) and all(within(m, n) for n in quality.RULES) for m in measured}


def test_quality_verdicts_follow_the_sketches(spark, make_docs):
    t = pq.read_table("/root/testdata/sf0.01/documents.parquet")
    rows = list(zip(*(t[c].to_pylist() for c in ("doc_id", "text", "lang", "source")), strict=True))
    got = {r.doc_id: r.kept for r in quality.quality_verdicts(make_docs(rows)).collect()}
    assert got == brute_verdicts(rows)


def test_the_same_text_in_two_sources(spark, make_docs):
    """Texts with as many symbols as one source always has, in a source that never has any; and a junk source does not excuse itself."""
    rng = np.random.default_rng(1)

    def text(symbols):
        w = [f"w{x:05d}" for x in rng.integers(0, 99_999, 100)]
        return " ".join(w) + " #" * symbols

    rows = [(i, text(2 + i % 3), "en", "markup") for i in range(700)] + [(1000 + i, text(0), "en", "plain") for i in range(700)]
    rows += [(2000 + i, text(60), "en", "junk") for i in range(50)]
    same = text(3)
    rows += [(3000, same, "en", "markup"), (3001, same, "en", "plain"), (3002, text(9), "en", "markup")]
    kept = {r.doc_id: r.kept for r in quality.quality_verdicts(make_docs(rows)).collect()}
    assert kept == brute_verdicts(rows)
    assert kept[3000] and not kept[3001]
    assert not any(kept[2000 + i] for i in range(50))
    assert sum(kept[i] for i in range(700)) == 700 and sum(kept[1000 + i] for i in range(700)) == 700


def test_quality_filter_keeps_rows_and_columns(spark, make_docs):
    rows = [(i, f"word{i} and some more of it number {i} in a line of text which goes on for more than twenty words so that it is kept by all the rules {i}") for i in range(30)] + ODD
    docs = make_docs(rows)
    got = quality.quality_filter(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == list(range(30))
    assert quality.quality_filter(make_docs([])).collect() == []


# ---- op10


def brute_sets(rows, n=3):
    out = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    return out


def brute_components(rows, percent=90):
    sets = brute_sets(rows)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by_size = sorted((len(s), i) for i, s in enumerate(sets) if s)
    for k, (a, i) in enumerate(by_size):
        for b, j in by_size[k + 1 :]:
            if 100 * a < percent * b:
                break
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (a + b - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        r = find(i)
        if least.get(r) is None or (doc_id is not None and doc_id < least[r]):
            least[r] = doc_id
    return Counter((rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows)))


def near_copies():
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(300)]
    rows, base = [], [" ".join(rng.choice(vocab, n)) for n in (8, 12, 14, 25, 60, 200, 700)]
    for b in base:
        for _ in range(12):
            w = b.split()
            for _ in range(rng.integers(0, max(2, len(w) // 30))):
                w[rng.integers(len(w))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(w) if rng.random() < 0.7 else " ".join(w[: int(len(w) * 0.95)])))
    return rows


@pytest.mark.parametrize("tile", [1000, 2])
@pytest.mark.parametrize("rows", [corpus(), ODD, near_copies(), [(3, "a b"), (2, "A  b"), (1, "b a"), (0, "a")]])
def test_jaccard_components(spark, make_docs, rows, tile, monkeypatch):
    """Also with columns cut into tiles of two rows, chunks of few texts and many shards."""
    monkeypatch.setattr(jaccard, "TILE", tile)
    if tile == 2:
        monkeypatch.setattr(jaccard, "CHUNK", 5000)
        monkeypatch.setattr(jaccard, "SHARD", 20_000)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(make_docs(rows)).collect())
    assert got == brute_components(rows)


@pytest.mark.parametrize("rows", [near_copies(), ODD])
def test_near_dedup_keeps_one_of_each_component(spark, make_docs, rows):
    docs = make_docs(rows)
    got = jaccard.near_dedup(docs)
    assert got.columns == docs.columns
    groups = {(c if s else ("own", i, j)) for j, (i, s, c) in enumerate(brute_components(rows).elements())}
    assert len(got.collect()) == len(groups)


def test_chain_of_links_is_one_component(spark, make_docs):
    """Neighbours link, the ends do not."""
    w = [f"t{i}" for i in range(400)]
    rows = [(i, " ".join(w[i * 3 : i * 3 + 100])) for i in range(60)]
    got = jaccard.jaccard_components(make_docs(rows)).collect()
    assert {r.component_id for r in got} == {0}


def test_jaccard_empty(spark, make_docs):
    assert jaccard.jaccard_components(make_docs([])).collect() == []


def linked_sets(percent, rng, n):
    """Pairs of sets of about n numbers that link."""
    for _ in range(20):
        base = np.unique(rng.integers(0, 2**40, n))
        most = n * (100 - percent) // 100 + 1
        k = int(rng.integers(0, most))
        other = np.unique(np.r_[base[rng.permutation(len(base))[k:]], rng.integers(0, 2**40, int(rng.integers(0, most)))])
        both = len(np.intersect1d(base, other))
        if both and 100 * both >= percent * (len(base) + len(other) - both):
            yield base, other, both


def test_first_columns_never_miss_a_link():
    """Any two sets that link share a column that both send, which the bounds let pass, and no count of them is below the bound."""
    rng = np.random.default_rng(0)
    for percent, n in [(p, n) for p in (90, 80) for n in [*range(1, 60), 100, 333, 1000]]:
        for x, y, both in linked_sets(percent, rng, n):
            x, y = sorted((x, y), key=len)
            nx, ny = len(x), len(y)
            assert both >= jaccard.overlap_bound(percent, nx, ny)
            ax, ay = (np.flatnonzero(np.isin(a, b)) for a, b in ((x, y), (y, x)))
            sent = (ax < jaccard.short_prefix(percent, nx)) & (ay < jaccard.long_prefix(percent, ny))
            assert sent.any() and jaccard._may_link(percent, nx, ax[sent], ny, ay[sent]).all()
            last_x, last_y = ax[sent].max(), ay[sent].max()
            assert sent.sum() + min(nx - last_x, ny - last_y) - 1 >= both


def test_a_column_of_many_rows(spark, make_docs):
    """50,000 texts that share a passage and do not link, and a few that do: one column of all of them, cut into tiles."""
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, f"{passage} a{i} b{i} c{i} d{i} e{i} f{i} g{i} h{i} i{i}") for i in range(50_000)]
    rows += [(60_000 + i, rows[i][1].replace(f" i{i}", " other")) for i in range(5)]
    got = jaccard.jaccard_components(make_docs(rows, extra=False), 3, 80)
    near = {r.doc_id: r.component_id for r in got.where("doc_id <> component_id").collect()}
    assert near == {60_000 + i: i for i in range(5)}


def test_tiles_of_a_frequent_column(spark, make_docs, monkeypatch):
    """Rows whose only frequent columns are in reach of the prefix: all pairs are looked at, in tiles, and none links."""
    monkeypatch.setattr(jaccard, "TILE", 50)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(600):
        w = list(base)
        for at in rng.choice(120, 9, replace=False):
            w[at] = f"x{rng.integers(40)}"
        rows.append((i, " ".join(w)))
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(make_docs(rows), 3, 80).collect())
    assert got == brute_components(rows, 80)
