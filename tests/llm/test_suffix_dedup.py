"""Repeated passages against a plain search for 100-byte strings."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from tests.llm.conftest import ODD

from tilewright.llm import suffix_dedup


def brute(rows):
    """Same rows in order of doc_id (null last), each 100-byte string looked up in a set."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    seen, out = set(), []
    for i in order:
        b = (rows[i][1] or "").encode()
        gone = bytearray(len(b))
        for at in range(len(b) - 99):
            s = b[at : at + 100]
            if s in seen:
                gone[at : at + 100] = b"\1" * 100
            seen.add(s)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        out.append((rows[i][0], len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def corpus():
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet")
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))


def planted():
    """Passages at odd places, periodic texts, near copies, strings of exactly 99 and 100 bytes."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, other = prose(60), prose(30)
    rows = [(100 - i, prose(int(rng.integers(0, 40))) + passage + prose(int(rng.integers(0, 40)))) for i in range(20)]
    rows += [(200 + i, prose(5) + passage[: 90 + i] + prose(5)) for i in range(20)]
    rows += [(300 + i, other + str(i) + other) for i in range(5)]
    rows += [(400, "ab" * 300), (401, "x" * 99), (402, "x" * 100), (403, "x" * 101), (404, "é" * 120), (405, "ba" * 60), (None, passage), (None, passage), (406, passage + passage)]
    base = prose(150).split()
    for i in range(30):
        w = list(base)
        w[int(rng.integers(150))] = "CHANGED"
        rows.append((500 + i // 2, " ".join(w)))
    return rows


@pytest.mark.parametrize("rows", [planted(), [(i, t[:3000]) for i, t in corpus()], [(i, t) for i, t in ODD if i != 7] + [(7, "word " * 500)] * 2])
@pytest.mark.parametrize("chunk", [16 << 20, 3000])
def test_bytes_removed(spark, make_docs, rows, chunk, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    monkeypatch.setattr(suffix_dedup, "_PIECE", max(1000, chunk // 8))
    monkeypatch.setattr(suffix_dedup, "_TOGETHER", 6000 if chunk > 3000 else 20)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.suffix_dedup(make_docs(rows)).collect())
    assert got == brute(rows)


def test_no_documents(spark, make_docs):
    assert suffix_dedup.suffix_dedup(make_docs([])).collect() == []


@pytest.mark.parametrize("shallow", [0, 1, 2, 5])
def test_deep_shallow_sorts_and_marks_firsts(shallow):
    rng = np.random.default_rng(shallow)
    rows = rng.integers(0, 2, (400, 40)).astype(np.uint8)
    rows[:, :30] = rows[rng.integers(0, 8, 400), :30]
    rows[100:200] = rows[:100]
    order, first = suffix_dedup.deep_shallow(rows, shallow)
    strings = [r.tobytes() for r in rows]
    assert [strings[i] for i in order] == sorted(strings)
    assert order.tolist() == sorted(range(400), key=lambda i: (strings[i], i))
    assert first.tolist() == [strings.index(s) == i for i, s in enumerate(strings)]
