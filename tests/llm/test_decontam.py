import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import lower
from weirflow.llm import _text as T
from weirflow.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(t):
    return WORD.findall(lower(t or ""))


def brute(rows, items, size):
    windows = {}
    for i, t in items:
        w = split(t)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n and i is not None else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for i, t in rows:
        w, hit, found = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return sorted(out, key=repr)


def got(df, bench, **options):
    r = decontam.report(df, bench, **options)
    return sorted(map(tuple, r.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=repr)


@pytest.fixture(scope="module")
def planted(spark, docs):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text")
    some = [r.text for r in bench.limit(6).collect()]
    more = [
        (5001, f"Intro {some[0].upper()} middle {some[1]} end", "en", "s", None),
        (5002, " ".join(some[2].split()[:9]) + " tail", "en", "s", 7),
        (5003, " ".join(some[3].split()[:7]) + " nothing", "en", "s", 7),
        (5004, some[4] + some[5], "en", "s", 7),
        (5005, "tiny words", "en", "s", 7),
    ]
    short = spark.createDataFrame([(900, "tiny words"), (901, "!!"), (None, some[0]), (902, None), (0, some[5])], "item_id long, text string")
    return docs.unionByName(spark.createDataFrame(more, docs.schema)), bench.unionByName(short)


@pytest.mark.parametrize("most", [1 << 24, 1500])
def test_hits_equal_brute_force(planted, most):
    df, bench = planted
    want = brute([(r.doc_id, r.text) for r in df.collect()], [(r.item_id, r.text) for r in bench.collect()], 8)
    assert sum(w[2] > 0 for w in want) >= 4 and any(w[5] for w in want)
    assert got(df, bench, most_bytes=most) == want


def test_edge_cases(spark, odd, none, planted):
    _, bench = planted
    want = brute([(r.doc_id, r.text) for r in odd.collect()], [(r.item_id, r.text) for r in bench.collect()], 8)
    assert got(odd, bench) == want
    assert got(none, bench) == [] and all(r[2] == 0 for r in got(odd, bench.where("false")))
    assert decontam.decontaminate(odd, bench).columns == odd.columns


def test_decisions_take_effect(planted):
    df, bench = planted
    out = {r.doc_id: r for r in decontam.decontaminate(df, bench, chars_col="n_chars").collect()}
    before = {r.doc_id: r for r in df.collect()}
    report = {r[0]: r for r in got(df, bench)}
    assert 5001 not in out and 5003 in out and out[5002].text == " tail" and out[5002].n_chars == 5
    for i, r in before.items():
        if report[i][3] >= 2:
            assert i not in out
        elif report[i][2] == 0:
            assert out[i] == r
        else:
            assert len(out[i].text) < len(r.text) and out[i].n_chars == len(out[i].text)
    again = {r[0]: r for r in got(decontam.decontaminate(df, bench), bench)}
    assert all(r[2] == 0 for r in again.values())


def test_windows_that_share_a_hash(planted, monkeypatch):
    df, bench = planted
    rows = [r for r in df.collect() if r.doc_id > 4900 or r.doc_id < 60]
    want = brute([(r.doc_id, r.text) for r in rows], [(r.item_id, r.text) for r in bench.collect()], 8)
    full = T.windows
    monkeypatch.setattr(T, "windows", lambda h, n: full(h, n) & np.uint64(0xFFF000000000003F))
    table = decontam.Ngrams([(str(r.item_id), r.text) for r in bench.collect() if r.item_id is not None and r.text is not None], 8)
    assert any((np.diff(w[0]) == 0).any() for w in table.windows.values())
    batch = pa.record_batch([pa.array([r.doc_id for r in rows]), pa.array([r.text for r in rows])], names=["c0", "text"])
    (out,) = decontam._scan(lambda: iter([table]), ["c0"], 1 << 30)(iter([batch]))
    got = sorted(((r["c0"], r["n_words"], sum(s["words"] for s in r["spans"]), len(r["items"])) for r in out.to_pylist()), key=repr)
    assert got == [w[:4] for w in want]


def test_tables_are_compact():
    import pickle

    r = random.Random(8)
    words = [f"word{i}" for i in range(5000)]
    items = [(str(i), " ".join(r.choice(words) for _ in range(200))) for i in range(1500)]
    size = sum(len(t) for _, t in items)
    assert len(pickle.dumps(decontam.Ngrams(items, 8))) < 6 * size + (1 << 20)


def test_clashing_names(spark, planted):
    _, bench = planted
    df = spark.createDataFrame([(1, "tiny words", 5, 6, "x")], "doc_id long, text string, `__wf_items` int, n_words int, `a.b` string")
    assert decontam.contamination(df, bench).columns == ["doc_id", "text", "__wf_items_", "n_words", "a.b", *decontam.FOUND]
    out = decontam.report(df, bench)
    assert out.columns == ["doc_id", "text", "__wf_items", "n_words_", "a.b", *decontam.REPORTED] and tuple(out.first())[2:8] == (5, 6, "x", 2, 2, 1)
    left = decontam.decontaminate(df, bench)
    assert left.columns == df.columns and tuple(left.first()) == (1, "", 5, 6, "x")
