import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from weirflow.llm import _text as T
from weirflow.llm import tokens
from weirflow.llm.queries import tokenizer_file


@pytest.fixture(scope="module")
def enc():
    return tokens.Encoder(tokenizer_file())


def ids(enc, t):
    return enc.lib.encode(t, add_special_tokens=False).ids


def run(enc, texts):
    flat, n = enc.encode(*T.strings(pa.array(texts)))
    at = np.concatenate([[0], np.cumsum(n)])
    return [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]


def test_encoder_equals_the_library(enc):
    r = random.Random(1)
    parts = list("ab Z9  \n\n\t!.'é<|>-ß \x1c漢") + ["<|endoftext|>", " it's", " ", "　", " \n ", "\u2003", "\u2028", "\x85", "é "]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(2000)]
    assert run(enc, texts) == [ids(enc, t) for t in texts]


def test_very_long_text_and_forgetting(enc, monkeypatch):
    r = random.Random(2)
    long = "".join(r.choice(["the", "cat ", "\n", "  ", "dog's ", " x!!", "é ", "\t", "\u3000", "漢 字", "\r\n"]) for _ in range(20_000))
    want = ids(enc, long)
    monkeypatch.setattr(tokens, "_PART", 1000)
    monkeypatch.setattr(tokens, "MOST_WORDS", 50)
    small = tokens.Encoder(tokenizer_file())
    assert run(small, [long]) == [want]
    texts = [f"word{i} other{i % 7}" for i in range(300)]
    assert run(small, texts) == [ids(enc, t) for t in texts]


def test_words_that_share_a_hash(enc, monkeypatch):
    tm = ["".join("ab"[(k.bit_count() + flip) % 2] for k in range(1024)) for flip in (0, 1)]
    assert run(enc, tm) == [ids(enc, t) for t in tm]
    full = T.spans_hash
    monkeypatch.setattr(T, "spans_hash", lambda *a: full(*a) & np.uint64(63))
    small = tokens.Encoder(tokenizer_file())
    texts = [f"word{i} other{i % 7}" for i in range(300)]
    for k in range(0, 300, 20):
        assert run(small, texts[k : k + 20]) == [ids(enc, t) for t in texts[k : k + 20]]


def plain(enc, rows):
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        x = [*ids(enc, t or ""), 0]
        out.append((i, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    return out


def test_round_trip(enc, docs, odd, none):
    for df in (docs, odd):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        files = tokens.write_tokens(df, tokenizer=tokenizer_file(), length=128, per_batch=8)
        got = sorted(map(tuple, tokens.read_tokens(files).collect()), key=lambda r: r[1])
        assert got == plain(enc, rows)
    assert tokens.read_tokens(tokens.write_tokens(none, tokenizer=tokenizer_file())).count() == 0


def test_sequences_are_views_of_equal_length(enc, docs):
    files = tokens.write_tokens(docs, tokenizer=tokenizer_file(), length=128, per_batch=8)
    total = 0
    for r in files.shards.orderBy("before").collect():
        shard = tokens.Shard(files.folder, r.shard)
        flat, n = [], 0
        for k in range(len(shard)):
            x, bits = shard[k]
            assert len(x) == 8 * len(bits) == 128 and not x.flags.owndata and not bits.flags.owndata
            mask = np.unpackbits(bits, bitorder="little").astype(bool)
            assert mask.all() or k == len(shard) - 1
            flat.append(x[mask])
            n += int(mask.sum())
        flat = np.concatenate(flat)
        for b in shard.documents():
            for s, k in zip(b.column("start").to_pylist(), b.column("n_tokens").to_pylist(), strict=True):
                assert (shard.tokens(s, k) == flat[s : s + k]).all() and flat[s + k - 1] == 0
        total += n
    assert total == sum(len(ids(enc, r.text)) + 1 for r in docs.collect())
