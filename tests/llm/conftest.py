import random
import re
import zlib

import pytest

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def words(s):
    return SPACE.findall(lower(s or ""))


def crc(i):
    return zlib.crc32(str(i).encode())


ODD = [
    (9001, None, None, None),
    (9002, "", "en", ""),
    (9003, " \n\t ", None, "src0"),
    (9004, "12 34 !!", "en", None),
    (9005, "one", "en", "src1"),
    (9006, "same text here for all of us", "en", "src1"),
    (9007, "same text here for all of us", "en", "src1"),
    (9007, "same text here for all of us", "en", "src1"),
    (9008, "SAME text\there for all of us", "en", "src1"),
    (9009, "long " * 60_000 + "end", "en", "src2"),
    (9010, "x" * 300_000, "en", "src2"),
    (None, "a row without an id that says something", "en", "src1"),
    (9011, "漢字 and ünïcode words here İ", "fr", "é"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, blank and very long texts, ties, repeated rows, and columns with clashing names."""
    return spark.createDataFrame([(*r, i, "x", -1) for i, r in enumerate(ODD)], "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, rep int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def family(spark):
    """Documents with many edits of one text, so that buckets are large and similarities lie on both sides of the threshold."""
    r = random.Random(7)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    base = [r.choice(vocabulary) for _ in range(200)]
    out = []
    for i in range(400):
        w = list(base)
        for _ in range(r.randint(0, 14)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        out.append((i, " ".join(w)))
    out += [(1000 + i, " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 60)))) for i in range(200)]
    return spark.createDataFrame(out, "doc_id long, text string").repartition(4)
