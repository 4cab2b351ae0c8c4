"""Language identification by prediction by partial matching (PPM).

Each language has a tree of its own of variable-order byte contexts (up to ``ORDER`` bytes). The code length of a byte
comes from the longest context that the language's tree holds, escaping (method C: distinct followers over total plus
distinct) to shorter ones and at last to 256 equal bytes. Statistics are frozen, so the whole code length of a text is a
sum of table entries; the language with the shortest code wins.

A language is fitted in one task, on a bounded sample of whole documents: the first ``SAMPLE_DOCS`` by a hash of the id, as far
as they hold ``SAMPLE_BYTES`` together (the first one always). All contexts that occur ``LEAST`` times there are kept. Languages are
any number: models up to ``MOST_BYTES`` are broadcast; beyond, tasks read each language's from the shared folder, for some
megabytes of text at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.llm import _text as T
from weirflow.llm._shared import apart, bounded, filesystem, picked, place, qualified, renamed, written

ORDER = 3
SAMPLE_DOCS, SAMPLE_BYTES = 600, 2 << 20
#: Occurrences in the sample from which a context is kept; what followed a context once says little.
LEAST = 2
#: Bytes of all languages' models up to which they are broadcast, and of tables that a worker keeps.
MOST_BYTES, MOST_KEPT = 64 << 20, 384 << 20
#: Text bytes that are scored at once.
BATCH = 2 << 20
_LETTER = regex.compile(r"\p{L}")
UND = "und"


def counts(texts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each number of context bytes from 0 to ORDER: kept contexts (as integers), followed by which byte, how often; sorted by both."""
    data = np.concatenate([*texts, np.zeros(0, np.uint8)]).astype(np.int64)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    left = np.repeat(ends, [len(t) for t in texts]) - np.arange(len(data))  # bytes from here to the text's end
    out, key = [], np.zeros(len(data), np.int64)
    for n in range(ORDER + 1):
        at = left > n  # a context of n bytes starts here and has a follower
        follower = np.append(data[n:], np.zeros(n, np.int64))[: len(data)]
        gram, times = np.unique(key[at] << 8 | follower[at], return_counts=True)
        context = gram >> 8
        if n:
            every, total = np.unique(context, return_inverse=True)
            total = np.bincount(total, times, len(every))
            own = total[np.searchsorted(every, context)] >= LEAST
            gram, times, context = gram[own], times[own], context[own]
        out.append((context, gram & 255, times))
        key = key << 8 | follower
    return out


@dataclass
class Language:
    """One tree: classes of bytes; longer: node and class of the byte before its context to the longer context's node, or the place behind all nodes; bits: code length by node and class."""

    classes: np.ndarray
    longer: np.ndarray
    bits: np.ndarray

    @classmethod
    def of(cls, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Language:
        classes = np.zeros(256, np.int64)
        seen = np.unique(found[0][1])
        classes[seen] = np.arange(1, len(seen) + 1)  # class 0: bytes never seen
        width = len(seen) + 1
        contexts = [np.unique(c) for c, _, _ in found]
        contexts[0] = np.zeros(1, np.int64)
        starts = np.concatenate([[0], np.cumsum([len(c) for c in contexts])])
        nodes = int(starts[-1])
        longer = np.full((int(starts[ORDER]) + 1, width), nodes, np.int32)
        tables = []
        for n, (context, byte, times) in enumerate(found):
            own = contexts[n]
            if n:
                short = np.searchsorted(contexts[n - 1], own & ((1 << 8 * (n - 1)) - 1))  # without the oldest byte
                longer[starts[n - 1] + short, classes[own >> 8 * (n - 1)]] = starts[n] + np.arange(len(own))
            count = np.zeros((len(own), width))
            if len(own):
                count[np.searchsorted(own, context), classes[byte]] = times
            total, kinds = count.sum(1, keepdims=True), (count > 0).sum(1, keepdims=True)
            low = tables[-1][short] if n else np.full((1, width), 1 / 256)
            p = np.where(count > 0, count / np.maximum(total + kinds, 1), kinds / np.maximum(total + kinds, 1) * low)
            tables.append(np.where(total > 0, p, low))
        return cls(classes, longer, -np.log2(np.concatenate(tables)).astype(np.float32))

    @property
    def size(self) -> int:
        return self.longer.nbytes + self.bits.nbytes

    def lengths(self, d: np.ndarray, since: np.ndarray) -> np.ndarray:
        """Bits of each byte; ``since``: how many bytes of its text lie before it."""
        c = self.classes[d]
        nodes = len(self.bits)
        level, best = np.zeros(len(c), np.int32), np.zeros(len(c), np.int32)
        last = len(self.longer) - 1
        for k in range(1, ORDER + 1):
            if len(c) <= k:
                break
            # the place behind all nodes leads nowhere
            up = self.longer[np.minimum(level[k:], last), c[:-k]]
            up[since[k:] < k] = nodes
            level = np.concatenate([np.full(k, nodes, np.int32), up])
            best = np.where(level < nodes, level, best)
        return self.bits[best, c]


def _packed(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> bytes:
    blobs = [T.packed(x) for context, byte, times in found for x in (np.diff(context, prepend=0), byte.astype(np.uint8), times.astype(np.uint32))]
    return b"".join(len(b).to_bytes(8, "little") + b for b in blobs)


def _unpacked(raw: bytes) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    at, parts = 0, []
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 8], "little")
        parts.append(raw[at + 8 : at + 8 + n])
        at += 8 + n
    return [(np.cumsum(T.unpacked(a, np.int64)), T.unpacked(b, np.uint8).astype(np.int64), T.unpacked(c, np.uint32).astype(np.float64)) for a, b, c in zip(parts[::3], parts[1::3], parts[2::3], strict=True)]


@T.trimmed
def _fit(t: pa.Table) -> pa.Table:
    data, offsets = T.strings(t.column("text"))
    found = counts([data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
    return pa.table({"lang": pa.array([t.column("lang")[0].as_py()], pa.string()), "tree": pa.array([_packed(found)], pa.binary())})


_tables: dict[tuple[str, str], Language] = {}


@dataclass
class Model:
    """Languages by name; their counts lie in the table at ``path``, and in ``trees`` if they are small together."""

    languages: list[str]
    path: str = ""
    trees: dict[str, bytes] | Broadcast = field(default_factory=dict)

    def table(self, name: str) -> Language:
        key = (self.path, name)
        if key not in _tables:
            trees = self.trees.value if isinstance(self.trees, Broadcast) else self.trees
            raw = trees.get(name)
            if raw is None:
                fs, base = filesystem(self.path)
                raw = pads.dataset(base, filesystem=fs, format="parquet").to_table(filter=pads.field("lang") == name).column("tree")[0].as_py()
            found = Language.of(_unpacked(raw))
            while _tables and sum(x.size for x in _tables.values()) + found.size > MOST_KEPT:
                del _tables[next(iter(_tables))]
            _tables[key] = found
        return _tables[key]

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text (a row) in each language."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        for i, name in enumerate(self.languages):
            table = self.table(name)
            for at in range(0, len(data), T.SEGMENT):
                to, lo = min(at + T.SEGMENT, len(data)), max(0, at - ORDER)
                first = np.searchsorted(offsets, np.arange(lo, to), "right") - 1
                bits = table.lengths(data[lo:to], np.arange(lo, to) - offsets[first])[at - lo :]
                out[:, i] += np.bincount(first[at - lo :], bits, len(out))
        return out


def fit(sample: DataFrame) -> Model:
    """The model from a frame with lang and text, one task for each language. Names reach the driver, and the trees' counts up to ``MOST_BYTES``."""
    spark = bounded(sample)
    trees = written(sample.where("lang is not null and text is not null").groupBy("lang").applyInArrow(_fit, "lang string, tree binary"), "trees")
    names = sorted((r.lang, r.n) for r in trees.select("lang", F.length("tree").alias("n")).collect())
    model = Model([n for n, _ in names], qualified(spark, trees._wf_path))
    if sum(n for _, n in names) <= MOST_BYTES:
        model.trees = {r.lang: bytes(r.tree) for r in trees.collect()}
    return model


#: Evidence counts as that of so many bytes at most, so that scores of long texts stay apart from 1.
_EVIDENCE = 64


def _predict(model: Model):
    @T.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in T.batches_of(whole, "text", BATCH):
                data, offsets = T.strings(b.column("text"))
                size = np.diff(offsets)
                read = size > 0 if model.languages else np.zeros(len(size), bool)
                letter = np.array([bool(n and _LETTER.search(x.as_py())) for n, x in zip(size.tolist(), b.column("text"), strict=True)], bool) & read
                lang, score, rate = np.full(len(size), UND, object), np.zeros(len(size)), np.full(len(size), np.nan)
                if read.any():
                    bits = model.lengths(data, offsets)
                    best = bits.argmin(1)
                    least = bits[np.arange(len(size)), best]
                    rate[read] = least[read] / size[read]
                    weight = np.minimum(1.0, _EVIDENCE / np.maximum(size, 1))
                    odds = (2.0 ** -np.minimum((bits - least[:, None]) * weight[:, None], 1000)).sum(1)
                    score[letter] = 1 / odds[letter]
                    lang[letter] = np.array(model.languages, object)[best[letter]]
                cols = [c for c in b.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in cols), pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(rate, mask=~read)], [*cols, *FOUND])

    return run


def training_sample(docs: DataFrame, train: Column, *, per_language: int = SAMPLE_DOCS, most_bytes: int = SAMPLE_BYTES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Whole texts and labels of at most ``per_language`` training documents of each language, the first by a hash of id and text, as far as they hold ``most_bytes`` together."""
    rows = picked(docs.where(train), lang=lang_col, text=text_col, id=id_col).select(F.col("lang").cast("string"), F.col("text").cast("string"), F.xxhash64("id", "text").alias("h"))
    rows = rows.where("lang is not null and text is not null")
    # a first sieve by the same hash, of twice the documents, keeps most texts where they lie
    share = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    wide = {k: 2 * per_language / n for k, n in share.items() if n > 4 * per_language}
    if wide:
        u = F.pmod("h", F.lit(1 << 30)) / float(1 << 30)
        limit = F.try_element_at(F.create_map(*[F.lit(x) for kv in wide.items() for x in kv]), F.col("lang"))
        rows = rows.where(u < F.coalesce(limit, F.lit(1.0)))
    rows = rows.withColumn("order", F.pmod("h", F.lit(1 << 30)))
    w = Window.partitionBy("lang").orderBy("order", "h", "text")
    rows = rows.withColumn("i", F.row_number().over(w)).where(F.col("i") <= per_language)
    before = F.coalesce(F.sum(F.octet_length("text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("before", before).where((F.col("i") == 1) | (F.col("before") + F.octet_length("text") <= most_bytes)).select("lang", "text")


#: Columns that ``identify`` adds.
FOUND = ("__wf_lang", "__wf_score", "__wf_bits")


def identify(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The documents with ``__wf_lang`` (a learned language; ``und`` if the text is null or has no letter), ``__wf_score`` (0 to 1; 0 for und) and ``__wf_bits`` (bits a byte in the best language; null for empty texts).

    Every whole text is scored. Without learned languages all is ``und``. Ties go to the first language by name. Columns keep
    their values; one that has the name of an added column gets an underscore behind its own. An empty table gives an empty result.
    """
    spark = bounded(docs)
    base, inner = renamed(docs)
    base = base.withColumn("text", F.col(inner[place(docs, text_col)]).cast("string"))
    if model.trees and not isinstance(model.trees, Broadcast):
        model = Model(model.languages, model.path, spark.sparkContext.broadcast(model.trees))
    schema = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(inner, base.schema.fields, strict=False)) + ", __wf_lang string, __wf_score double, __wf_bits double"
    return base.mapInArrow(_predict(model), schema).toDF(*apart(docs.columns, FOUND), *FOUND)
