"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

Benchmark windows are hashed into sorted arrays. Up to ``MOST_BYTES`` of benchmark text (whose arrays take some four times as
much) they are one table, which is broadcast; a larger benchmark is cut into tables of that size, which lie as files in the
shared folder and which each task reads one after the other for every ``CHUNK`` of text. Documents are scanned once, where they
lie, without a shuffle; each hit is verified word by word.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm import _text as T
from weirflow.llm._shared import apart, bounded, filesystem, new_path, picked, pieces, place, qualified, renamed, text_bytes

MOST_BYTES = 8 << 20
#: Text bytes that are held against the tables at once; with several tables more, as each is read anew.
CHUNK, LONG_CHUNK = 4 << 20, 32 << 20
_BITS = 22


class Ngrams:
    """Windows of the items by their number of words: sorted hashes, a bit table before them, where each window stands in the items' text, and its items."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        data, offsets = T.strings(pa.array([x[1] for x in items], pa.large_string()))
        w = T.words(data, offsets, T.ALNUM)
        self.names = sorted({x[0] for x in items})
        number = {x: i for i, x in enumerate(self.names)}
        own = np.array([number[x[0]] for x in items], np.int32)
        self.data, self.starts, self.ends = T.lowered(data), w.starts.astype(np.int32), w.ends.astype(np.int32)
        count = np.diff(w.offsets)
        self.windows = {}
        for n in np.unique(np.minimum(count[count > 0], size)).tolist():
            some = np.flatnonzero(np.minimum(count, size) == n)
            each = count[some] - n + 1
            at = np.repeat(w.offsets[:-1][some] - (np.cumsum(each) - each), each) + np.arange(each.sum())
            item, h = np.repeat(own[some], each), T.windows(w.hashes, n)[at]
            order = np.lexsort((item, h))
            at, item, h = at[order].astype(np.int32), item[order], h[order]
            # one entry for each text of a window; a window that shares its hash with another text would be a further entry of that hash
            new = np.append(True, h[1:] != h[:-1])
            if len(at) > 1:
                new[1:] |= ~self.same(at[1:], at[:-1], n)
            first = np.flatnonzero(new)
            bits = np.zeros(1 << _BITS, bool)
            bits[h >> np.uint64(64 - _BITS)] = True
            self.windows[n] = (h[first], np.packbits(bits), at[first], np.append(first, len(h)), item)

    def same(self, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
        """Whether the windows of n words at places ``a`` read as those at ``b``."""
        out = np.ones(len(a), bool)
        for k in range(n):
            out &= T.same_spans(self.data, self.starts[a + k], self.ends[a + k], self.data, self.starts[b + k], self.ends[b + k])
        return out

    def hits(self, low: np.ndarray, w: T.Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each number of words: first words of all occurrences (which may lie across two texts), and which window it is. ``low``: the texts' bytes in lower case."""
        for n, (known, bits, at, _, _) in self.windows.items():
            h = T.windows(w.hashes, n)
            found = np.flatnonzero(np.unpackbits(bits).view(bool)[h >> np.uint64(64 - _BITS)])
            entry = np.searchsorted(known, h[found], "left")
            while len(found):
                ok = entry < len(known)
                found, entry = found[ok], entry[ok]
                ok = known[entry] == h[found]
                found, entry = found[ok], entry[ok]
                same = np.ones(len(found), bool)
                for k in range(n):
                    same &= T.same_spans(low, w.starts[found + k], w.ends[found + k], self.data, self.starts[at[entry] + k], self.ends[at[entry] + k])
                yield n, found[same], entry[same]
                found, entry = found[~same], entry[~same] + 1

    def items(self, n: int, entries: np.ndarray) -> np.ndarray:
        """Names of the items that hold any of these windows."""
        _, _, _, cuts, item = self.windows[n]
        return np.unique(np.concatenate([item[a:b] for a, b in zip(cuts[entries].tolist(), cuts[entries + 1].tolist(), strict=True)]))


def _scan(tables: Callable[[], Iterator[Ngrams]], columns: list[str], chunk: int):
    @T.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.gathered(batches, "text", chunk):
            data, offsets = T.strings(b.column("text"))
            w, low = T.words(data, offsets, T.ALNUM), T.lowered(data)
            marked = np.zeros(len(w.hashes) + 1, np.int32)
            items: list[set[str]] = [set() for _ in range(b.num_rows)]
            for table in tables():
                for n, at, entry in table.hits(low, w):
                    doc = np.searchsorted(w.offsets, at, "right") - 1
                    own = at + n <= w.offsets[doc + 1]
                    at, entry, doc = at[own], entry[own], doc[own]
                    if not len(doc):
                        continue
                    np.add.at(marked, at, 1)
                    np.add.at(marked, at + n, -1)
                    cuts = np.flatnonzero(np.diff(doc, prepend=-1))
                    for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(doc)], strict=True):
                        items[doc[a]].update(table.names[i] for i in table.items(n, np.unique(entry[a:z])).tolist())
            hit = np.cumsum(marked)[:-1] > 0
            spans = []
            for doc in range(b.num_rows):
                own = []
                if items[doc]:
                    a, z = int(w.offsets[doc]), int(w.offsets[doc + 1])
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[a:z].astype(np.int8), [0]])))
                    base, s = int(offsets[doc]), 0
                    for x, y in edge.reshape(-1, 2).tolist():
                        s += len(data[base : w.starts[a + x]].tobytes().decode())
                        base = int(w.ends[a + y - 1])
                        e = s + len(data[w.starts[a + x] : base].tobytes().decode())
                        own.append({"word": x, "words": y - x, "start": s, "end": e})
                        s = e
                spans.append(own)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in columns), pa.array(np.diff(w.offsets)), pa.array(spans, _SPANS), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                [*columns, "n_words", "spans", "items"],
            )

    return run


_SPANS = pa.list_(pa.struct([("word", pa.int64()), ("words", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
_DDL = "n_words long, spans array<struct<word:long,words:long,start:long,end:long>>, items array<string>"
#: Columns that ``contamination`` adds.
FOUND = ("__wf_n_words", "__wf_spans", "__wf_items")


def _found(docs: DataFrame, benchmark: DataFrame, *, size: int = 8, most_bytes: int = MOST_BYTES, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> tuple[DataFrame, list[str]]:
    """The documents with columns c0, c1, ... by place, n_words, spans and items."""
    spark = bounded(docs)
    items = picked(benchmark, item=item_col, text=item_text).select(F.col("item").cast("string"), F.col("text").cast("string")).where("item is not null and text is not null")
    slices = pieces(text_bytes(items), most_bytes)
    base, inner = renamed(docs)
    base = base.withColumn("text", F.col(inner[place(docs, text_col)]).cast("string"))

    def table(k: int) -> Ngrams:
        own = items.where(F.pmod(F.xxhash64("item"), F.lit(slices)) == k) if slices > 1 else items
        return Ngrams([(r.item, r.text) for r in own.collect()], size)  # about most_bytes

    if slices == 1:
        spread = spark.sparkContext.broadcast(table(0))
        tables = lambda: iter([spread.value])
    else:
        folder = qualified(spark, new_path(spark, "ngrams"))
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        for k in range(slices):
            with fs.open_output_stream(f"{path}/{k}") as f:
                f.write(pickle.dumps(table(k)))

        def tables() -> Iterator[Ngrams]:
            fs, path = filesystem(folder)
            for k in range(slices):
                with fs.open_input_file(f"{path}/{k}") as f:
                    yield pickle.loads(f.read())

    schema = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(inner, base.schema.fields, strict=False)) + ", " + _DDL
    return base.mapInArrow(_scan(tables, inner, CHUNK if slices == 1 else LONG_CHUNK), schema), inner


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents with three more columns: ``__wf_n_words``, ``__wf_spans`` (merged hit runs: first word, words, code points from start to end) and ``__wf_items`` (sorted ids of items with occurring windows).

    A window is ``size`` consecutive words of an item, or all of a shorter item. Null and empty texts have no words; items
    without words or with a null id are no items; rows that repeat an item id are one item. Columns of the documents stay; one that
    has the name of an added column gets an underscore behind its own. An empty table on either side gives no hits.
    """
    found, _ = _found(docs, benchmark, **options)
    return found.toDF(*apart(docs.columns, FOUND), *FOUND)


#: Columns that ``report`` adds.
REPORTED = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def report(docs: DataFrame, benchmark: DataFrame, *, least_items: int = 2, **options) -> DataFrame:
    """The documents with n_words, n_hit, n_items, items_sha256 and contaminated; a column of theirs that has such a name gets an underscore behind its own."""
    found, inner = _found(docs, benchmark, **options)
    return found.select(
        *inner,
        "n_words",
        F.coalesce(F.expr("aggregate(spans, 0L, (a, x) -> a + x.words)"), F.lit(0)).cast("long"),
        F.size("items").cast("long"),
        F.sha2(F.concat_ws(",", "items"), 256),
        F.size("items") >= least_items,
    ).toDF(*apart(docs.columns, REPORTED), *REPORTED)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, least_items: int = 2, text_col: str = "text", chars_col: str | None = None, **options) -> DataFrame:
    """Documents that hit ``least_items`` items or more go; from others the hit words are cut out. ``chars_col`` is set to the new length of a changed text.

    Documents without hits pass unchanged, null texts included; edge cases as in ``contamination``.
    """
    found, inner = _found(docs, benchmark, text_col=text_col, **options)
    t = inner[place(docs, text_col)]
    cut = F.expr(
        f"concat_ws('', transform(sequence(0, size(spans)), i -> case when i = 0 then substring({t}, 1, cast(spans[0].start as int)) "
        f"when i = size(spans) then substring({t}, cast(spans[i - 1].end + 1 as int)) "
        f"else substring({t}, cast(spans[i - 1].end + 1 as int), cast(spans[i].start - spans[i - 1].end as int)) end))"
    )
    text = F.when(F.size("spans") > 0, cut).otherwise(F.col(t))
    new = {t: text}
    if chars_col is not None:
        n = inner[place(docs, chars_col)]
        new[n] = F.when(F.size("spans") > 0, F.length(text)).otherwise(F.col(n)).cast(found.schema[n].dataType)
    return found.where(F.size("items") < least_items).select(*[new.get(c, F.col(c)).alias(c) for c in inner]).toDF(*docs.columns)
