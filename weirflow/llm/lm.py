"""Language-model scoring by deleted interpolation.

A word trigram model. P(w | u v) mixes c(u v w) / c(u v) with the bigram model, by a weight that depends on how often the
context u v was seen (buckets by powers of two); the bigram model mixes c(v w) / c(v), c(w) / N and a uniform 1 / (V + 1) (V known
words and one unknown class) by weights for each bucket of c(v). Weights are learned by expectation-maximisation on the tokens of
a held-out fold of the training documents, with that fold's own counts deleted.

Counts and scores cover all documents. Tasks cut the documents where they lie into chunks of bounded size. A chunk sends each of
its distinct n-grams once, with local counts, to the reducer that owns its share of the n-grams, and gets the corpus counts
back in the same order; so a frequent n-gram costs one entry a chunk, and no task sees more than a chunk or a share. First the
words, by 64-bit hash; they get numbers, small ones for frequent words, of which contexts and trigrams are then made without
further hashes. Trigrams travel with their first two words, so a context's count is the sum of its trigrams, and bigrams need not
be sent for themselves. Only histograms of fixed size reach the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.llm import _text as T
from weirflow.llm._shared import bounded, forget, place, renamed, written

#: Text bytes of a chunk, about; a task's arrays take some 30 times as much.
CHUNK_BYTES = 10 << 20
#: Tokens of the corpus for each share of the trigrams, and shares of trigrams for each one of the words.
RANGE_TOKENS, WORD_RANGES = 2_000_000, 8
#: Contexts whose second words' numbers differ in these bits only share a reducer; close together their codes take less room.
NEAR_BITS = 6
BUCKETS = 24  # of the context's count, by powers of two
FINE, DEPTH = 4, 40  # EM sees log2 probabilities in steps of 1 / FINE, down to -DEPTH
ROUNDS = 60
_END = np.uint64(0x5EED0000E0D00000)
#: Numbers of what stands before and behind each text; words' numbers follow.
_START, _PAD, _FIRST = 0, 1, 2


def _schema(text: str) -> tuple[pa.Schema, str]:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in text.split(", ")]), text


_CHUNK, _CHUNK_DDL = _schema("chunk long, doc_id array<long>, fold array<int>, n_words array<long>, vocabulary binary, stream binary")
_ASKED, _ASKED_DDL = _schema("slot long, chunk long, keys binary, train binary, fold binary")
_KNOWN, _KNOWN_DDL = _schema("chunk long, slot long, types long, ids binary, train binary, fold binary")
_NUMBERED, _NUMBERED_DDL = _schema("chunk long, ids binary, words_train binary, words_fold binary, types long, tokens long, texts long, fold_tokens long, fold_texts long")
_REQUEST, _REQUEST_DDL = _schema("slot long, chunk long, keys binary, each binary, followers binary, train binary, fold binary")
_ANSWER, _ANSWER_DDL = _schema("chunk long, slot long, train binary, fold binary, key_train binary, key_fold binary")
_COUNTED, _COUNTED_DDL = _schema("doc_id array<long>, fold array<int>, n_words array<long>, stream binary, words_train binary, words_fold binary, grams_train binary, contexts_train binary, grams_fold binary, contexts_fold binary, types long, tokens long, texts long, fold_tokens long, fold_texts long")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(schema.types)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for k in range(b.num_rows):
            yield b.slice(k, 1).to_pylist()[0]


def _gaps(keys: np.ndarray) -> bytes:
    return T.packed(np.diff(keys, prepend=np.uint64(0)))


def _sums(raw: bytes) -> np.ndarray:
    return np.cumsum(T.unpacked(raw, np.uint64), dtype=np.uint64)


def _chunks(most: int):
    """A row for each chunk: the documents, the hashes of its words, frequent ones first, and the words as places among them."""

    @T.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.gathered(batches, "text", most):
            w = T.words(*T.strings(b.column("text")))
            every, stream, times = np.unique(w.hashes, return_inverse=True, return_counts=True)
            order = np.argsort(-times, kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order))
            yield _batch([(uuid.uuid4().int >> 65, b.column("doc_id").to_pylist(), b.column("fold").to_pylist(), np.diff(w.offsets), T.packed(every[order]), T.packed(rank[stream]))], _CHUNK)

    return run


def _by_hash(r: dict) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a chunk's words and the end, and their order."""
    hashes = np.append(T.unpacked(r["vocabulary"], np.uint64), _END)
    return hashes, np.argsort(hashes, kind="stable")


def _ask_words(ranges: int):
    @T.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            hashes, order = _by_hash(r)
            fold, n, stream = np.array(r["fold"]), np.array(r["n_words"], np.int64), T.unpacked(r["stream"], np.uint32)
            of, counts = np.repeat(fold, n), []
            for least in (1, 2):
                c = np.bincount(stream[of >= least], minlength=len(hashes)).astype(np.uint32)
                c[-1] = (fold >= least).sum()
                counts.append(c[order])
            keys = hashes[order]
            slot = ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
            cuts = np.searchsorted(slot, np.arange(ranges + 1, dtype=np.uint64)).tolist()
            yield _batch([(s, r["chunk"], _gaps(keys[a:z]), *(T.packed(c[a:z]) for c in counts)) for s, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if z > a], _ASKED)

    return run


def _know_words(ranges: int):
    """Corpus counts of words, and numbers for them."""

    @T.trimmed
    def run(t: pa.Table) -> pa.Table:
        slot, rows = t.column("slot")[0].as_py(), t.to_pylist()
        keys = [_sums(r["keys"]) for r in rows]
        every = np.unique(np.concatenate(keys))
        at = [np.searchsorted(every, k) for k in keys]
        total = {c: np.zeros(len(every), np.uint32) for c in ("train", "fold")}
        asked = np.zeros(len(every), np.int64)
        for i, r in zip(at, rows, strict=True):
            asked[i] += 1
            for c, full in total.items():
                full[i] += T.unpacked(r[c], np.uint32)
        rank = np.empty(len(every), np.uint64)
        rank[np.lexsort((-asked, -total["train"].astype(np.int64)))] = np.arange(len(every))
        ids = rank * np.uint64(ranges) + np.uint64(_FIRST + slot)
        if len(ids) and int(ids.max()) >= 1 << 32:
            raise ValueError("more than four thousand million different words")
        types = int((total["train"] > 0).sum())
        out = [(r["chunk"], slot, types if k == 0 else 0, T.packed(ids[i].astype(np.uint32)), *(T.packed(full[i]) for full in total.values())) for k, (r, i) in enumerate(zip(rows, at, strict=True))]
        return pa.Table.from_batches([_batch(out, _KNOWN)])

    return run


@T.trimmed
def _number(left: pa.Table, right: pa.Table) -> pa.Table:
    """The numbers and counts of a chunk's words, in the order of their places."""
    r, answer = left.to_pylist()[0], right.sort_by("slot")
    _, order = _by_hash(r)
    fold, n, out = np.array(r["fold"]), np.array(r["n_words"], np.int64), []
    for c in ("ids", "train", "fold"):
        own = np.empty(len(order), np.uint32)
        own[order] = np.concatenate([T.unpacked(x.as_py(), np.uint32) for x in answer.column(c)])
        out.append(T.packed(own))
    sums = [int(x) for own in (fold > 0, fold == 2) for x in ((n[own] + 1).sum(), own.sum())]
    return pa.Table.from_batches([_batch([(r["chunk"], *out, sum(answer.column("types").to_pylist()), *sums)], _NUMBERED)])


class _Grams:
    """A chunk's contexts and trigrams. Each text reads: its words, the end, and a pad, which makes the end's bigram a context too."""

    def __init__(self, r: dict, ranges: int):
        n, words = np.array(r["n_words"], np.int64), T.unpacked(r["stream"], np.uint32).astype(np.int64)
        ids = T.unpacked(r["ids"], np.uint32).astype(np.uint64)
        v = len(ids) - 1
        end, start, pad, width = v, v + 1, v + 2, v + 3
        ids = np.concatenate([ids, np.array([_START, _PAD], np.uint64)])
        first = np.cumsum(n + 2) - (n + 2)
        self.fold = np.repeat(np.array(r["fold"], np.int32), n + 2)
        now = np.full(int((n + 2).sum()), end)
        last = first + n + 1
        inner = np.ones(len(now), bool)
        inner[last] = inner[last - 1] = False
        now[inner], now[last] = words, pad
        self.is_token = now != pad
        before = np.concatenate([[start], now[:-1]])
        before[first] = start
        far = np.concatenate([[start], before[:-1]])
        far[first] = start
        pair, at = np.unique(far * width + before, return_inverse=True)
        del far, before, inner
        code = ids[pair // width] << np.uint64(32) | ids[pair % width]
        del pair
        slot = T.mix(code >> np.uint64(NEAR_BITS)) % np.uint64(ranges)
        # contexts in the order of shares and of codes, trigrams in that of their contexts and of their last words' numbers
        order = np.lexsort((code, slot))
        rank = np.empty(len(order), np.uint64)
        rank[order] = np.arange(len(order))
        self.contexts, self.slots, context = code[order], slot[order], rank[at]
        del code, slot, order, rank, at
        self.context = context.astype(np.int32)
        gram, self.gram = np.unique(context << np.uint64(32) | ids[now], return_inverse=True)
        del context, now
        self.gram = self.gram.astype(np.int32)
        self.of, self.followers = (gram >> np.uint64(32)).astype(np.int64), (gram & np.uint64(0xFFFFFFFF)).astype(np.uint32)

    def counts(self, least: int) -> np.ndarray:
        """Of trigrams in documents of a fold from ``least``."""
        return np.bincount(self.gram[self.fold >= least], minlength=len(self.of)).astype(np.uint32)


def _request(ranges: int):
    @T.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            g = _Grams(r, ranges)
            train, fold = g.counts(1), g.counts(2)
            each = np.bincount(g.of, minlength=len(g.contexts)).astype(np.uint32)
            ends = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
            cuts = np.searchsorted(g.slots, np.arange(ranges + 1, dtype=np.uint64)).tolist()
            out = []
            for s, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if y > x:
                    i, j = int(ends[x]), int(ends[y])
                    out.append((s, r["chunk"], _gaps(g.contexts[x:y]), T.packed(each[x:y]), T.packed(g.followers[i:j]), T.packed(train[i:j]), T.packed(fold[i:j])))
            yield _batch(out, _REQUEST)

    return run


@T.trimmed
def _reduce(t: pa.Table) -> pa.Table:
    slot, rows = t.column("slot")[0].as_py(), t.to_pylist()
    keys = [_sums(r["keys"]) for r in rows]
    every = np.unique(np.concatenate(keys))
    at = [np.searchsorted(every, k) for k in keys]
    codes = [np.repeat(i.astype(np.uint64), T.unpacked(r["each"], np.uint32)) << np.uint64(32) | T.unpacked(r["followers"], np.uint32) for i, r in zip(at, rows, strict=True)]
    grams = np.unique(np.concatenate(codes))
    spot = [np.searchsorted(grams, c) for c in codes]
    del codes
    context, out = (grams >> np.uint64(32)).astype(np.int64), {}
    for c in ("train", "fold"):
        full = np.zeros(len(grams), np.uint32)
        for i, r in zip(spot, rows, strict=True):
            full[i] += T.unpacked(r[c], np.uint32)
        own = np.bincount(context, full, len(every)).astype(np.uint32)
        out[c], out[f"key_{c}"] = [T.packed(full[i]) for i in spot], [T.packed(own[i]) for i in at]
    return pa.Table.from_batches([_batch([(r["chunk"], slot, *(out[f.name][k] for f in list(_ANSWER)[2:])) for k, r in enumerate(rows)], _ANSWER)])


def _look_up(ranges: int):
    """The corpus counts of a chunk's contexts and trigrams, as they stand in the texts; those of the EM fold's documents also within the fold."""

    @T.trimmed
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        r, answer = left.to_pylist()[0], right.sort_by("slot")
        g = _Grams(r, ranges)
        inside = g.fold == 2
        for c in ("train", "fold"):
            own = inside if c == "fold" else np.ones(len(inside), bool)
            for name, column, where in (("grams", c, g.gram[own & g.is_token]), ("contexts", f"key_{c}", g.context[own])):
                r[f"{name}_{c}"] = T.packed(np.concatenate([T.unpacked(x.as_py(), np.uint32) for x in answer.column(column)])[where])
        return pa.Table.from_batches([_batch([tuple(r[f.name] for f in _COUNTED)], _COUNTED)])

    return run


def _terms(r: dict, n: int, texts: int, deleted: bool) -> dict[str, np.ndarray]:
    """For each token (of all documents; if ``deleted`` of the EM fold's, whose own counts are taken off) the counts of its trigram, its context, its bigram, the word before it and itself; and where the texts begin."""
    size = np.array(r["n_words"], np.int64)
    own = np.array(r["fold"]) == 2 if deleted else np.ones(len(size), bool)
    stream, end = T.unpacked(r["stream"], np.uint32).astype(np.int64), len(T.unpacked(r["words_train"], np.uint32)) - 1
    word = np.full(int((size + 1).sum()), end)
    last = np.zeros(len(word), bool)
    last[np.cumsum(size + 1) - 1] = True
    word[~last] = stream
    word, size = word[np.repeat(own, size + 1)], size[own]
    by_word = T.unpacked(r["words_train"], np.uint32).astype(np.float64)
    grams, contexts = T.unpacked(r["grams_train"], np.uint32).astype(np.float64), T.unpacked(r["contexts_train"], np.uint32).astype(np.float64)
    if deleted:
        by_word = by_word - T.unpacked(r["words_fold"], np.uint32)
        n_all = np.array(r["n_words"], np.int64)
        grams = grams[np.repeat(own, n_all + 1)] - T.unpacked(r["grams_fold"], np.uint32)
        contexts = contexts[np.repeat(own, n_all + 2)] - T.unpacked(r["contexts_fold"], np.uint32)
    first = np.cumsum(size + 1) - (size + 1)
    # a text has one context more than tokens: the last one is its end's bigram
    at = np.arange(len(word)) + np.repeat(np.arange(len(size)), size + 1)
    before = np.concatenate([[0.0], by_word[word[:-1]]])[: len(word)]
    before[first] = texts
    return {"gram": grams, "context": contexts[at], "bigram": contexts[at + 1], "before": before, "word": by_word[word], "first": first}


def _bucket(context: np.ndarray) -> np.ndarray:
    """0: context not seen."""
    return np.minimum(np.ceil(np.log2(context.astype(np.float64) + 1)).astype(np.int64), BUCKETS - 1)


def _step(p: np.ndarray) -> np.ndarray:
    """0: zero probability."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, 1 + np.clip(np.round(-FINE * np.log2(p)), 0, FINE * DEPTH - 1), 0).astype(np.int64)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum(np.where(b > 0, a / np.maximum(b, 1), 0), 1)


def _histogram(n: int, texts: int, types: int, low: np.ndarray | None):
    """Counts of the EM fold's tokens by context bucket and the steps of two estimates: of bigram and unigram, or, with the bigram model's weights ``low``, of trigram and bigram model."""
    steps = FINE * DEPTH + 1

    @T.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = np.zeros(BUCKETS * steps * steps, np.int64)
        for b in batches:
            for k in range(b.num_rows):
                r = b.slice(k, 1).to_pylist()[0]
                if 2 not in r["fold"]:
                    continue
                t = _terms(r, n, texts, True)
                p2, p1 = _ratio(t["bigram"], t["before"]), t["word"] / n
                if low is None:
                    bucket, one, two = _bucket(t["before"]), p2, p1
                else:
                    l2, l1, l0 = low[_bucket(t["before"])].T
                    bucket, one, two = _bucket(t["context"]), _ratio(t["gram"], t["context"]), l2 * p2 + l1 * p1 + l0 / (types + 1)
                cell = (bucket * steps + _step(one)) * steps + _step(two)
                np.add.at(full, *np.unique(cell, return_counts=True))
        cell = np.flatnonzero(full)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(full[cell])], ["cell", "n"])

    return run


def _fitted(bucket: np.ndarray, p: np.ndarray, n: np.ndarray, start: list[float]) -> np.ndarray:
    """Weights of the estimates ``p`` in each bucket by expectation-maximisation; a bucket without tokens takes the overall weights."""

    def fit(p: np.ndarray, n: np.ndarray) -> np.ndarray:
        lam = np.full(p.shape[1], 1 / p.shape[1])
        for _ in range(ROUNDS):
            share = p * lam
            share /= share.sum(axis=1, keepdims=True)
            lam = (share * n[:, None]).sum(axis=0) + 1e-3
            lam /= lam.sum()
        return lam

    overall = fit(p, n) if len(n) else np.array(start)
    return np.stack([fit(p[bucket == k], n[bucket == k]) if (bucket == k).any() else overall for k in range(BUCKETS)])


def _values() -> tuple[int, np.ndarray]:
    return FINE * DEPTH + 1, np.concatenate([[0], 2.0 ** -(np.arange(FINE * DEPTH) / FINE)])


def em(cells: np.ndarray, n: np.ndarray, unknown: float) -> np.ndarray:
    """The bigram model's weights (bigram, unigram, uniform) of each bucket from the histogram."""
    steps, value = _values()
    p = np.stack([value[cells // steps % steps], value[cells % steps], np.full(len(cells), unknown)], axis=1)
    out = _fitted(cells // (steps * steps), p, n, [0.3, 0.6, 0.1])
    out[0] = [0, *(out[0, 1:] / out[0, 1:].sum())]
    return out


def em_top(cells: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The weights (trigram, bigram model) of each bucket from the histogram."""
    steps, value = _values()
    out = _fitted(cells // (steps * steps), np.stack([value[cells // steps % steps], value[cells % steps] + 1e-300], axis=1), n, [0.5, 0.5])
    out[0] = [0, 1]
    return out


def _score(low: np.ndarray, top: np.ndarray, n: int, types: int, texts: int):
    @T.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                r = b.slice(k, 1).to_pylist()[0]
                t = _terms(r, n, texts, False)
                at = t["first"]
                l2, l1, l0 = low[_bucket(t["before"])].T
                t3, t2 = top[_bucket(t["context"])].T
                p = l2 * _ratio(t["bigram"], t["before"]) + l1 * t["word"] / max(n, 1) + l0 / (types + 1)
                base = np.add.reduceat(np.log10((t["word"] + 1) / (n + types + 1)), at)
                score = np.add.reduceat(np.log10(t3 * _ratio(t["gram"], t["context"]) + t2 * p), at)
                known = np.add.reduceat((t["word"] > 0).astype(np.int64), at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_id"], pa.int64()), pa.array(np.array(r["fold"]) == 0), pa.array(np.array(r["n_words"], np.int64) + 1), pa.array(known), pa.array(np.full(len(at), n, np.int64)), pa.array(base), pa.array(score)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def interpolated_scores(docs: DataFrame, *, held_out: Column, em_fold: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores all texts with a model learned from the rows that are not ``held_out``; ``em_fold`` marks the training rows on which the weights are learned.

    One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigram), score. Null and
    empty texts are one end token; null conditions count as false; repeated rows count each time. Other columns are
    ignored. An empty table gives an empty result; without training rows every token is unknown.
    """
    spark = bounded(docs)
    fold = F.when(F.coalesce(held_out, F.lit(False)), 0).when(F.coalesce(em_fold, F.lit(False)), 2).otherwise(1).cast("int")
    base, inner = renamed(docs.select("*", fold))
    rows = base.select(F.col(inner[place(docs, id_col)]).cast("long").alias("doc_id"), F.col(inner[place(docs, text_col)]).cast("string").alias("text"), F.col(inner[-1]).alias("fold"))
    chunks = written(rows.mapInArrow(_chunks(CHUNK_BYTES), _CHUNK_DDL), "chunks")
    tokens = chunks.agg(F.sum(F.size("doc_id") + F.expr("aggregate(n_words, 0L, (a, x) -> a + x)"))).first()[0] or 0
    if not tokens:
        return spark.createDataFrame([], SCORED)
    ranges = -(-tokens // RANGE_TOKENS)
    word_ranges = -(-ranges // WORD_RANGES)
    parts = max(ranges, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def dealt(df: DataFrame, by: str):
        return df.repartition(parts, by).groupBy(by)

    known = dealt(chunks.mapInArrow(_ask_words(word_ranges), _ASKED_DDL), "slot").applyInArrow(_know_words(word_ranges), _KNOWN_DDL)
    of_words = chunks.select("chunk", "fold", "n_words", "vocabulary")
    numbered = written(dealt(of_words, "chunk").cogroup(dealt(known, "chunk")).applyInArrow(_number, _NUMBERED_DDL), "numbered")
    # the streams are dealt once: for the requests and for the answers
    full = chunks.drop("vocabulary").repartition(parts, "chunk").join(numbered.repartition(parts, "chunk").hint("shuffle_hash"), "chunk")
    answered = dealt(full.mapInArrow(_request(ranges), _REQUEST_DDL), "slot").applyInArrow(_reduce, _ANSWER_DDL)
    counted = written(full.groupBy("chunk").cogroup(dealt(answered, "chunk")).applyInArrow(_look_up(ranges), _COUNTED_DDL), "counted")
    forget(chunks, numbered)
    n, texts, fold_n, fold_texts, types = (x or 0 for x in counted.agg(*[F.sum(c) for c in ("tokens", "texts", "fold_tokens", "fold_texts", "types")]).first())

    def histogram(low: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        cells = counted.mapInArrow(_histogram(max(n - fold_n, 1), texts - fold_texts, types, low), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
        return cells["cell"].to_numpy(np.int64), cells["n"].to_numpy(np.float64)

    low = em(*histogram(None), 1 / (types + 1))
    top = em_top(*histogram(low))
    return counted.mapInArrow(_score(low, top, n, types, texts), SCORED)
