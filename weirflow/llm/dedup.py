"""MinHash near-duplicate removal.

Every text becomes the set of its distinct word shingles. Texts with equal sets form a class; the
smallest id stands for it. Each class gets ``PERMS`` universal hash minima; ``BANDS`` bands of them
propose pairs, signatures and then the full sets confirm them, and connected components come from
alternating large-star and small-star steps.

Buckets are not expanded into pairs. Each member is first held against the smallest member of its
bucket. What remains are pairs of a bucket that the links so far leave in different components: within
a bucket (in blocks, when it is large) those whose signatures agree are tied into families, member by
member, of which only spanning edges are emitted; each family's sets then meet (in blocks again), all its pairs between
components are compared exactly, and again only spanning links are emitted. So no proposed link
between components is lost. Members of a large family's largest component are copied once for each block of its
other members, so rows grow with the members as long as most are in one component; a family of very many
different components is compared in blocks squared, which is the work that it takes.

Chance of missing a pair of similarity 0.8: (1 - 0.8**4)**32 < 1e-7; the signature filter cuts six
standard deviations below the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm import _text as T
from weirflow.llm._shared import bounded, forget, maybe_broadcast, picked, written

PERMS, BANDS = 128, 32
#: Members and shingles of a block; two blocks meet in a task.
BLOCK, BLOCK_SHINGLES = 1024, 500_000
#: Edges (16 bytes each) that one task works on.
FEW_EDGES = 200_000
#: Ids (8 bytes each) that may be broadcast.
MOST_IDS = 500_000

_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 2**63, PERMS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, PERMS, dtype=np.uint64) * np.uint64(2)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int, second: bool = False) -> tuple[np.ndarray, ...]:
    """Sorted distinct shingles of each text, one after the other, and their offsets. Fewer words than ``size`` give one shingle; none give none.

    With ``second`` also the shingles' hashes by an independent function, in the same order.
    """
    w = T.words(data, offsets, second=second)
    win, more = T.windows(w.hashes, size), T.windows(w.second, size) if second else None
    sets, others = [], []
    for a, b in zip(w.offsets[:-1].tolist(), w.offsets[1:].tolist(), strict=True):
        if b - a < size:
            sets.append(T.windows(w.hashes[a:b], b - a) if b > a else win[:0])
            if second:
                others.append(T.windows(w.second[a:b], b - a) if b > a else win[:0])
        elif second:
            own, first = np.unique(win[a : b - size + 1], return_index=True)
            sets.append(own)
            others.append(more[a : b - size + 1][first])
        else:
            sets.append(np.unique(win[a : b - size + 1]))
    sizes = np.array([len(x) for x in sets], np.int64)
    flat = np.concatenate(sets) if sets else win[:0]
    offs = np.concatenate([[0], np.cumsum(sizes)])
    return (flat, offs, np.concatenate(others) if others else flat[:0]) if second else (flat, offs)


def minima(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The signature of each non-empty set, one row per set."""
    out = np.empty((len(offsets) - 1, PERMS), np.uint32)
    buf = np.empty_like(values)
    at = offsets[:-1]
    with np.errstate(over="ignore"):
        for i in range(PERMS):
            np.multiply(values, _A[i], out=buf)
            buf += _B[i]
            out[:, i] = np.minimum.reduceat(buf, at) >> np.uint64(32)
    return out


def _sketch(size: int):
    @T.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in T.batches_of(whole, "text", 2 << 20):
                values, offs, others = shingle_sets(*T.strings(b.column("text")), size, second=True)
                n = np.diff(offs)
                some = np.flatnonzero(n)
                d1, d2, sigs = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), [b""] * len(n)
                if len(some):
                    at = offs[:-1][some]
                    with np.errstate(over="ignore"):
                        d1[some] = np.add.reduceat(T.mix(values + np.uint64(0x1234567)), at).view(np.int64)
                        d2[some] = np.add.reduceat(T.mix(others ^ np.uint64(0xABCDEF0123)), at).view(np.int64)
                    sig = minima(values, np.append(at, offs[-1]))
                    for k, row in zip(some.tolist(), sig, strict=True):
                        sigs[k] = row.tobytes()
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(d1), pa.array(d2), pa.array(sigs, pa.binary())], ["doc_id", "n", "d1", "d2", "sig"])

    return run


def sketches(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id, set size, two sums over independent hashes of 64 bits that identify the set, and the signature (empty without words)."""
    return picked(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_sketch(size), "doc_id long, n long, d1 long, d2 long, sig binary")


@T.trimmed
def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = PERMS // BANDS
    for whole in batches:
        for at in range(0, whole.num_rows, 2000):
            b = whole.slice(at, 2000)
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(-1, BANDS, rows).astype(np.uint64)
            h = np.empty(sig.shape[:2], np.uint64)
            for k in range(BANDS):
                h[:, k] = T.windows(np.append(sig[:, k, :].reshape(-1), np.uint64(k)), rows)[::rows][: len(sig)]
                h[:, k] = T.mix(h[:, k] + np.uint64((k * 0x9E3779B97F4A7C15) % 2**64))
            ids = np.repeat(b.column("rep").to_numpy(zero_copy_only=False), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).view(np.int64)), pa.array(ids)], ["h", "rep"])


def _agreement(least: float):
    @T.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4000):
                b = whole.slice(at, 4000)
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(-1, PERMS) for c in ("sig_a", "sig_b"))
                keep = (x == y).mean(axis=1) >= least
                yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(keep)), b.column("b").filter(pa.array(keep))], ["a", "b"])

    return run


def _confirm(size: int, percent: int):
    @T.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in T.batches_of(whole, "text_a", 1 << 20):
                xs, xo, xg = shingle_sets(*T.strings(b.column("text_a")), size, second=True)
                ys, yo, yg = shingle_sets(*T.strings(b.column("text_b")), size, second=True)
                keep = np.zeros(b.num_rows, bool)
                for k in range(b.num_rows):
                    x, y = xs[xo[k] : xo[k + 1]], ys[yo[k] : yo[k + 1]]
                    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
                    same = int((xg[xo[k] + i] == yg[yo[k] + j]).sum())  # by both hashes
                    keep[k] = 100 * same >= percent * (len(x) + len(y) - same) and len(x) and len(y)
                yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(keep)), b.column("b").filter(pa.array(keep))], ["a", "b"])

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each value of ``g``, which come sorted by it."""
    held, key = [], None
    for b in batches:
        g = b.column("g").to_numpy()
        cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            if y > x:
                if held and g[x] != key:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(b.slice(x, y - x))
                key = g[x]
    if held:
        yield pa.Table.from_batches(held)


def _spanning(least: float, size: int, percent: int, exact: bool):
    """Spanning edges over the members of each run, between members of different components whose signatures agree, and if ``exact`` whose sets do."""

    def of(t: pa.Table) -> Iterator[tuple[int, int]]:
        rep, comp, blk = (t.column(c).to_numpy() for c in ("rep", "comp", "blk"))
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(-1, PERMS)
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        one, two = blk == i, blk == j
        # a link makes two components one, so members of one component are one from the start; a tie only unites its two members
        own = np.unique(comp, return_inverse=True)[1] if exact else np.arange(len(rep))
        if exact:
            values, offs = shingle_sets(*T.strings(t.column("text")), size)
            every, ids = np.unique(values, return_inverse=True)
            mark, n = np.zeros(len(every), np.int32), np.diff(offs)
        for r in np.flatnonzero(one).tolist():
            other = np.flatnonzero(two & (own != own[r]) & (comp != comp[r]))
            if i == j:
                other = other[other > r]
            if len(other):
                other = other[(sig[other] == sig[r]).mean(axis=1) >= least]
            if exact and len(other):
                mine = ids[offs[r] : offs[r + 1]]
                mark[mine] = 1
                same = np.array([mark[ids[offs[k] : offs[k + 1]]].sum() for k in other.tolist()])
                mark[mine] = 0
                other = other[100 * same >= percent * (n[other] + n[r] - same)]
            for k in other.tolist():
                if own[k] != own[r]:
                    own[own == own[k]] = own[r]
                    yield int(rep[r]), int(rep[k])

    @T.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for t in _runs(batches):
            new = [(min(e), max(e)) for e in of(t)]
            out = [e for e in dict.fromkeys(new) if e not in seen]
            if len(seen) < 200_000:
                seen.update(out)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in out], pa.int64()), pa.array([e[1] for e in out], pa.int64())], ["a", "b"])

    return run


def _met_in_blocks(members: DataFrame, key: str, weight, more: DataFrame | None = None) -> DataFrame:
    """Deals the members (rep, comp, and what the tasks need; ``more`` adds to that by rep) of each ``key`` into blocks, brings together every two blocks that hold members of different components, and sorts them by pair ``g``.

    A key whose members all are in one component has no pairs. What exceeds a block is parted: members of the key's largest
    component need not meet each other, so their blocks meet only those of the rest, and a member of the largest is copied
    once for each block of the rest. ``weight``: shingles that a member brings with it.
    """

    def blocks(c, s):
        return F.greatest(F.ceil(c / BLOCK), F.ceil(s / BLOCK_SHINGLES)).cast("int")

    parts = members.groupBy(key, "comp").agg(F.count("*").alias("c"), F.sum(weight).alias("s"))
    parts = parts.groupBy(key).agg(F.max(F.struct("c", "s", "comp")).alias("m"), F.sum("c").alias("c"), F.sum("s").alias("s")).where(F.col("c") > F.col("m.c"))
    fits = blocks(F.col("c"), F.col("s")) == 1
    parts = parts.select(
        key,
        F.when(~fits, F.col("m.comp")).alias("major"),
        F.when(fits, 0).otherwise(blocks(F.col("m.c"), F.col("m.s"))).alias("nm"),
        F.when(fits, 1).otherwise(blocks(F.col("c") - F.col("m.c"), F.col("s") - F.col("m.s"))).alias("nr"),
    )
    dealt = members.join(parts, key)
    if more is not None:
        dealt = dealt.join(more, "rep")
    inner, h = F.coalesce(F.col("comp") == F.col("major"), F.lit(False)), F.xxhash64("rep")
    dealt = dealt.withColumns({
        "blk": F.when(inner, F.pmod(h, F.col("nm"))).otherwise(F.col("nm") + F.pmod(h, F.col("nr"))).cast("int"),
        "o": F.explode(F.sequence(F.when(inner, F.col("nm")).otherwise(F.lit(0)), F.col("nm") + F.col("nr") - 1)),
    })
    dealt = dealt.withColumns({"i": F.least("blk", "o"), "j": F.greatest("blk", "o")}).withColumn("g", F.xxhash64(key, "i", "j")).drop("nm", "nr", "major", "o", key)
    return dealt.repartition(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), "g").sortWithinPartitions("g", "rep")


def components(edges: DataFrame) -> DataFrame:
    """Alternate large-star and small-star until the edges (a, b) no longer change; returns (node, component), smallest id first, without the components' own smallest ids.

    Up to ``FEW_EDGES`` edges, by count, a step is one task without a shuffle; more are dealt out.
    """

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    seen = state(now)

    def together(e: DataFrame) -> DataFrame:
        return e.coalesce(1) if seen[0] <= FEW_EDGES else e

    while seen[0]:
        both = together(now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = together(large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))))
        before, now = now, written(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
        forget(before)
        then, seen = seen, state(now)
        if then == seen:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest id reachable over links), kept.

    Links join ids whose shingle sets have 100 * intersection >= percent * union, confirmed on the full sets.
    A null, empty or blank text has no shingles and links to nothing. A null id is never linked: its row has a
    null component and is kept. Rows that repeat an id are one node with all their texts' links. Other columns are
    ignored. An empty table gives an empty result.
    """
    bounded(docs)
    raw = picked(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sk = written(sketches(raw, shingle), "sketches")
    least = percent / 100 - 6 * float(np.sqrt(percent / 100 * (1 - percent / 100) / PERMS))
    known = sk.where("n > 0 and doc_id is not null")
    classes = written(known.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("members"), F.first("sig").alias("sig")), "classes")
    bands = classes.select("rep", "sig").mapInArrow(_bands, "h long, rep long")
    buckets = bands.groupBy("h").agg(F.min("rep").alias("c"), F.max("rep").alias("x")).where("c != x").drop("x")
    multi = written(bands.join(buckets, "h"), "buckets")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        sides = [classes.select(F.col("rep").alias(s), F.col("n").alias(f"n_{s}"), F.col("sig").alias(f"sig_{s}")) for s in "ab"]
        near = (
            pairs.join(sides[0], "a").join(sides[1], "b").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
            .select("a", "b", "sig_a", "sig_b").mapInArrow(_agreement(least), "a long, b long")
        )
        near = written(near, f"{name}-near")
        ids = written(near.select(F.col("a").alias("doc_id")).unionByName(near.select(F.col("b").alias("doc_id"))).distinct(), f"{name}-ids")
        texts = written(raw.join(maybe_broadcast(ids, MOST_IDS), "doc_id", "left_semi"), f"{name}-texts")
        full = near.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        links = written(full.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(shingle, percent), "a long, b long"), f"{name}-links")
        forget(near, ids, texts)
        return links

    star = confirmed(multi.where("rep != c").select(F.col("rep").alias("a"), F.col("c").alias("b")).distinct(), "star")
    # ids that repeat with different texts tie their classes together
    tied = known.join(classes.drop("sig", "members"), ["n", "d1", "d2"]).groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("a")).where("a != b").select("a", "b")
    first = star.unionByName(tied)
    comp = written(components(first), "components")
    placed = multi.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("h", "rep", F.coalesce("component", "rep").alias("comp"))
    sigs = classes.select("rep", "sig", "n")
    at = _met_in_blocks(placed, "h", F.lit(0), sigs.drop("n"))
    ties = written(at.mapInArrow(_spanning(least, shingle, percent, False), "a long, b long"), "ties")
    families = components(ties)
    families = written(families.unionByName(families.select(F.col("component").alias("node"), "component")).distinct().toDF("rep", "family"), "families")
    ids = families.select(F.col("rep").alias("doc_id"))
    texts = raw.join(maybe_broadcast(ids, MOST_IDS), "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), "text")
    comps = comp.withColumnRenamed("node", "rep")
    members = written(families.join(texts, "rep").join(sigs, "rep").join(comps, "rep", "left").select("family", "rep", F.coalesce("component", "rep").alias("comp"), "sig", "text", "n"), "members")
    rest = written(_met_in_blocks(members, "family", F.col("n")).drop("n").mapInArrow(_spanning(least, shingle, percent, True), "a long, b long"), "rest")
    forget(multi, ties, families, members)
    if rest.limit(1).count():
        comp = written(components(first.unionByName(rest)), "components")
    forget(star, rest)
    lead = classes.drop("sig").join(comp.withColumnRenamed("node", "rep"), "rep", "left").where("members > 1 or component is not null").select("n", "d1", "d2", F.coalesce("component", "rep").alias("comp"))
    out = sk.drop("sig").join(lead, ["n", "d1", "d2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("comp", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
