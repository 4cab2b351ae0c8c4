"""Token-id output as Arrow files of equal-length sequences.

Documents are encoded in ascending id order, each followed by an end id, and their ids are laid end to end
and cut into sequences of ``length`` ids. Each shard is an Arrow IPC *file* whose record batches hold two
fixed-size-list columns, ``ids`` and ``mask`` (a bit each; 1: an id, 0: padding at the shard's end), all batches
but the last with the same number of sequences; so sequence k lies at a computed place and is read without copying.
A second Arrow file for each shard lists its documents. A manifest names the files of the attempts that
succeeded, so files of lost or repeated tasks are never read.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm import _text as T
from weirflow.llm._shared import bounded, filesystem, new_path, picked, pieces, qualified, text_bytes, written

LENGTH, BATCH = 2048, 64
#: Text bytes of a shard, about.
SHARD_BYTES = 64 << 20
#: Words whose ids and bytes a worker remembers, at some 50 bytes each; then it starts afresh.
MOST_WORDS = 600_000
#: Texts are encoded word by word: cuts lie between a character that is no white space and a space or line feed, over which no
#: pre-token of a byte-level BPE reaches, and between a letter and a mark. UTF-8 of white space (and of what some engines take for it), by bytes.
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 0x1C, 0x1D, 0x1E, 0x1F, 0x20]] = True
_BLANK_TWO = [0xC285, 0xC2A0]
_BLANK_THREE = [0xE19A80, 0xE1A08E, *range(0xE28080, 0xE2808C), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080]
_LEAD = np.zeros(256, bool)
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
#: A mark behind a letter starts a pre-token as well; not the apostrophe (contractions), nor what could begin an added token.
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "!,.:;?)]"]] = True
_PART = 4 << 20


def _cuts(data: np.ndarray) -> np.ndarray:
    """Where a space or line feed follows a character that is no white space, or a mark a letter; never in the first four bytes, whose past is unknown."""
    blank = _BLANK[data]
    out = np.zeros(len(data), bool)
    at = np.flatnonzero(_LEAD[data[:-2]]) if len(data) > 2 else np.zeros(0, np.int64)
    if len(at):
        two = data[at].astype(np.int64) << 8 | data[at + 1]
        blank[at[np.isin(two, _BLANK_TWO)] + 1] = True
        blank[at[np.isin(two << 8 | data[at + 2], _BLANK_THREE)] + 2] = True
    out[1:] = ((data[1:] == 32) | (data[1:] == 10)) & ~blank[:-1] | _MARK[data[1:]] & _LETTER[data[:-1]]
    out[:4] = False
    return out


def _gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes of spans, one after the other."""
    n = ends - starts
    return data[np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())]


class Encoder:
    """Ids of whole texts by the tokenizers library. The ids of words (with the spaces before them) are remembered, so each different word goes through the library once.

    Words are looked up by a 64-bit hash, and the bytes of every occurrence are held against those of the remembered word; texts
    in which two words share a hash go through the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.lib.get_vocab_size() <= 1 << 16 else "<u4")
        pre = self.lib.pre_tokenizer
        added = "".join(t.content for t in self.lib.get_added_tokens_decoder().values())
        self.by_word = getattr(pre, "add_prefix_space", None) is False and getattr(pre, "use_regex", None) is True and self.lib.normalizer is None and not set(added) & set(" \n!,.:;?)]")
        self._forget()

    def _forget(self) -> None:
        none = np.zeros(0, np.int32)
        self.known, self.place, self.size, self.flat = np.zeros(0, np.uint64), none, none, np.zeros(0, self.dtype)
        self.letters, self.start, self.stop = np.zeros(0, np.uint8), none, none

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = [], []
        for k in range(0, len(texts), 2048):
            got = [e.ids for e in self.lib.encode_batch_fast(texts[k : k + 2048], add_special_tokens=False)]
            sizes.extend(map(len, got))
            ids.append(np.fromiter(chain.from_iterable(got), self.dtype))
        return (np.concatenate(ids) if ids else self.flat[:0]), np.array(sizes, np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of several texts, one after the other, and how many each has."""
        if not len(data):
            return self.flat[:0], np.zeros(len(offsets) - 1, np.int64)
        if not self.by_word:
            return self._whole(data, offsets)
        return self._long(data) if len(offsets) == 2 and len(data) > 2 * _PART else self._words(data, offsets)

    def _whole(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._library([data[a:b].tobytes().decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])

    def _long(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One very long text, in parts."""
        at, out = 0, []
        while at < len(data):
            to = at + _PART
            while to < len(data):
                after = np.flatnonzero(_cuts(data[to : to + _PART]))
                if len(after):
                    to += int(after[0])
                    break
                to += _PART - 4
            to = min(to, len(data))
            out.append(self._words(data[at:to], np.array([0, to - at]))[0])
            at = to
        ids = np.concatenate(out)
        return ids, np.array([len(ids)])

    def _words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = _cuts(data)
        cut[0] = True
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        s = np.flatnonzero(cut)
        e = np.append(s[1:], len(data))
        h = T.spans_hash(data, s, e)
        every, first, back = np.unique(h, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, every), max(len(self.known) - 1, 0))
        new = self.known[at] != every if len(self.known) else np.ones(len(every), bool)
        if new.any():
            if len(self.known) + new.sum() > MOST_WORDS:
                self._forget()
                new[:] = True
            own = first[new]
            letters, n = _gathered(data, s[own], e[own]), e[own] - s[own]
            ids, sizes = self._library([data[a:b].tobytes().decode() for a, b in zip(s[own].tolist(), e[own].tolist(), strict=True)])
            keys, place = np.concatenate([self.known, every[new]]), np.concatenate([self.place, (len(self.flat) + np.cumsum(sizes) - sizes).astype(np.int32)])
            order = np.argsort(keys, kind="stable")
            self.known, self.place, self.size, self.flat = keys[order], place[order], np.concatenate([self.size, sizes.astype(np.int32)])[order], np.concatenate([self.flat, ids])
            stop = len(self.letters) + np.cumsum(n)
            self.start, self.stop, self.letters = np.concatenate([self.start, (stop - n).astype(np.int32)])[order], np.concatenate([self.stop, stop.astype(np.int32)])[order], np.concatenate([self.letters, letters])
            at = np.searchsorted(self.known, every)
        if not T.same_spans(data, s, e, self.letters, self.start[at][back], self.stop[at][back]).all():
            return self._whole(data, offsets)
        size = self.size[at][back].astype(np.int64)
        end = np.cumsum(size)
        ids = self.flat[np.repeat(self.place[at][back] - (end - size), size) + np.arange(end[-1])]
        before = np.concatenate([[0], end])[np.searchsorted(s, offsets, "left")]
        return ids, np.diff(before)


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _pair(ids: np.ndarray, length: int) -> list[pa.Array]:
    """Ids and mask of sequences; the last one is padded."""
    n = -(-len(ids) // length) * length
    mask = np.packbits(np.arange(n) < len(ids), bitorder="little")
    bits = pa.Array.from_buffers(pa.bool_(), n, [None, pa.py_buffer(mask)])
    return [pa.FixedSizeListArray.from_arrays(x, length) for x in (pa.array(np.pad(ids, (0, n - len(ids)))), bits)]


_INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
MANIFEST = "shard string, first_doc long, docs long, tokens long"


def _write(folder: str, tokenizer: str, end_id: int, length: int, per_batch: int):
    @T.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        enc = _encoder(tokenizer)
        kind = pa.from_numpy_dtype(enc.dtype)
        shard, out, index, first, docs, tokens, rest = uuid.uuid4().hex, None, None, None, 0, 0, bytearray()
        schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        block = length * per_batch * enc.dtype.itemsize

        def flush(last: bool) -> None:
            at = 0
            while len(rest) - at >= block:
                out.write_batch(pa.record_batch(_pair(np.frombuffer(bytes(rest[at : at + block]), enc.dtype), length), schema=schema))
                at += block
            del rest[:at]
            if last and rest:
                out.write_batch(pa.record_batch(_pair(np.frombuffer(bytes(rest), enc.dtype), length), schema=schema))

        sinks = []
        for b in batches:
            for part in T.batches_of(b, "text", 1 << 20):
                if out is None:
                    sinks = [fs.open_output_stream(f"{base}/{shard}.arrow"), fs.open_output_stream(f"{base}/{shard}.docs.arrow")]
                    out, index = pa.ipc.new_file(sinks[0], schema), pa.ipc.new_file(sinks[1], _INDEX)
                    first = part.column("doc_id")[0].as_py()
                ids, sizes = enc.encode(*T.strings(part.column("text")))
                full = np.full(len(ids) + len(sizes), end_id, enc.dtype)
                full[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes)] = ids
                sizes = sizes + 1
                starts = tokens + np.cumsum(sizes) - sizes
                tokens += len(full)
                rest += full.tobytes()
                flush(False)
                docs += part.num_rows
                index.write_batch(pa.record_batch([part.column("doc_id"), pa.array(starts), pa.array(sizes)], schema=_INDEX))
        if out is not None:
            flush(True)
            for x in (out, index, *sinks):
                x.close()
            yield pa.record_batch([[shard], pa.array([first], pa.int64()), [docs], [tokens]], names=["shard", "first_doc", "docs", "tokens"])

    return run


@dataclass
class Shard:
    """Random access to one shard's sequences; ids and masks are views of the mapped file where it is local."""

    folder: str
    name: str

    def __post_init__(self):
        self.fs, base = filesystem(self.folder)
        self.base = f"{base}/{self.name}"
        if isinstance(self.fs, pafs.LocalFileSystem):
            self.file = pa.ipc.open_file(pa.memory_map(f"{self.base}.arrow"))
        else:
            self.file = pa.ipc.open_file(self.fs.open_input_file(f"{self.base}.arrow"))
        self.length = self.file.schema.field("ids").type.list_size
        self.per_batch = self.file.get_batch(0).num_rows if self.file.num_record_batches else 0

    def __len__(self) -> int:
        n = self.file.num_record_batches
        return (n - 1) * self.per_batch + self.file.get_batch(n - 1).num_rows if n else 0

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of sequence k and its mask, eight to a byte from the lowest bit, both without copying. A length divisible by 8 is required."""
        batch = self.file.get_batch(k // self.per_batch)
        at = (k % self.per_batch) * self.length
        ids = batch.column("ids").flatten().to_numpy(zero_copy_only=True)[at : at + self.length]
        bits = np.frombuffer(batch.column("mask").flatten().buffers()[1], np.uint8)[at // 8 : (at + self.length) // 8]
        return ids, bits

    def tokens(self, start: int, n: int) -> np.ndarray:
        """Ids from place ``start`` of the shard, over as many batches as they reach."""
        each, out = self.per_batch * self.length, []
        while n > 0:
            flat = self.file.get_batch(start // each).column("ids").flatten().to_numpy(zero_copy_only=True)
            got = flat[start % each : start % each + n]
            out.append(got)
            start, n = start + len(got), n - len(got)
        return np.concatenate(out) if len(out) > 1 else out[0]

    def documents(self) -> Iterator[pa.RecordBatch]:
        with self.fs.open_input_file(f"{self.base}.docs.arrow") as f:
            index = pa.ipc.open_file(f)
            for k in range(index.num_record_batches):
                yield index.get_batch(k)


@dataclass
class TokenFiles:
    """The written files: their folder, and a frame of the shards in document order with the ids before each."""

    folder: str
    shards: DataFrame


def write_tokens(docs: DataFrame, *, tokenizer: str, end_id: int = 0, length: int = LENGTH, per_batch: int = BATCH, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> TokenFiles:
    """Encode all texts and write them as shards under ``folder`` (default: a new one in the shared folder).

    ``tokenizer`` is a file that every executor has at that path; ``length`` is divisible by 8. A null or empty text is its end id alone. Null ids come
    first; rows that repeat an id follow each other by text. Other columns are ignored. An empty table writes no shard.
    """
    if length % 8:
        raise ValueError("the length must be divisible by 8")
    spark = bounded(docs)
    folder = qualified(spark, folder or new_path(spark, "tokens"))
    rows = picked(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    n = max(pieces(text_bytes(rows), SHARD_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    manifest = written(rows.mapInArrow(_write(folder, tokenizer, end_id, length, per_batch), MANIFEST), "manifest")
    # one row for each shard, a bounded share of the input: the running sum is the driver's
    found = sorted(manifest.collect(), key=lambda r: (r.first_doc is not None, r.first_doc or 0, r.shard))
    before, out = 0, []
    for r in found:
        out.append((folder, r.shard, before))
        before += r.tokens
    shards = spark.createDataFrame(out, "folder string, shard string, before long")
    return TokenFiles(folder, shards.repartition(max(1, min(len(out), 4 * spark.sparkContext.defaultParallelism)), "shard"))


@T.trimmed
def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            shard = Shard(r["folder"], r["shard"])
            for docs in shard.documents():
                starts, sizes = docs.column("start").to_numpy(), docs.column("n_tokens").to_numpy()
                crc = [zlib.crc32(shard.tokens(s, n).astype("<u4").tobytes()) for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([docs.column("doc_id"), pc.add(docs.column("start"), r["before"]), docs.column("n_tokens"), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(files: TokenFiles) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens (with the end id) and ids_crc32 of its ids as little-endian 32-bit integers."""
    return files.shards.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
