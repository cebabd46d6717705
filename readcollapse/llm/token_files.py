"""Token ids in files of shuffled byte planes.

A file is a run of chunks, each of CHUNK_IDS ids (the last may have fewer).  A chunk's ids, as unsigned 32-bit integers, are
transposed into four byte planes (all lowest bytes, then all second bytes, ...), and each plane is compressed with zstandard by itself; a
plane of zeros takes no bytes.  After the chunks come three index arrays, each compressed: the chunk index (offset, number of
ids and four plane sizes of every chunk), the documents' ids and their numbers of ids.  A trailer of fixed size says where they are, so any
range of ids is read with the index and the chunks it touches.

Files are written by one task each, in ascending doc_id order over all files, under names of their own in the shared folder:
what a lost or repeated task has left is in no manifest and is never read.

Defined results: null text has no ids of its own, only the end id; an empty table gives no files and an empty result; rows that
repeat a doc_id stand side by side, ordered by text; a null doc_id comes first; extra columns are ignored.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, map_arrow, scratch, text_slices

END_ID = 0
CHUNK_IDS = 1 << 16
LEVEL = 3
MAGIC = b"BPLANES1"
_TRAILER = struct.Struct("<QQQQ8s")  # where the chunk index, the ids and the counts begin, where they end
#: Distinct keys kept by a worker; beyond it the table starts anew.
MEMO = 500_000
#: White space of the pattern but for the space and the line end.
_SPACES = [chr(c) for c in (9, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_ASCII_SPACES = _SPACES[:4]
_MARKS = ".,;:!?$%&#*"
#: Stands between texts.
_CUT = "\0"
MANIFEST = "part int, file string, docs long, ids long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """The tokenizers library's ids, with those of words kept.

    In the byte-level pattern a single space or line end between two characters that are no white space always begins a
    token of its own or with the word after it, so words on either side are encoded alike wherever they stand.  Texts are
    split into keys (words, line ends, marks behind a word) and their distinct keys found by Arrow; each key is encoded by the library
    once, and a text's ids are gathered from those of its keys.
    Texts with other white space or an added token go to the library whole.  A special token's name in a text (such
    as <|endoftext|>) is that token if `added`, as in the library's plain call, and letters like any other if not.
    """

    def __init__(self, spec: str, added: bool = True):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        made = json.loads(spec)
        self.library.encode_special_tokens = not added
        # What the library cuts out of a text before anything else; unless `added`, that is not done to special ones.
        self.added = [t["content"] for t in made.get("added_tokens") or () if added or not t.get("special")]
        self.split = (made.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not made["pre_tokenizer"].get("add_prefix_space") and not made.get("normalizer") and (made.get("post_processor") or {}).get("type") in (None, "ByteLevel") and not any(c.isspace() for t in self.added for c in t)
        vocab = self.library.get_vocab()
        self.starts = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.starts[[i for t, i in vocab.items() if t[:1] == "Ġ"]] = True
        self.line = vocab.get("Ċ", -1)
        self._forget()

    def _forget(self) -> None:
        """Keys and their ids: `begin` and `size` say where a key's are in `ids`."""
        self.keys = {"": 0, "\r": 0, _CUT: 0, "\n": 1}
        self.ids, self.begin, self.size = np.array([max(self.line, 0)], "<u4"), np.zeros(2, np.int64), np.array([0, 1])

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")

    def _plain(self, text: str) -> str | None:
        """The text's keys between spaces: words, line ends, and (with a return in front) what begins the text or a line; None if the text has to go whole."""
        odd = _ASCII_SPACES if text.isascii() else _SPACES
        if "  " in text or "\n\n" in text or " \n" in text or text[0].isspace() or text[-1].isspace() or _CUT in text or any(c in text for c in odd) or any(t in text for t in self.added):
            return None
        return "\r" + text.replace("\n", " \n \r")

    def _learn(self, keys: list[str]) -> None:
        """Encodes new keys: words after a space, and (with a return in front) words that stand at a line's beginning or marks."""
        after_space, alone = [k for k in keys if k[0] != "\r"], [k[1:] for k in keys if k[0] == "\r"]
        if after_space:
            ids = self._ids(" " + " ".join(after_space))
            edges = np.flatnonzero(self.starts[ids])
            self._keep(after_space, ids, edges, np.append(edges[1:], len(ids)))
        if alone:
            ids = self._ids("\n".join(alone))
            edges = np.flatnonzero(ids == self.line)
            self._keep(["\r" + w for w in alone], ids, np.concatenate([[0], edges + 1]), np.append(edges, len(ids)))

    def _keep(self, keys: list[str], ids: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        if len(begin) != len(keys):
            raise ValueError("the tokenizer's words do not begin where they should")
        self.keys.update(zip(keys, range(len(self.size), len(self.size) + len(keys)), strict=True))
        self.begin, self.size = np.append(self.begin, begin + len(self.ids)), np.append(self.size, end - begin)
        self.ids = np.append(self.ids, ids)

    def _gathered(self, plain: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of texts that _plain() gave, and all their ids."""
        joined = pa.array([f" {_CUT} ".join([*plain, ""])], pa.large_string())
        # Marks behind a letter are a token sequence of their own, so they become a key.
        parted = pc.replace_substring_regex(joined, r"(\pL)([" + _MARKS + r"]+) ", "\\1 \r\\2 ")
        coded = pc.split_pattern(parted, " ").flatten().dictionary_encode()
        words, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        known = self.keys
        new = [w for w in words if w not in known]
        if new:
            self._learn(new)
        keys = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        size = self.size[keys].astype(np.int32)[index]
        stop = np.cumsum(size, dtype=np.int64)
        take = np.repeat(self.begin[keys][index] - stop + size, size)
        take += np.arange(stop[-1])
        return np.diff(stop[index == words.index(_CUT)], prepend=0), self.ids[take]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each text has, and the ids of all, one after another."""
        plain = [self._plain(t) if t and self.split else None for t in texts]
        fit = np.flatnonzero([p is not None for p in plain])
        count, ids = np.zeros(len(texts), np.int64), np.zeros(0, "<u4")
        if len(fit):
            count[fit], ids = self._gathered([plain[i] for i in fit])
        whole = {i: self._ids(t) for i, t in enumerate(texts) if t and plain[i] is None}
        if whole:
            cut = iter(np.split(ids, np.cumsum(count[fit])[:-1])) if len(fit) else iter(())
            parts = [next(cut) if plain[i] is not None else whole.get(i, ids[:0]) for i in range(len(texts))]
            count, ids = np.array([len(p) for p in parts], np.int64), np.concatenate(parts)
        if len(self.keys) > MEMO:
            self._forget()
        return count, ids


@lru_cache(maxsize=2)
def _encoder(spec: str, added: bool) -> Encoder:
    return Encoder(spec, added)


def _encoding(spark: SparkSession, tokenizer: str | None, end_id: int | None, added: bool):
    """What encode() does to batches (doc_id, text)."""
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        held = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(held.value, added)
        for batch in batches:
            for piece in text_slices(batch, "text"):
                count, ids = encoder.encode(piece.column("text").to_pylist())
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(count), end_id)
                    count += 1
                offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype("<i4")))], ["doc_id", "ids"])

    return run


def encode(docs: DataFrame, tokenizer: str | None = None, end_id: int | None = END_ID, added: bool = True) -> DataFrame:
    """(doc_id, ids array<int>) of docs (doc_id, text), in the order of its rows; the end id closes every document."""
    run = _encoding(docs.sparkSession, tokenizer, end_id, added)
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def pack_chunk(ids: np.ndarray, packer: zstandard.ZstdCompressor) -> list[bytes]:
    planes = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return [packer.compress(p.tobytes()) if p.any() else b"" for p in planes]


def unpack_chunk(planes: list[bytes], n: int) -> np.ndarray:
    opener = zstandard.ZstdDecompressor()
    out = np.zeros((4, n), np.uint8)
    for k, p in enumerate(planes):
        if p:
            out[k] = np.frombuffer(opener.decompress(p, max_output_size=n), np.uint8)
    return np.ascontiguousarray(out.T).view("<u4").ravel()


class FileWriter:
    """Chunks go out as they fill; only the open chunk and the index are held."""

    def __init__(self, stream):
        self.stream, self.at = stream, 0
        self.packer = zstandard.ZstdCompressor(level=LEVEL)
        self.open: list[np.ndarray] = []
        self.waiting, self.ids = 0, 0
        self.chunks: list[tuple] = []
        self.docs: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def _put(self, blob: bytes) -> int:
        self.stream.write(blob)
        self.at += len(blob)
        return len(blob)

    def add(self, docs: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(docs)
        self.counts.append(counts)
        self.open.append(ids)
        self.waiting += len(ids)
        self.ids += len(ids)
        if self.waiting >= CHUNK_IDS:
            held = np.concatenate(self.open)
            full = len(held) // CHUNK_IDS * CHUNK_IDS
            for at in range(0, full, CHUNK_IDS):
                self._chunk(held[at : at + CHUNK_IDS])
            self.open, self.waiting = [held[full:]], len(held) - full

    def _chunk(self, ids: np.ndarray) -> None:
        at = self.at
        self.chunks.append((at, len(ids), *(self._put(p) for p in pack_chunk(ids, self.packer))))

    def close(self) -> None:
        if self.waiting:
            self._chunk(np.concatenate(self.open))
        places = [self.at]
        for part in (np.array(self.chunks, "<i8").ravel(), np.concatenate([np.zeros(0, "<i8"), *self.docs]), np.concatenate([np.zeros(0, "<i8"), *self.counts])):
            self._put(self.packer.compress(part.astype("<i8").tobytes()))
            places.append(self.at)
        self._put(_TRAILER.pack(*places, MAGIC))


class FileReader:
    """Random access to a file by its index."""

    def __init__(self, stream):
        self.stream = stream
        size = stream.size()
        *places, magic = _TRAILER.unpack(stream.read_at(_TRAILER.size, size - _TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        opener = zstandard.ZstdDecompressor()
        index = [np.frombuffer(opener.decompress(stream.read_at(b - a, a)), "<i8") for a, b in zip(places, places[1:], strict=False)]
        self.chunks, self.docs, self.counts = index[0].reshape(-1, 6), index[1], index[2]
        self.first = np.concatenate([[0], np.cumsum(self.chunks[:, 1])])

    def chunk(self, k: int) -> np.ndarray:
        at, n, *sizes = self.chunks[k].tolist()
        blob = self.stream.read_at(sum(sizes), at) if sum(sizes) else b""
        edges = np.concatenate([[0], np.cumsum(sizes)])
        return unpack_chunk([blob[a:b] for a, b in zip(edges, edges[1:], strict=False)], n)

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the file; only the chunks that hold them are read."""
        a, b = np.searchsorted(self.first, start, "right") - 1, np.searchsorted(self.first, stop, "left")
        if stop <= start:
            return np.zeros(0, "<u4")
        return np.concatenate([self.chunk(k) for k in range(a, b)])[start - self.first[a] : stop - self.first[a]]


#: A null doc_id in the index.
_NULL = -(1 << 63)


def _writing(folder: str):
    """What write() does to batches (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part = context.partitionId() if context else 0
        fs, top = pafs.FileSystem.from_uri(folder)
        name, writer, stream, docs = f"{part:06d}-{uuid.uuid4().hex}.planes", None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                fs.create_dir(top, recursive=True)
                stream = fs.open_output_stream(f"{top}/{name}", compression=None)
                writer = FileWriter(stream)
            ids = batch.column("ids")
            writer.add(batch.column("doc_id").fill_null(_NULL).to_numpy().astype("<i8"), ids.value_lengths().to_numpy(zero_copy_only=False).astype("<i8"), ids.flatten().to_numpy(zero_copy_only=False).astype("<u4"))
            docs += batch.num_rows
        if writer is not None:
            writer.close()
            stream.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": pa.array([f"{folder}/{name}"]), "docs": pa.array([docs], pa.int64()), "ids": pa.array([writer.ids], pa.int64())})

    return run


def write(encoded: DataFrame, folder: str) -> DataFrame:
    """Writes one file for each partition of encoded (doc_id, ids), in its order; the manifest (part, file, docs, ids), stored."""
    return _stored(map_arrow(encoded.select("doc_id", "ids"), _writing(folder), MANIFEST))


def _stored(manifest: DataFrame) -> DataFrame:
    """One partition of a row a file.  All rows meet in one task, so if files are written again after a loss each is there once, under its last name."""
    return checkpoint(manifest.repartition(1))


def save(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, added: bool = True) -> DataFrame:
    """Encodes docs and writes them in ascending doc_id order over all files; returns the manifest.

    Texts are dealt by ranges of doc_id before they are encoded, so that finding the ranges encodes nothing.  Both steps share a
    Python worker: encode() and write() after each other would take two for each task.
    """
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    encoding, writing = _encoding(docs.sparkSession, tokenizer, END_ID, added), _writing(folder or scratch(docs.sparkSession, "tokens"))
    return _stored(map_arrow(ordered, lambda batches: writing(encoding(batches)), MANIFEST))


def _numbered(manifest: DataFrame) -> DataFrame:
    """(file, start) of every file, each a partition.  Files are numbered in one task: the manifest has a row a file."""
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start"))
    return files.repartition(max(1, manifest.count()))


def _reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What read() does to batches (file, start)."""
    for batch in batches:
        for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
            fs, path = pafs.FileSystem.from_uri(file)
            with fs.open_input_file(path) as stream:
                reader = FileReader(stream)
                begin = np.concatenate([[0], np.cumsum(reader.counts)])
                edges = np.append(np.flatnonzero(np.diff(begin[:-1] // (1 << 19), prepend=-1)), len(reader.docs))
                for a, b in zip(edges, edges[1:], strict=False):
                    ids = reader.read(int(begin[a]), int(begin[b])).astype("<i4")
                    offsets = pa.array((begin[a : b + 1] - begin[a]).astype(np.int32))
                    doc = reader.docs[a:b]
                    yield pa.RecordBatch.from_arrays([pa.array(doc, mask=doc == _NULL), pa.array(begin[a:b] + start), pa.ListArray.from_arrays(offsets, pa.array(ids))], ["doc_id", "start", "ids"])


def _digesting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What digest() does to batches (doc_id, start, ids)."""
    for batch in batches:
        ids = batch.column("ids")
        count = ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = memoryview(ids.flatten().to_numpy(zero_copy_only=False).astype("<i4").tobytes())
        edges = np.concatenate([[0], np.cumsum(4 * count)]).tolist()
        crc = [zlib.crc32(flat[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(count), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


_DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of every document in the files; start counts the ids of all documents before it."""
    return map_arrow(_numbered(manifest), _reading, "doc_id long, start long, ids array<int>")


def digest(stored: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what read() gives."""
    return map_arrow(stored, _digesting, _DIGEST)


def read_digest(manifest: DataFrame) -> DataFrame:
    """digest(read(...)) in one Python worker for each task instead of two."""
    return map_arrow(_numbered(manifest), lambda batches: _digesting(_reading(batches)), _DIGEST)
