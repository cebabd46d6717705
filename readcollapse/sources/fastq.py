"""FASTQ files as a Spark data source, and as a sink.

Plain files are cut into ranges of bytes.  Tasks first count the line ends of their ranges; what comes before each range then says on which line it
begins, and so which records begin in it and which places they have.  Mates in several plain files are read each by itself and joined by place.  Gzip
files of several members (as written here, and by bgzip) are cut too: tasks look for the members of their ranges and count lines, what they found is
held against the chain of members, and tasks then read mates in step from any member on.  Any other compressed file can only be read from its
beginning, so a set of mates of which any is one is read in step by one task; several sets are read by as many tasks.
"""

from __future__ import annotations

import bz2
import gzip
import io
import json
import lzma
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.records import mates_checked
from ..runtime import checkpoint, scratch, ship

RECORD = "struct<name:string,sequence:string,qualities:string>"
FIELDS = ["name", "sequence", "qualities"]
BATCH = 4096
#: Bytes that are read and parsed at once, and of a range of a plain file.
BUFFER = 4 << 20
RANGE = 64 << 20
#: Ranges of gzip files are smaller by this; in each so many members have their places kept.  Compressed bytes that are inflated at once.
PACKED, KEPT = 16, 8
CHUNK = 64 << 10
MAGIC = b"\x1f\x8b\x08"
COMPRESSED = (".gz", ".bz2", ".xz", ".zst")


def _located(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _opened(path: str) -> io.BufferedIOBase:
    """Decompressed bytes; the suffix tells how."""
    fs, place = _located(path)
    raw = fs.open_input_stream(place, compression=None)
    if path.endswith(".gz"):
        return gzip.open(raw)
    if path.endswith(".bz2"):
        return bz2.open(raw)
    if path.endswith(".xz"):
        return lzma.open(raw)
    if path.endswith(".zst"):
        return pa.CompressedInputStream(raw, "zstd")
    return raw


def packed(data: bytes, path: str) -> bytes:
    """data as a stream that may follow others in a file of this name."""
    if path.endswith(".gz"):
        return gzip.compress(data, 1, mtime=0)
    if path.endswith(".bz2"):
        return bz2.compress(data)
    if path.endswith(".xz"):
        return lzma.compress(data)
    if path.endswith(".zst"):
        import zstandard

        return zstandard.compress(data)
    return data


def _texts(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The strings that stand in data from begin to end."""
    size = end - begin
    stop = np.cumsum(size)
    taken = data[np.repeat(begin - stop + size, size) + np.arange(stop[-1] if len(stop) else 0)]
    offsets = np.concatenate([[0], stop]).astype(np.int32)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(taken))


def parsed(data: np.ndarray, ends: np.ndarray, path: str) -> pa.RecordBatch:
    """Records of a buffer of whole ones; ends: places of its line ends, four for each record."""
    begin = np.concatenate([[0], ends[:-1] + 1]).reshape(-1, 4)
    end = ends.reshape(-1, 4)
    # A return in front of a line end belongs to it.
    end = end - ((end > begin) & (data[end - 1] == 13))
    size = end - begin
    first = lambda column: np.where(size[:, column] > 0, data[np.minimum(begin[:, column], len(data) - 1)], 0)
    bad = np.flatnonzero((first(0) != 64) | (first(2) != 43) | (size[:, 1] != size[:, 3]))
    if len(bad):
        at = int(bad[0])
        name = bytes(data[begin[at, 0] : end[at, 0]])
        why = "sequence and qualities differ in length" if first(0)[at] == 64 and first(2)[at] == 43 else "no FASTQ record"
        raise ValueError(f"{path}: {why}: {name!r}")
    if len(data) and data.max() > 127:
        raise ValueError(f"{path}: must be ASCII encoded")
    return pa.RecordBatch.from_arrays([_texts(data, begin[:, 0] + 1, end[:, 0]), _texts(data, begin[:, 1], end[:, 1]), _texts(data, begin[:, 3], end[:, 3])], FIELDS)


def _fasta(stream, held: bytes) -> Iterator[pa.RecordBatch]:
    """Records without qualities; a sequence may take several lines."""
    rows, name, parts = [], None, []
    lines = io.TextIOWrapper(io.BufferedReader(_Rest(held, stream), BUFFER), "ascii", newline=None)
    batch = lambda: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1, 2)], FIELDS)
    for line in lines:
        if line[0] == ">":
            if name is not None:
                rows.append((name, "".join(parts), None))
            name, parts = line[1:].rstrip("\n"), []
            if len(rows) >= BATCH:
                yield batch()
                rows = []
        else:
            parts.append(line.strip())
    rows.append((name, "".join(parts), None))
    yield batch()


class _Rest(io.RawIOBase):
    """Bytes held, then those of a stream."""

    def __init__(self, held: bytes, stream):
        self.held, self.stream = held, stream

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        blob = self.held[: len(into)] if self.held else self.stream.read(len(into))
        self.held = self.held[len(blob) :] if self.held else b""
        into[: len(blob)] = blob
        return len(blob)


def batches(path: str) -> Iterator[pa.RecordBatch]:
    """(name, sequence, qualities) of a FASTQ or FASTA file from its beginning; a FASTA record's qualities are null."""
    with _opened(path) as stream:
        held = stream.read(BUFFER)
        if held[:1] == b">":
            yield from _fasta(stream, held)
        else:
            yield from _fastq(held, iter(lambda: stream.read(BUFFER), b""), path)


def _fastq(held: bytes, pieces: Iterator[bytes], path: str) -> Iterator[pa.RecordBatch]:
    """Records of the bytes held and those that follow, none of them empty, from the beginning of a record on."""
    while held:
        more = next(pieces, b"")
        if not more and held[-1:] != b"\n":
            held += b"\n"
        data = np.frombuffer(held, np.uint8)
        ends = np.flatnonzero(data == 10)
        whole = len(ends) // 4 * 4
        if not more and whole < len(ends):
            raise ValueError(f"{path}: no FASTQ record: {held[ends[whole - 1] + 1 if whole else 0 :][:80]!r}")
        if whole:
            stop = int(ends[whole - 1]) + 1
            yield parsed(data[:stop], ends[:whole], path)
            held = held[stop:]
        held += more


def records(path: str) -> Iterator[tuple[str, str, str | None]]:
    """(name, sequence, qualities) one by one."""
    for batch in batches(path):
        yield from zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)


class _Files(InputPartition):
    def __init__(self, number: int, paths: list[str]):
        self.number, self.paths = number, paths


class _Reader(DataSourceReader):
    def __init__(self, sets: list[list[str]]):
        self.sets = sets

    def partitions(self):
        return [_Files(i, paths) for i, paths in enumerate(self.sets)]

    def read(self, partition: _Files):
        yield from _in_step(partition.number, 0, None, [batches(p) for p in partition.paths])


def _in_step(number: int, place: int, stop: int | None, streams: list[Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Mates from `place` on, where all streams are, up to `stop` or the end of the shortest."""
    held: list = [None] * len(streams)
    while stop is None or place < stop:
        for i, stream in enumerate(streams):
            while held[i] is None or not held[i].num_rows:
                held[i] = next(stream, None)
                if held[i] is None:
                    return  # with the shortest file
        n = min(BATCH, *(h.num_rows for h in held), *([] if stop is None else [stop - place]))
        yield mated(number, np.arange(place, place + n), [h.slice(0, n) for h in held])
        held = [h.slice(n) for h in held]
        place += n


def mated(number: int, places: np.ndarray, mates: list[pa.RecordBatch]) -> pa.RecordBatch:
    """(file_set, rec_idx, mates) of batches of as many records."""
    n, width = len(places), len(mates)
    turn = pa.array(np.arange(n * width).reshape(width, n).T.ravel())
    columns = [pa.concat_arrays([m.column(i) for m in mates]).take(turn) for i in range(3)]
    offsets = pa.array(np.arange(0, (n + 1) * width, width), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, number), pa.int32()), pa.array(places, pa.int64()), pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, FIELDS))], ["file_set", "rec_idx", "mates"])


class FastqSource(DataSource):
    """spark.read.format("fastq"): option `paths`, a JSON list of the mates' files, or a list of such lists."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return f"file_set int, rec_idx bigint, mates array<{RECORD}>"

    def reader(self, schema) -> DataSourceReader:
        paths = json.loads(self.options["paths"])
        return _Reader(paths if paths and isinstance(paths[0], list) else [paths])


def _count_lines(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ranges (file_set, mate, path, start, stop) with the number of line ends in each."""
    for batch in rows:
        lines = []
        for path, start, stop in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "stop")), strict=True):
            fs, place = _located(path)
            with fs.open_input_file(place) as stream:
                lines.append(sum(int((np.frombuffer(stream.read_at(min(BUFFER, stop - at), at), np.uint8) == 10).sum()) for at in range(start, stop, BUFFER)))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lines, pa.int64())], [*batch.schema.names, "lines"])


def range_records(stream, size: int, start: int, stop: int, before: int, path: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(place of the first, records) of those that begin in bytes start to stop of a plain file; before: line ends in front of start."""
    # The first line that begins here; another range holds the beginning of what comes before it.
    inside = int(start > 0 and stream.read_at(1, start - 1) != b"\n")
    place = -(-(before + inside) // 4)
    skip, at = 4 * place - before, start  # line ends to pass until a record begins
    while skip:
        blob = stream.read_at(min(BUFFER, size - at), at)
        if not blob:
            return
        ends = np.flatnonzero(np.frombuffer(blob, np.uint8) == 10)
        got = min(skip, len(ends))
        skip -= got
        at += len(blob) if skip else int(ends[got - 1]) + 1
    read, held = at, b""
    while at < stop:
        blob = stream.read_at(min(BUFFER, size - read), read)
        read += len(blob)
        held += blob if blob or held[-1:] == b"\n" else b"\n"
        data = np.frombuffer(held, np.uint8)
        ends = np.flatnonzero(data == 10)
        whole = len(ends) // 4 * 4
        begins = np.concatenate([[0], ends[3:whole:4] + 1]) if whole else np.zeros(1, np.int64)
        whole = min(whole, 4 * int((at + begins < stop).sum()))
        if not whole:
            if not blob:
                raise ValueError(f"{path}: no FASTQ record: {held[:80]!r}")
            continue
        end = int(ends[whole - 1]) + 1
        yield place, parsed(data[:end], ends[:whole], path)
        place, at, held = place + whole // 4, at + end, held[end:]


def _read_ranges(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for number, mate, path, start, stop, before in zip(*(batch.column(c).to_pylist() for c in ("file_set", "mate", "path", "start", "stop", "before")), strict=True):
            fs, where = _located(path)
            with fs.open_input_file(where) as stream:
                for place, found in range_records(stream, stream.size(), start, stop, before, path):
                    for cut in range(0, found.num_rows, BATCH):
                        part = found.slice(cut, BATCH)
                        one = mated(number, np.arange(place + cut, place + cut + part.num_rows), [part])
                        yield pa.RecordBatch.from_arrays([one.column(0), pa.array([mate] * part.num_rows, pa.int32()), *one.columns[1:]], ["file_set", "mate", "rec_idx", "mates"])


def _plain(path: str) -> int | None:
    """The size of a plain FASTQ file, which can be cut; None for any other."""
    if path.endswith(COMPRESSED):
        return None
    fs, place = _located(path)
    with fs.open_input_file(place) as stream:
        return None if stream.read_at(1, 0) == b">" else stream.size()


def _cut(spark: SparkSession, files: list[tuple[int, int, str, int]], range_bytes: int) -> DataFrame:
    """(file_set, rec_idx, mates) of plain files (file_set, mate, path, size)."""
    kind = "file_set int, mate int, path string, start long, stop long"
    known = spark.createDataFrame(files, "file_set int, mate int, path string, size long").filter("size > 0")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))).alias("start")
    ranges = known.select("file_set", "mate", "path", "size", starts).select("file_set", "mate", "path", "start", F.least(F.col("start") + range_bytes, F.col("size")).alias("stop"))
    count = max(1, sum(-(-size // range_bytes) for *_, size in files))
    counted = checkpoint(ranges.repartition(count).mapInArrow(_count_lines, kind + ", lines long"))
    before = F.sum("lines").over(Window.partitionBy("file_set", "mate").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    placed = counted.withColumn("before", F.coalesce(before, F.lit(0))).drop("lines").repartition(count)
    read = placed.mapInArrow(_read_ranges, f"file_set int, mate int, rec_idx bigint, mates array<{RECORD}>")
    width = 1 + max((mate for _, mate, *_ in files), default=0)
    if width == 1:
        return read.drop("mate")
    # Places end with the shortest file.
    sides = [read.filter(F.col("mate") == i).select("file_set", "rec_idx", F.col("mates").alias(f"m{i}")) for i in range(width)]
    joined = reduce(lambda x, y: x.join(y, ["file_set", "rec_idx"]), sides)
    return joined.select("file_set", "rec_idx", F.concat(*(f"m{i}" for i in range(width))).alias("mates"))


def inflated(stream, size: int, at: int) -> Iterator[tuple[bytes, int | None]]:
    """Pieces of the data of gzip members from byte `at` on; with a member's last piece comes where the next one begins."""
    held = b""
    while at + len(held) < size or held:
        inflater, piece = zlib.decompressobj(31), b""
        while not inflater.eof:
            if not held:
                held = stream.read_at(min(CHUNK, size - at), at)
            got = inflater.decompress(held, BUFFER)
            if not held and not got:
                raise EOFError("a gzip member ends too early")
            if piece:
                yield piece, None
            piece, rest = got, inflater.unused_data if inflater.eof else inflater.unconsumed_tail
            at, held = at + len(held) - len(rest), rest
        # Zeros may follow a member.
        while True:
            if not held and at < size:
                held = stream.read_at(min(CHUNK, size - at), at)
            rest = held.lstrip(b"\0")
            at, held = at + len(held) - len(rest), rest
            if held or at >= size:
                break
        yield piece, at


_INDEX = "file_set int, mate int, start long, begin long, end long, lines long, inside int, at array<long>, before array<long>, within array<int>"


def _indexed(stream, size: int, start: int, stop: int) -> tuple | None:
    """What `_INDEX` says after `start` of the members that begin in bytes start to stop of a gzip file.

    inside: whether the data end within a line, -1 if there are none.  at, before, within: where some members begin, the line ends of this range
    in front of them, and whether they begin within a line (-1: as the ranges before end).  A member is believed whose checksum holds; end is -1 where
    the chain that begins with it breaks.
    """
    blob, found = stream.read_at(min(stop + len(MAGIC) - 1, size) - start, start), -1
    while True:
        found = 0 if found < 0 and start == 0 else blob.find(MAGIC, found + 1)
        if found < 0:
            return None
        begin = start + found
        lines, inside, marks, whole = 0, -1, [(begin, 0, -1)], False
        try:
            for piece, end in inflated(stream, size, begin):
                if piece:
                    lines, inside = lines + piece.count(b"\n"), int(piece[-1] != 10)
                if end is not None:
                    whole = True
                    if end >= stop:
                        break
                    if end - marks[-1][0] >= (stop - start) // KEPT:
                        marks.append((end, lines, inside))
        except (zlib.error, EOFError):
            if not whole and start:
                continue
            end = -1
        return begin, end, lines, inside, *map(list, zip(*marks, strict=True))


def _index(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        out = []
        for number, mate, path, start, stop in zip(*(batch.column(c).to_pylist() for c in ("file_set", "mate", "path", "start", "stop")), strict=True):
            fs, place = _located(path)
            with fs.open_input_file(place) as stream:
                if (found := _indexed(stream, stream.size(), start, stop)) is not None:
                    out.append((number, mate, start, *found))
        kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], [c.split()[0] for c in _INDEX.split(", ")])


def _chained(found: list, size: int) -> tuple[list[tuple[int, int, int]], int] | None:
    """(byte, line ends before, first place) of the members that a file's ranges tell of, and its number of lines; None unless they are one chain."""
    at, lines, inside, marks = 0, 0, 0, []
    for r in sorted(found, key=lambda r: r["start"]):
        if r["begin"] != at:
            return None
        marks += [(a, lines + b, -(-(lines + b + (inside if w < 0 else w)) // 4)) for a, b, w in zip(r["at"], r["before"], r["within"], strict=True)]
        at, lines = r["end"], lines + r["lines"]
        inside = inside if r["inside"] < 0 else r["inside"]
    return (marks, lines + inside) if at == size else None


def _from(path: str, at: int, skip: int) -> Iterator[pa.RecordBatch]:
    """Records of a gzip file after `skip` line ends from the member at byte `at` on."""

    def pieces() -> Iterator[bytes]:
        left = skip
        for piece, _ in inflated(stream, stream.size(), at):
            if left:
                ends = np.flatnonzero(np.frombuffer(piece, np.uint8) == 10)
                got = min(left, len(ends))
                left -= got
                piece = b"" if left else piece[int(ends[got - 1]) + 1 :]
            if piece:
                yield piece

    fs, place = _located(path)
    with fs.open_input_file(place) as stream:
        data = pieces()
        yield from _fastq(next(data, b""), data, path)


def _read_members(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for number, place, stop, paths, at, skip in zip(*(batch.column(c).to_pylist() for c in ("file_set", "place", "stop", "paths", "at", "skip")), strict=True):
            yield from _in_step(number, place, stop, [_from(*of) for of in zip(paths, at, skip, strict=True)])


def _packed_size(path: str, range_bytes: int) -> int | None:
    """The size of a gzip FASTQ file worth cutting: of several members, the first of which ends soon; None for any other."""
    if not path.endswith(".gz"):
        return None
    fs, place = _located(path)
    with fs.open_input_file(place) as stream:
        size = stream.size()
        if size <= range_bytes:
            return None
        first, read = b"", 0
        try:
            for piece, end in inflated(stream, size, 0):
                first, read = first or piece[:1], read + len(piece)
                if end is not None:
                    return size if end < size and first not in (b"", b">") else None
                if read > RANGE:
                    return None
        except (zlib.error, EOFError):
            return None  # read whole, it raises
    return None


def _cut_packed(spark: SparkSession, sets: dict[int, list[str]], sizes: dict[int, list[int]], range_bytes: int) -> tuple[DataFrame | None, list[int]]:
    """(file_set, rec_idx, mates) of sets of gzip files, and the numbers of sets whose members make no chain and that have to be read whole."""
    files = [(i, k, path, size) for i, paths in sets.items() for k, (path, size) in enumerate(zip(paths, sizes[i], strict=True))]
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))).alias("start")
    ranges = spark.createDataFrame(files, "file_set int, mate int, path string, size long").select("file_set", "mate", "path", "size", starts)
    ranges = ranges.select("file_set", "mate", "path", "start", F.least(F.col("start") + range_bytes, F.col("size")).alias("stop"))
    found: dict[tuple[int, int], list] = {(i, k): [] for i, k, *_ in files}
    for r in ranges.repartition(sum(-(-size // range_bytes) for *_, size in files)).mapInArrow(_index, _INDEX).collect():
        found[r["file_set"], r["mate"]].append(r)
    tasks, broken = [], []
    for i, paths in sets.items():
        chains = [_chained(found[i, k], size) for k, size in enumerate(sizes[i])]
        if None in chains:
            broken.append(i)
            continue
        marks, records = [m for m, _ in chains], min(lines // 4 for _, lines in chains)
        cuts, last = [0], 0
        for at, _, place in marks[0]:
            if at - last >= range_bytes and cuts[-1] < place < records:
                cuts.append(place)
                last = at
        firsts = [[place for *_, place in of] for of in marks]
        for place, stop in zip(cuts, [*cuts[1:], None], strict=True):
            near = [of[bisect_right(first, place) - 1] for of, first in zip(marks, firsts, strict=True)]
            tasks.append((i, place, stop, paths, [at for at, *_ in near], [4 * place - before for _, before, _ in near]))
    if not tasks:
        return None, broken
    rows = spark.createDataFrame(tasks, "file_set int, place long, stop long, paths array<string>, at array<long>, skip array<long>").repartition(len(tasks))
    return rows.mapInArrow(_read_members, f"file_set int, rec_idx bigint, mates array<{RECORD}>"), broken


def read_fastq(spark: SparkSession, paths: Sequence[str] | Sequence[Sequence[str]], check_mates: bool = True, range_bytes: int = RANGE) -> DataFrame:
    """(file_set, rec_idx, mates) of one set of files, or of several.  Mates whose names differ raise, if checked."""
    ship(spark)
    spark.dataSource.register(FastqSource)
    sets = [list(p) for p in paths] if paths and not isinstance(paths[0], str) else [list(paths)]
    sizes = [[_plain(p) for p in mates] for mates in sets]
    width = len(sets[0])
    cut = [(i, k, p, size) for i, (mates, known) in enumerate(zip(sets, sizes, strict=True)) if None not in known for k, (p, size) in enumerate(zip(mates, known, strict=True))]
    whole = [i for i, known in enumerate(sizes) if None in known]
    rows = _cut(spark, cut, range_bytes) if cut or not whole else None
    piece = max(1, range_bytes // PACKED)
    packed_sizes = {i: [_packed_size(p, piece) for p in sets[i]] for i in whole}
    packed_sizes = {i: known for i, known in packed_sizes.items() if None not in known}
    if packed_sizes:
        step, broken = _cut_packed(spark, {i: sets[i] for i in packed_sizes}, packed_sizes, piece)
        whole = [i for i in whole if i not in packed_sizes or i in broken]
        rows = rows if step is None else step if rows is None else rows.unionByName(step)
    if whole:
        step = spark.read.format("fastq").option("paths", json.dumps([sets[i] for i in whole])).load()
        step = step.withColumn("file_set", F.element_at(F.array(*map(F.lit, whole)), F.col("file_set") + 1))
        rows = step if rows is None else rows.unionByName(step)
    return rows.withColumn("mates", mates_checked(F.col("mates"))) if check_mates and width > 1 else rows


def write_fastq(rows: DataFrame, paths: Sequence[str], parts: bool = False, ordered: bool = False) -> None:
    """Writes mates (file_set, rec_idx, mates), in that order, one file for each mate; or, with `parts`, a folder of files in order for each.

    ordered: partitions and their rows are in that order already, as `numbered` leaves them, and are written as they are; rows that are not raise.

    Tasks pack their ranges of rows as streams of their own.  With `parts` those go into the folders, and no byte is written
    twice.  Else they lie in the shared folder, and one task for each mate appends them in order to a file beside the target and then puts it in the
    target's place; only where targets are on the driver's machine and tasks are not, the driver does that.  A record without qualities raises.
    """
    spark = rows.sparkSession
    ship(spark)
    names = list(paths)
    suffixes = [next((s for s in COMPRESSED if n.endswith(s)), "") for n in names]
    attempt = uuid.uuid4().hex
    folders = [f"{n.rstrip('/')}/_{attempt}" for n in names] if parts else [scratch(spark, "fastq")] * len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        made, streams, first, last = [], [], None, None
        for i, (folder, suffix) in enumerate(zip(folders, suffixes, strict=True)):
            fs, top = _located(folder)
            fs.create_dir(top, recursive=True)
            name = f"{part:06d}-{i}-{uuid.uuid4().hex}.fastq{suffix}"
            made.append(f"{folder}/{name}")
            streams.append(fs.open_output_stream(f"{top}/{name}", compression=None))
        for batch in batches:
            if not batch.num_rows:
                continue
            known = np.array([batch.column("file_set"), batch.column("rec_idx")], np.int64)
            begin, end = tuple(known[:, 0].tolist()), tuple(known[:, -1].tolist())
            step = np.diff(known)
            if (last is not None and begin < last) or ((step[0] < 0) | ((step[0] == 0) & (step[1] < 0))).any():
                raise ValueError("rows are not in order")
            first, last = first or begin, end
            for at in range(0, batch.num_rows, BATCH):
                mates = batch.column("mates").slice(at, BATCH)
                if pc.any(pc.not_equal(mates.value_lengths(), len(names))).as_py():
                    raise ValueError(f"a row does not have {len(names)} mates")
                flat = mates.flatten()
                columns = [flat.field(f) for f in FIELDS]
                if columns[2].null_count:
                    raise ValueError(f"{columns[0].filter(columns[2].is_null())[0].as_py()!r} has no qualities and cannot be written as FASTQ")
                lines = pc.binary_join_element_wise(pc.binary_join_element_wise("@", columns[0], ""), columns[1], "+", columns[2], "", "\n")
                if not pc.all(pc.string_is_ascii(lines)).as_py():
                    raise ValueError("must be ASCII encoded")
                for i, (stream, name) in enumerate(zip(streams, names, strict=True)):
                    # One string after another is what the values' buffer holds.
                    own = lines.take(pa.array(np.arange(i, len(lines), len(names))))
                    stream.write(packed(own.buffers()[2].to_pybytes()[: pc.sum(pc.binary_length(own)).as_py()], name))
        for stream in streams:
            stream.close()
        if last is not None:
            n = len(names)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part] * n, pa.int32()), "mate": pa.array(range(n), pa.int32()), "file": pa.array(made), "first": pa.array([list(first)] * n, pa.list_(pa.int64())), "last": pa.array([list(last)] * n, pa.list_(pa.int64()))})

    taken = rows if ordered else rows.repartitionByRange("file_set", "rec_idx").sortWithinPartitions("file_set", "rec_idx")
    taken = taken.select(F.col("file_set").cast("long"), F.col("rec_idx").cast("long"), "mates")
    # A row for each part and mate; they meet in one task, so each part is there once, under its last name.
    done = checkpoint(taken.mapInArrow(run, "part int, mate int, file string, first array<long>, last array<long>").repartition(1))

    def whole(mate: int, found: list[str]) -> None:
        fs, place = _located(names[mate])
        with fs.open_output_stream(place + ".part", compression=None) as out:
            if not found:
                out.write(packed(b"", names[mate]))
            for name in found:
                source, where = _located(name)
                with source.open_input_stream(where, compression=None) as stream:
                    while blob := stream.read(BUFFER):
                        out.write(blob)
        fs.move(place + ".part", place)

    def shown(mate: int, found: list[str]) -> None:
        """Files that count get their names; what lost tasks have left goes."""
        fs, top = _located(names[mate])
        for k, name in enumerate(found):
            fs.move(_located(name)[1], f"{top.rstrip('/')}/part-{k:06d}.fastq{suffixes[mate]}")
        held = _located(folders[mate])[1]
        if fs.get_file_info(held).type != pafs.FileType.NotFound:
            fs.delete_dir(held)

    files: list[list[str]] = [[] for _ in names]
    rows_of = done.orderBy("part", "mate").collect()
    if any(y["first"] < x["last"] for x, y in zip(rows_of, rows_of[len(names) :], strict=False)):
        raise ValueError("partitions are not in order")
    for r in rows_of:
        files[r["mate"]].append(r["file"])
    if parts:
        for mate, found in enumerate(files):
            shown(mate, found)
    elif spark.sparkContext._jsc.sc().isLocal() or all("://" in n and not n.startswith("file:") for n in names):

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for mate, found in zip(batch.column("mate").to_pylist(), batch.column("files").to_pylist(), strict=True):
                    whole(mate, found)
                yield batch.select(["mate"])

        rows_of = spark.createDataFrame(list(enumerate(files)), "mate int, files array<string>").repartition(len(names))
        rows_of.mapInArrow(join, "mate int").write.format("noop").mode("overwrite").save()
    else:
        with ThreadPoolExecutor(len(names)) as pool:
            list(pool.map(whole, range(len(names)), files))
