import gzip
import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import readcollapse.sources.fastq as source
from readcollapse.functions.records import numbered
from readcollapse.options import DedupOptions
from readcollapse.plans.pipeline import run
from readcollapse.sources.fastq import read_fastq, records, write_fastq


def fastq(path, rows):
    data = "".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in rows)
    (gzip.open(path, "wt") if str(path).endswith(".gz") else open(path, "w")).write(data)
    return str(path)


ROWS = [(f"r{i}", "ACGTN"[i % 5] * (i % 7), "I" * (i % 7)) for i in range(10_000)]


@pytest.mark.parametrize("suffix", ["", ".gz", ".bz2", ".xz", ".zst"])
def test_round_trip(spark, tmp_path, suffix):
    source = fastq(tmp_path / "in.fastq.gz", ROWS)
    target = str(tmp_path / f"out.fastq{suffix}")
    write_fastq(read_fastq(spark, [source]), [target])
    assert list(records(target)) == ROWS


@pytest.mark.parametrize("cut", [1, 7, 100, 1 << 20])
def test_plain_files_are_cut_anywhere(spark, tmp_path, monkeypatch, cut):
    rows = [(f"r{i} @x", "ACGT"[: i % 5], "@+I#"[: i % 5]) for i in range(40 if cut < 100 else 3000)]
    path = fastq(tmp_path / "a.fq", rows)
    for data in (open(path).read(), open(path).read()[:-1], open(path).read().replace("\n", "\r\n")):
        (tmp_path / "a.fq").write_bytes(data.encode())
        if cut >= 100:
            got = read_fastq(spark, [path], range_bytes=50 * cut).orderBy("rec_idx").collect()
            assert [(r["rec_idx"], *r["mates"][0]) for r in got] == [(i, *r) for i, r in enumerate(rows)]
    # Each range by itself, in buffers of any size.
    raw = data.encode()
    for size in (1, 13, 4 << 20) if cut < 100 else (4 << 20,):
        monkeypatch.setattr(source, "BUFFER", size)
        seen = []
        for start in range(0, len(raw), cut):
            for place, batch in source.range_records(pa.BufferReader(raw), len(raw), start, min(start + cut, len(raw)), raw[:start].count(b"\n"), "x"):
                seen += [(place + k, *r) for k, r in enumerate(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))]
        assert seen == [(i, *r) for i, r in enumerate(rows)]


def test_sets_of_plain_and_compressed_files(spark, tmp_path):
    a, b = fastq(tmp_path / "a.fq", ROWS[:500]), fastq(tmp_path / "b.fq.gz", ROWS[100:400])
    both = read_fastq(spark, [[a, a], [b, a], [b, b]], check_mates=False, range_bytes=3000)
    got = {(r["file_set"], r["rec_idx"]): [m["name"] for m in r["mates"]] for r in both.collect()}
    want = {(0, i): [ROWS[i][0]] * 2 for i in range(500)} | {(1, i): [ROWS[100 + i][0], ROWS[i][0]] for i in range(300)} | {(2, i): [ROWS[100 + i][0]] * 2 for i in range(300)}
    assert got == want


def members(path, data, cuts, pad=b""):
    """data as gzip members that end at the cuts."""
    raw = data.encode()
    path.write_bytes(b"".join(gzip.compress(raw[a:b], 1) + pad for a, b in zip([0, *cuts], [*cuts, len(raw)], strict=True)))
    return str(path)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_gzip_files_of_members_are_cut(spark, tmp_path, end):
    """Members end anywhere, also at other places for each mate, and some are empty; one task read such files."""
    one, two = ("".join(f"@{n}/{k}{end}{s}{end}+{end}{q}{end}" for n, s, q in ROWS) for k in (1, 2))
    a = members(tmp_path / "a.fq.gz", one, [*range(700, len(one), 700), len(one)])
    b = members(tmp_path / "b.fq.gz", two[: -len(end)], [5, 5, *range(1111, len(two) - 9000, 1111)], b"\0\0")
    short = members(tmp_path / "c.fq.gz", two[: two.index("@r5000/")], range(999, 50_000, 999))
    for paths, n in (([a, b], len(ROWS)), ([b, a], len(ROWS)), ([a, short], 5000), ([a], len(ROWS))):
        got = read_fastq(spark, paths, range_bytes=16 * 5000).withColumn("task", F.spark_partition_id()).orderBy("rec_idx").collect()
        assert [(r["rec_idx"], *[(m["name"][:-2], m["sequence"], m["qualities"]) for m in r["mates"]]) for r in got] == [(i, *[r] * len(paths)) for i, r in enumerate(ROWS[:n])]
        assert len({r["task"] for r in got}) > 2
    whole = gzip.open(fastq(tmp_path / "d.fq.gz", ROWS)).read()
    for bad in ((tmp_path / "a.fq.gz").read_bytes()[:-9], (tmp_path / "a.fq.gz").read_bytes() + b"x", gzip.compress(whole[:9000]) + gzip.compress(whole[9000:-4]) * 2):
        (tmp_path / "e.fq.gz").write_bytes(bad)
        with pytest.raises(Exception, match="gzip|stream|no FASTQ record|ended|differ in length"):
            read_fastq(spark, [str(tmp_path / "e.fq.gz")], range_bytes=16 * 5000).collect()


def test_a_gzip_header_inside_a_member_is_no_member(tmp_path):
    """Stored blocks show their data; ranges that begin there find what makes no chain, and the file is read whole."""
    inner = gzip.compress(b"x" * 50)
    outer = gzip.compress(b"y" * 500 + inner + b"y" * 500, 0)
    raw = outer + gzip.compress(b"z\n")
    rows = []
    for start in range(0, len(raw), 300):
        found = source._indexed(pa.BufferReader(raw), len(raw), start, min(start + 300, len(raw)))
        if found is not None:
            rows.append(dict(zip(("start", "begin", "end", "lines", "inside", "at", "before", "within"), (start, *found), strict=True)))
    assert any(r["begin"] == raw.index(inner, 1) for r in rows)
    assert source._chained(rows, len(raw)) is None
    true = [r for r in rows if r["begin"] in (0, len(outer))]
    assert source._chained(true, len(raw)) == ([(0, 0, 0), (len(outer), 0, 1)], 1)


def test_rows_in_order_are_written_as_they_are(spark, tmp_path):
    rows = numbered(spark.createDataFrame(ROWS, "name string, sequence string, qualities string").repartition(5), "name", in_order=True)
    rows = rows.select(F.lit(0).alias("file_set"), "rec_idx", F.array(F.struct("name", "sequence", "qualities")).alias("mates"))
    write_fastq(rows, [str(tmp_path / "o.fq.gz")], ordered=True)
    assert list(records(str(tmp_path / "o.fq.gz"))) == sorted(ROWS)
    for wrong in (rows.withColumn("rec_idx", -F.col("rec_idx")), rows.filter("rec_idx > 5000").union(rows.filter("rec_idx < 5000"))):
        with pytest.raises(Exception, match="not in order"):
            write_fastq(wrong, [str(tmp_path / "w.fq")], ordered=True)


def test_folders_of_parts(spark, tmp_path):
    source_path = fastq(tmp_path / "in.fq", ROWS)
    small = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(small, "false")
    for name in ("out.fastq.gz", "plain"):
        target = tmp_path / name
        write_fastq(read_fastq(spark, [source_path], range_bytes=20_000).repartition(3), [str(target)], parts=True)
        files = sorted(p.name for p in target.iterdir())
        assert len(files) > 1 and all(f.startswith("part-") for f in files)
        assert [r for f in files for r in records(str(target / f))] == ROWS
    spark.conf.unset(small)
    empty = tmp_path / "none.fq"
    write_fastq(read_fastq(spark, [source_path]).filter("false"), [str(empty)])
    assert list(records(str(empty))) == []


def test_mates_and_lengths(spark, tmp_path):
    a = fastq(tmp_path / "a.fq", [("x/1", "AC", "II"), ("y/1", "GG", "II"), ("z/1", "T", "I")])
    b = fastq(tmp_path / "b.fq", [("x/2", "TT", "II"), ("y/2", "CC", "II")])
    got = read_fastq(spark, [a, b]).orderBy("rec_idx").collect()
    assert [[m["sequence"] for m in r["mates"]] for r in got] == [["AC", "TT"], ["GG", "CC"]]
    both = read_fastq(spark, [[a, b], [a, b]])
    assert both.count() == 4 and both.select("file_set").distinct().count() == 2
    c = fastq(tmp_path / "c.fq", [("x/2", "TT", "II"), ("q/2", "CC", "II")])
    with pytest.raises(Exception, match="are not mates"):
        read_fastq(spark, [a, c]).collect()


def test_fasta_is_read_but_not_written(spark, tmp_path):
    path = tmp_path / "a.fa"
    path.write_text(">x one\nAC\nGT\n>y\nT\n")
    rows = read_fastq(spark, [str(path)])
    assert [(r["mates"][0]["name"], r["mates"][0]["sequence"], r["mates"][0]["qualities"]) for r in rows.orderBy("rec_idx").collect()] == [("x one", "ACGT", None), ("y", "T", None)]
    with pytest.raises(Exception, match="no qualities"):
        write_fastq(rows, [str(tmp_path / "o.fq")])


def test_broken_files(spark, tmp_path):
    for text in ("ACGT\n", "@x\nAC\n-\nII\n", "@x\nAC\n+\nI\n", "@x\nAC\n+\nII\n@y\nA\n", "@x\nAC\n+\nII\n\n", "@é\nA\n+\nI\n"):
        path = tmp_path / "x.fq"
        path.write_text(text)
        with pytest.raises(ValueError):
            list(records(str(path)))
        with pytest.raises(Exception, match="no FASTQ record|differ in length|ASCII"):
            read_fastq(spark, [str(path)]).collect()
    path.write_text("")
    assert read_fastq(spark, [str(path)]).count() == 0
    assert list(records(str(path))) == []


def test_whole_run(spark, tmp_path, caplog):
    good, bad = "IIIIII", "######"
    one = [("a/1", "AAAAAA", bad), ("b/1", "AAAAAA", good), ("c/1", "AAAAAA", good), ("d/1", "AAAAAC", good), ("e/1", "TTTTTT", good), ("f/1", "GGGGGG", bad)]
    two = [(n[0] + "/2", "CC" + s, q + "II") for n, s, q in one]
    paths = [fastq(tmp_path / "1.fq", one), fastq(tmp_path / "2.fq", two)]
    outs = [str(tmp_path / "o1.fq.gz"), str(tmp_path / "o2.fq.gz")]
    # Key: the first mate, and the last five letters of the second.
    job = run(spark, DedupOptions(slices=(slice(None), slice(-5, None)), max_distance=2, inputs=tuple(paths), outputs=tuple(outs)))
    # The first record of a kept key comes out although its own quality is low; a key without good records does not.
    assert [r[0] for r in records(outs[0])] == ["a/1", "e/1"] and [r[0] for r in records(outs[1])] == ["a/2", "e/2"]
    assert job.keys.count() == 3 and job.observed.get == {"total": 6, "discarded": 2}
    run(spark, DedupOptions(inputs=(paths[0],), outputs=(outs[0],), max_error_rate=1.0, method="highest_count"))
    assert [r[0] for r in records(outs[0])] == ["a/1", "e/1", "f/1"]
    assert json.dumps(outs)
