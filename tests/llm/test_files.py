import hashlib
import os
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import clashing, documents
from tokenizers import Tokenizer

from readcollapse.llm import queries, token_files, warc

TEXTS = ["", None, " ", "Hello world's end.", "a\nb\n\nc", "tab\there  two", "été ß 漢字 🙂", "<|endoftext|> text", "word " * 20_000 + "x", "\nstart", "end ", "x y z", "I'll 're it's"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(token_files.default_tokenizer())


def test_token_files(spark, library):
    rows = [(1000 - 7 * k, t, "en", "s") for k, t in enumerate(TEXTS * 3)]
    docs = clashing(documents(spark, rows)).repartition(6)
    manifest = token_files.save(docs)
    stored = token_files.read(manifest)
    got = {r["doc_id"]: r for r in token_files.digest(stored).collect()}
    ids = {r["doc_id"]: r["ids"] for r in stored.collect()}
    assert sorted(token_files.read_digest(manifest).collect()) == sorted(got.values())
    at = 0
    for i, t, *_ in sorted(rows):
        want = [*(library.encode(t, add_special_tokens=False).ids if t else []), 0]
        assert ids[i] == want and got[i]["start"] == at and got[i]["n_tokens"] == len(want)
        assert got[i]["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(want)}I", *want))
        at += len(want)
    repeated = documents(spark, [(5, "b", "", ""), (5, "a", "", ""), (None, "n", "", "")])
    back = token_files.digest(token_files.read(token_files.save(repeated))).orderBy("start").collect()
    assert [(r["doc_id"], r["start"]) for r in back] == [(None, 0), (5, 2), (5, 4)]
    assert token_files.digest(token_files.read(token_files.save(documents(spark, [])))).count() == 0


def lists(encoder, texts):
    count, ids = encoder.encode(texts)
    return [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])]


def test_words_are_encoded_as_in_their_text(library, monkeypatch):
    with open(token_files.default_tokenizer()) as f:
        encoder = token_files.Encoder(f.read())
    assert encoder.split
    rng = random.Random(1)
    letters = "ab c  \n\tdé's 12.,!*#漢🙂 \x1c x\r \0"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    texts += ["".join(rng.choice("ab cdé's12.,!\n ") for _ in range(rng.randint(0, 25))) for _ in range(4000)] + ["a <|endoftext|> b", None, ""]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert lists(encoder, texts) == want and sum(encoder._plain(t) is not None for t in texts if t) > 2000
    monkeypatch.setattr(token_files, "MEMO", 10)  # the table starts anew after each call
    assert [x for k in range(0, len(texts), 500) for x in lists(encoder, texts[k : k + 500])] == want
    letters_only = token_files.Encoder(encoder.library.to_str(), added=False)
    library_too = Tokenizer.from_file(token_files.default_tokenizer())
    library_too.encode_special_tokens = True
    assert lists(letters_only, ["x <|endoftext|> y"]) == [library_too.encode("x <|endoftext|> y", add_special_tokens=False).ids]


def test_added_tokens_are_encoded_as_by_the_plain_call(spark, tmp_path):
    plain = Tokenizer.from_file(token_files.default_tokenizer())
    texts = ["one <|endoftext|> two", "one two", "a<|endoftext|>b", "<|endoftext|>", "<|endoftext|>!", "x\n<|endoftext|>\ny", "<|endoftext |>", "<|endoftext|> <|endoftext|>", "two <|endoftext"]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [505, 220, 50256, 734]
    folder = tmp_path / "documents.parquet"
    documents(spark, [(k, t, "en", "s") for k, t in enumerate(texts)]).write.parquet(str(folder))
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in queries.op8_token_files(spark, str(tmp_path)).collect()}
    assert got == {k: (len(x) + 1, zlib.crc32(struct.pack(f"<{len(x) + 1}I", *x, 0))) for k, x in enumerate(want)}


def test_random_access(tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "CHUNK_IDS", 100)
    rng = np.random.default_rng(2)
    ids = np.concatenate([rng.integers(0, 50_000, 777), rng.integers(0, 2**32, 300), np.zeros(250)]).astype("<u4")
    with pa.OSFile(str(tmp_path / "x"), "wb") as f:
        writer = token_files.FileWriter(f)
        for k in range(0, len(ids), 61):
            part = ids[k : k + 61]
            writer.add(np.array([k]), np.array([len(part)]), part)
        writer.close()
    with pa.OSFile(str(tmp_path / "x"), "rb") as f:
        reader = token_files.FileReader(f)
        assert len(reader.chunks) == 14 and reader.counts.sum() == len(ids)
        for _ in range(60):
            a, b = sorted(rng.integers(0, len(ids) + 1, 2).tolist())
            assert (reader.read(a, b) == ids[a:b]).all()
    (tmp_path / "y").write_bytes(os.urandom(200))
    with pa.OSFile(str(tmp_path / "y"), "rb") as f, pytest.raises(ValueError):
        token_files.FileReader(f)


def test_warc_round_trip(spark):
    page = "<p>" + "é" * 600 + "</p>"
    rows = [(1, "http://a/", page), (2, "http://b/\r\nX: y", page), (9, None, page), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", "\r\n\r\nWARC/1.1\r\n" + "z" * 2000), (None, "u", page), (8, "u", "x" * 999), (10, "u", "x" * 999), (9, None, page)]
    pages = spark.createDataFrame([(*r, "x", "x") for r in rows], "page_id long, url string, html string, digest string, payload string")
    manifest = warc.write(warc.plan(pages.repartition(3)))
    for split in (300, 1 << 20):
        got = warc.read(manifest, split).collect()
        assert len(got) == len(rows)
        payloads = {(r["file"], r["offset"]) for r in got}
        assert len(payloads) == len(rows)
        for r in got:
            html = next(h for i, _, h in rows if i == r["page_id"])
            raw = (html or "").encode()
            revisit = html == page and r["page_id"] != 9
            assert (r["record_type"], r["refers_to"]) == (("revisit", 9) if revisit else ("response", None))
            assert r["payload_bytes"] == len(raw) and r["payload_digest"] == hashlib.sha1(raw).hexdigest()
            assert r["payload"] == (None if revisit else raw)
    empty = warc.write(warc.plan(pages.filter("false")))
    assert warc.read(empty).count() == 0


class Bytes:
    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        return self.data[at : at + n]


@pytest.mark.parametrize("level", [0, 4])
def test_ranges_give_every_record_once(monkeypatch, level):
    monkeypatch.setattr(warc, "LEVEL", level)
    monkeypatch.setattr(warc, "_READ", 512)
    rng = random.Random(3)
    digest = hashlib.sha1(b"").digest()
    inner = b"".join(warc.record(k, "in", b"inner", digest, None) for k in range(3))
    # At level 0 the payloads stand in the file as they are: archives inside an archive must not be taken for its records.
    payloads = [rng.choice([b"", b"p" * rng.randint(1, 3000), inner, warc.MAGIC * 20, rng.randbytes(700)]) for _ in range(40)]
    parts = [warc.record(k, "u", p, digest, None) for k, p in enumerate(payloads)]
    data, starts = b"".join(parts), np.cumsum([0, *map(len, parts)])[:-1].tolist()
    for step in (64, 333, 5000, len(data)):
        got = [x for a in range(0, len(data), step) for x in warc.members(Bytes(data), a, min(a + step, len(data)))]
        assert [at for at, _ in got] == starts
        assert [warc.parse(d)[1].partition(b"\r\n\r\n")[2] for _, d in got] == payloads


def test_damaged_archives_are_not_read_in_silence():
    digest = hashlib.sha1(b"").digest()
    parts = [warc.record(k, "u", random.Random(k).randbytes(200_000), digest, None) for k in range(4)]
    starts = np.cumsum([0, *map(len, parts)]).tolist()
    whole = b"".join(parts)
    for broken in (1, 2, 3):
        data = bytearray(whole)
        data[starts[broken] + 5000] ^= 1
        for step in (70_000, len(data)):
            with pytest.raises(ValueError, match="no record begins"):
                for a in range(0, len(data), step):
                    list(warc.members(Bytes(bytes(data)), a, min(a + step, len(data))))
