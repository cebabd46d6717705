import re
from collections import Counter

import duckdb
import pytest
import sentencepiece
from helpers import clashing, documents

import __spark_entry__ as entry
import corpus_pipeline
from readcollapse.llm import language_id, mixing, near_dedup, secrets, sentencepiece_fst

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = clashing(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == columns, name
        docs = out.cache()
        seen.append(docs.count())
    all_docs, kept, redacted, mixed = seen
    assert all_docs == 200 and kept < all_docs and redacted == kept
    assert docs.filter("text rlike '[0-9a-f]{24,}'").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert last.count() == mixed and last.filter("size(ids) <> n_pieces").count() == 0


def redacted(text):
    """Every stretch that spans cover becomes one mark for each span that begins beyond what was covered before."""
    out, at = "", 0
    for _, start, end in secrets.find(text):
        if start >= at:
            out += text[at:start] + "[SECRET]"
        at = max(at, end)
    return out + text[at:]


def test_run_equals_stages_in_plain_python(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    accepted = language_id.accept(docs)
    assert {r["doc_id"] for r in accepted.collect()} == {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}
    kept = {r["doc_id"] for r in near_dedup.link(accepted).filter("kept").collect()}
    rows = [(r["doc_id"], redacted(r["text"] or ""), r["lang"], r["source"]) for r in accepted.collect() if r["doc_id"] in kept]
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(documents(spark, rows)).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.default_model())
    want = Counter()
    for i, text, _, _ in rows:
        ends = [m.end() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        whole, rest = divmod(taken[i], max(len(ends), 1))
        for part, times in ((text, whole if ends else 1), (text[: ends[rest - 1]] if rest else "", int(rest > 0))):
            want[i, tuple(library.encode(part))] += times
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, FOLDER).collect())
    assert got == +want


def test_queries_are_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names


@pytest.mark.parametrize("name", ["op2_source_mixing", "op3_exact_topk", "op5_secret_scan", "op6_embedding_near_dedup", "op9_warc"])
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    got, want = entry.queries()[name](spark, FOLDER), con.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    order = lambda rows: sorted(rows, key=str)
    assert columns == sorted(want.columns) and order(tuple(r[c] for c in columns) for r in got.collect()) == order(want.select(*columns).fetchall())
