"""Registered queries: SQL where there is any, brute force or the public libraries elsewhere, and the whole pipeline."""

import hashlib

import corpus_pipeline
import numpy as np
import pytest
from conftest import SF
from oracle_check import compare
from test_documents import brute_components, brute_groups

from ionloom.llm import queries
from ionloom.llm.queries import tokenizer
from ionloom.session import cut_lineage


@pytest.fixture(scope="module")
def texts(spark):
    return sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, duck, name):
    assert compare(queries.QUERIES[name](spark, SF), duck, queries.ORACLES[name]) is None


def digests(library, texts):
    out = set()
    for key, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.add((key, len(ids), sha(",".join(map(str, ids))), sha(back)))
    return out


def test_op1(spark, texts, library):
    assert set(map(tuple, queries.QUERIES["op1_bpe_round_trip"](spark, SF).collect())) == digests(library, texts)


def test_op4(spark, texts, library):
    import zlib

    at, want = 0, []
    for key, text in texts:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((key, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, queries.QUERIES["op4_token_files"](spark, SF).collect())) == want


def test_op6(spark, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    want = {(k, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for k, t in texts}
    assert set(map(tuple, queries.QUERIES["op6_token_count"](spark, SF).collect())) == want


def test_op8(spark, texts):
    assert sorted(map(tuple, queries.QUERIES["op8_jaccard_join"](spark, SF).collect())) == brute_components(texts)


def test_op9(spark, texts):
    rows = queries.QUERIES["op9_byte_shards"](spark, SF).collect()
    assert {r.doc_id for r in rows} == {k for k, _ in texts} and {r.law for r in rows} == {"bytes"}
    assert sum(r.size for r in rows) == sum(len((t or "").encode()) + 16 for _, t in texts)


@pytest.mark.parametrize("name", ["op2_quality_score", "op3_decontamination", "op10_language"])
def test_runs_over_the_whole_table(spark, texts, name):
    found = queries.QUERIES[name](spark, SF)
    if name != "op3_decontamination":
        assert found.count() == len(texts)
    else:
        items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
        exact = {(k, i) for k, t in texts for i, q in items.items() if q in (t or "")}
        assert exact <= {(r.doc_id, r.item_id) for r in found.collect()}


def test_pipeline_against_brute_force(spark, texts, library):
    """Stages whose effect brute force can say: copies, near copies, exact benchmark passages and token ids."""
    held = dict(texts)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "decontamination", "bpe"]
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.columns
        docs = cut_lineage(stage(spark, docs, SF))
        assert docs.columns == before
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    good, single, alone, clean = kept
    bad = {r.doc_id for r in queries.QUERIES["op2_quality_score"](spark, SF).collect() if r.predicted == 0}
    assert good == set(held) - bad
    rows = [(k, held[k]) for k in sorted(good)]
    assert single == {keep for _, keep, _ in brute_groups(rows)}
    rows = [(k, held[k]) for k in sorted(single)]
    assert alone == {c for *_, c in brute_components(rows)}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(q in held[k] for k in clean for q in items) and clean <= alone
    dropped = {r.doc_id for r in queries.QUERIES["op3_decontamination"](spark, SF).collect()}
    assert clean == alone - dropped
    got = set(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    assert got == digests(library, [(k, held[k]) for k in clean])
