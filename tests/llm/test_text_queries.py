"""The registered queries: SQL where there is some, and what SQL cannot say on the small tables."""

import hashlib
import re
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from oracle import check, connect
from pulsecart.llm import bpe, licenses, queries
from test_duplicates import plain_components, plain_cut
from test_text_models import plain_spans

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def test_all_are_registered():
    assert entry_points.queries().keys() >= {*queries.QUERIES, "pipeline"}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_with_sql(spark, db, name):
    check(queries.QUERIES[name](spark, FOLDER), db, queries.SQL[name])


def test_language_on_the_held_out_fold(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = queries.op3_language(spark, FOLDER).collect()
    assert len(got) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)


def rows_by_id(spark, name):
    rows = queries.QUERIES[name](spark, FOLDER).collect()
    found = {r["doc_id"]: r for r in rows}
    assert len(found) == len(rows)
    return found


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def test_toxicity_of_every_document(spark, texts):
    got = rows_by_id(spark, "op1_toxicity")
    assert got.keys() == texts.keys()
    for key, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(key).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_secrets_of_every_document(spark, texts):
    got = rows_by_id(spark, "op2_secrets")
    assert got.keys() == texts.keys()
    for key, r in got.items():
        base = plain_spans(texts[key] or "")
        kinds = [x.split(":")[0] for x in base.split(",")]
        assert r["base_sha256"] == sha(base)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(kinds.count(k) for k in ("assign", "access", "hex"))
        spans = [x for x in r["spans"].split(",") if x]
        assert [x for x in spans if not x.startswith("literal")] == [x for x in base.split(",") if x]


def test_substrings_of_every_document(spark, texts):
    got, keys = rows_by_id(spark, "op4_substrings"), sorted(texts)
    for key, (size, removed, spans, kept) in zip(keys, plain_cut([texts[k] for k in keys], 100), strict=True):
        r = got[key]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (size, removed, spans, sha(kept))


def test_licenses_of_every_document(spark, texts):
    got = rows_by_id(spark, "op5_licenses")
    assert got.keys() == texts.keys()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for key, r in got.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (texts[key] or "").translate(lower))
        places = [
            (i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()
        ]
        labels = sorted({label for _, label in places})
        at = [i for i, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (
            len(w), len(places), min(at, default=None), max(at, default=None), ",".join(labels)
        )
        assert set(labels) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1
        assert r["labels"] == ",".join(sorted(set(r["labels"].split(","))))


def test_near_duplicates_of_every_document(spark, texts):
    got, keys = rows_by_id(spark, "op8_near_duplicates"), sorted(texts)
    sizes, label = plain_components([texts[k] for k in keys], 4, 80)
    for key, size, own in zip(keys, sizes, label, strict=True):
        r = got[key]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (size, keys[own], keys[own] == key)


def test_items_of_every_document(spark, texts):
    """Rows are within the distance, and every passage that stands unchanged is found."""
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").lower())
    got = {(r["doc_id"], r["item_id"]): r for r in queries.op7_decontaminate(spark, FOLDER).collect()}
    for r in got.values():
        assert r["distance"] <= len(split(items[r["item_id"]])) // 5
    for key, text in texts.items():
        line = f" {' '.join(split(text))} "
        for item, own in items.items():
            if f" {' '.join(split(own))} " in line:
                assert got[key, item]["distance"] == 0


def test_ids_of_every_document(spark, texts):
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = queries.vocabulary()
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    for key, r in rows_by_id(spark, "op6_bpe").items():
        ids = other.encode_ordinary(texts[key] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha(np.array(ids, dtype="<u4").tobytes()))


def test_encoding_round_trip(spark, texts):
    for r in queries.op6_bpe(spark, FOLDER).collect():
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()


def test_pipeline_keeps_clean_documents_once(spark, texts):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    ids = [r["doc_id"] for r in rows]
    assert len(ids) == len(set(ids)) and all(r["round_trip"] for r in rows)
    near = {r["doc_id"] for r in queries.neardup.classes(spark.read.parquet(f"{FOLDER}/documents.parquet")).where("not kept").collect()}
    leaks = {r["doc_id"] for r in queries.op7_decontaminate(spark, FOLDER).collect()}
    assert set(ids) >= set(texts) - near - leaks - {d for d, t in texts.items() if len(t or "") < 40}


def test_pipeline_on_odd_rows(spark, make):
    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (None, "some words here in the text", "en", "s", 27)]
    docs = make(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, FOLDER)
        assert docs.count() == 3
    empty = make([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, FOLDER)
    assert empty.count() == 0
