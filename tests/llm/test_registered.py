"""The registered queries over the smallest given tables: whole tables, the columns agreed, brute force or SQL."""

import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from test_dedup import components, removed, shingles
from test_models import words
from test_tokens import brute, check_packing

import __spark_entry__ as driver
import check
from tallysketch.llm import byte_bpe

QUERIES = driver.queries()


@pytest.fixture(scope="module")
def rows(spark, tables):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()]


def run(spark, tables, start):
    name = next(n for n in QUERIES if n.startswith(start))
    return QUERIES[name](spark, tables)


def held_out(i, modulus, rest):
    return zlib.crc32(str(i).encode()) % modulus == rest


@pytest.mark.parametrize("start, modulus, rest, threshold", [("op1_", 3, 1, 0.7), ("op4_", 5, 0, 0.3)])
def test_scores(spark, tables, rows, start, modulus, rest, threshold):
    found = run(spark, tables, start).collect()
    assert sorted(r.doc_id for r in found) == sorted(i for i, _ in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for r in found)
    assert all(r.held_out == held_out(r.doc_id, modulus, rest) for r in found)


def test_op2(spark, tables, rows):
    found = run(spark, tables, "op2_").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, found), key=repr) == removed(rows)


def test_op3(spark, tables, rows):
    found = run(spark, tables, "op3_").select("doc_id", "n_shingles", "component_id", "kept").collect()
    sets = {i: shingles(t) for i, t in rows}
    roots = components(sets, 85)
    assert sorted(map(tuple, found)) == sorted((i, len(s), roots[i], roots[i] == i) for i, s in sets.items())


def test_op5(spark, tables, rows):
    ranks = byte_bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = {r.doc_id: r for r in run(spark, tables, "op5_").collect()}
    for i, text in rows:
        ids = library.encode_ordinary(text or "")
        assert found[i].n_tokens == len(ids)
        assert found[i].ids_sha256 == byte_bpe.hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert found[i].decoded_sha256 == byte_bpe.hashlib.sha256((text or "").encode()).hexdigest()


def test_op6(spark, tables):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{tables}/embeddings.parquet").collect()]
    truth = brute(vectors, [v for v in vectors if v[0] % 100 == 0], 10)
    found = {tuple(r) for r in run(spark, tables, "op6_").select("query_id", "rank", "vec_id", "score").collect()}
    assert len(found) == len(truth)
    assert len({(q, o) for q, _, o, _ in truth} & {(q, o) for q, _, o, _ in found}) >= 0.9 * len(truth)


def test_op7(spark, tables, rows):
    found = run(spark, tables, "op7_").collect()
    assert len(found) == len(rows)
    lettered = {i for i, t in rows if any(c.isalpha() for c in t or "")}
    assert all((r.lang_pred != "und") == (r.doc_id in lettered) and 0 <= r.score <= 1 for r in found)
    assert all(r.held_out == held_out(r.doc_id, 4, 2) for r in found)


def test_op8(spark, tables, rows):
    found = run(spark, tables, "op8_").collect()
    used = check_packing(found, rows, 2048)
    assert used <= 1.02 * sum(r.length for r in found) / 2048 + 1


def test_op9(spark, tables):
    other = duckdb.connect()
    other.execute(f"CREATE VIEW documents AS SELECT * FROM '{tables}/documents.parquet'")
    mine = run(spark, tables, "op9_").toPandas()
    assert check.compare(mine, other.execute(driver.oracle_sql()["op9_exact_dedup"]).df()) == "same"


def test_op10(spark, tables, rows):
    found = {r.doc_id: r for r in run(spark, tables, "op10_").collect()}
    counts = {}
    for i, text in rows:
        if not held_out(i, 10, 0):
            for word in words(text):
                counts[word] = counts.get(word, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, text in rows:
        own, row = words(text), found[i]
        base = sum(np.log10((counts.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (
            held_out(i, 10, 0), len(own), sum(w in counts for w in own), n)
        assert abs(row.base_score - base) < 1e-6 * abs(base)
    unseen = [found[i] for i, _ in rows if held_out(i, 10, 0)]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_pipeline_is_registered(spark, tables, rows):
    found = QUERIES["pipeline"](spark, tables).collect()
    assert {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(found[0].asDict())
    assert {r.doc_id for r in found} < {i for i, _ in rows}
    assert not any(re.match("op[0-9]+_", n) is None and n != "pipeline" for n in QUERIES
                   if not QUERIES[n].__module__.startswith("tallysketch.plans"))
