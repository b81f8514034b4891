"""The registered queries on the smallest given tables against plain Python."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest
from test_llm import all_spans, base_spans, components, fingerprint, jump, library  # noqa: F401

from factloom.llm import langid, quality, secrets, toxicity
from factloom.llm.queries import ORACLES, QUERIES, language_model, quality_model, toxicity_model

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables aren't here")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def result(spark, name):
    return QUERIES[name](spark, FOLDER).collect()


@pytest.mark.parametrize("name, folds, fold, bar, model, kind", [("op1_quality_fm", 3, 1, 0.5, quality_model, quality), ("op7_toxicity_zstd", 4, 2, 0.3, toxicity_model, toxicity)])
def test_classifiers(spark, texts, name, folds, fold, bar, model, kind):
    fitted = model(spark, spark.read.parquet(f"{FOLDER}/documents.parquet"), FOLDER)
    rows = {r["doc_id"]: r for r in result(spark, name)}
    assert rows.keys() == texts.keys()
    features = quality.Features() if kind is quality else fitted.scorer()
    for i, r in rows.items():
        score = fitted.score(features.row(texts[i])[None])[0] if kind is quality else fitted.score(features(texts[i]))
        assert abs(r["score"] - score) < 1e-5 and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= bar)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % folds == fold)


def test_shards(spark, texts):
    rows = result(spark, "op2_jump_shards")
    assert {r["doc_id"] for r in rows} == texts.keys()
    for r in rows:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 8, zlib.crc32(data), "key")
        assert (r["shard"], r["grown_shard"]) == (jump(r["doc_id"], 24), jump(r["doc_id"], 25))
    for shard in range(24):
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def digest(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def test_byte_bpe(spark, texts, library):  # noqa: F811
    for r in result(spark, "op3_byte_bpe"):
        text = texts[r["doc_id"]]
        ids, data, at, starts = library[0].encode_ordinary(text), text.encode(), 0, []
        for i in ids:
            starts.append(sum((b & 0xC0) != 0x80 for b in data[: at + 1]) - 1 if len(data) < 3000 else None)
            at += len(library[0].decode_single_token_bytes(i))
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), digest(",".join(map(str, ids))), digest(data))
        assert None in starts or r["starts_sha256"] == digest(",".join(map(str, starts)))


def test_simhash(spark, texts):
    prints = {i: fingerprint(t) for i, t in texts.items()}
    want = components(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in result(spark, "op4_simhash")} == {(i, f"{prints[i]:016x}", want[i]) for i in texts}


def test_vectors(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    ids, v = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype="f8")
    hits, near = [], {}
    for r in result(spark, "op5_nearest_neighbours"):
        near.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    w, want = np.floor(64 * v).astype("i8"), set()
    for q in ids[ids % 20 == 0].tolist():
        d = np.sqrt(((v - v[ids == q][0]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        if q % 100 == 0:
            hits += [ids[i] in near[q] for i in order]
            assert all(abs(s - d[ids == i][0]) < 1e-9 for i, s in near[q].items())
        score = w @ w[ids == q][0]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:20]
        want |= {(q, n, int(ids[i]), int(score[i])) for n, i in enumerate(order, 1)}
    assert np.mean(hits) >= 0.9 and {tuple(r) for r in result(spark, "op8_exact_top_k")} == want


def test_secret_scan(spark, texts):
    model = secrets.trained_model(spark, spark.read.parquet(f"{FOLDER}/documents.parquet"))
    said = lambda spans: ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in spans)
    for r in result(spark, "op6_secret_scan"):
        base = base_spans(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s[2] == k for s in base) for k in ("assign", "access", "hex")]
        assert r["base_sha256"] == digest(said(base)) and r["spans"] == said(all_spans(texts[r["doc_id"]], model))


def test_packing_and_counts(spark, texts, library):  # noqa: F811
    ids = {i: library[1].encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    for r in result(spark, "op10_token_counts"):
        n = len(ids[r["doc_id"]])
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 512)
    rows, used, tokens = result(spark, "op9_pack_sequences"), {}, {i: np.array([*x, 1], "<u4") for i, x in ids.items()}
    assert sum(r["length"] for r in rows) == sum(map(len, tokens.values()))
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used.get(r["sequence_id"], 0) and r["doc_tokens"] == len(tokens[r["doc_id"]])
        used[r["sequence_id"]] = r["offset"] + r["length"]
        assert r["ids_crc32"] == zlib.crc32(tokens[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())
    assert max(used.values()) <= 2048 and sum(used.values()) / (2048 * len(used)) > 0.9


@pytest.mark.parametrize("name", ["op8_exact_top_k", "op11_divergence_audit", "op13_hard_negatives"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    want, got = con.sql(ORACLES[name]), QUERIES[name](spark, FOLDER)
    assert want.columns == got.columns and sorted(want.fetchall()) == sorted(tuple(r) for r in got.collect())


def test_language_crf(spark, texts):
    rows = {r["doc_id"]: r for r in result(spark, "op12_language_crf")}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    fitted, langs = language_model(spark, docs, FOLDER), {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    assert rows.keys() == texts.keys()
    hits = []
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        if not any(c.isalpha() for c in texts[i]):
            assert r["lang_pred"] == "und"
        elif r["held_out"] and langs[i]:
            hits.append(r["lang_pred"] == langs[i])
        if len(texts[i]) < 2000:
            shares = langid._labelled([texts[i]], fitted).to_pylist()[0]["shares"]
            assert r["lang_pred"] == "und" or (fitted.langs[int(np.argmax(shares))] == r["lang_pred"] and abs(max(shares) - r["score"]) < 1e-5)
    assert np.mean(hits) > 0.97
