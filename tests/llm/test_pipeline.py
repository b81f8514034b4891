"""The pipeline's stages on the given tables and on awkward rows."""

import os

import pytest
from test_llm import all_spans

from factloom.llm import quality, queries, secrets
from factloom.session import ensure_checkpoint_dir

corpus_pipeline = pytest.importorskip("corpus_pipeline")
FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables aren't here")
STAGES = dict(corpus_pipeline.STAGES)
CLASH = ["_text", "_base", "_spans", "_score", "_whole_text", "_copy", "_digest", "row", "digest", "text ", "score_0", "predicted_0", "a.b", "comp", "node"]


@pytest.fixture(scope="module")
def awkward(spark):
    """Given documents with nulls, empties, repeated rows, two texts under one id, a very long text, and columns of any name."""
    source = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [tuple(r) for r in source.collect()]
    long = "x" * 20_000 + " " + "words of a very long text, " * 8_000
    rows += [(9001, None, "en", None, None), (9002, "", None, "s", 0), (None, "a row without an id", "en", "s", 19), rows[0], rows[0], (9003, long, "en", "s", None), (9004, "password = abcdefgh12345678 in 0123456789abcdef01", "en", "s", 1)]
    rows += [(9005, "one text of its own under a number", "en", "s", 1), (9005, "quite another one under the same number", "en", "s", 1)]
    names = [*source.columns, *CLASH]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema] + [f"`{c}` string" for c in CLASH])
    return spark.createDataFrame([(*r, *["clash"] * len(CLASH)) for r in rows], schema).select(*[f"`{c}`" for c in names])


def key(rows):
    return sorted(((r["doc_id"], r["text"]) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(STAGES)[:4])
def test_stages_keep_all_columns(spark, awkward, name):
    got = STAGES[name](spark, awkward, FOLDER)
    assert got.columns == awkward.columns
    rows = got.collect()
    assert all(r[c] == "clash" for r in rows for c in CLASH)
    before, ids = awkward.collect(), [r["doc_id"] for r in rows]
    assert STAGES[name](spark, awkward.where("doc_id < 0"), FOLDER).count() == 0
    if name == "secrets":
        assert len(rows) == len(before) and [r["text"] for r in rows if r["doc_id"] == 9004] == ["[SECRET] in [SECRET]"]
        assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows)
        return
    assert set(key(rows)) <= set(key(before))
    if name == "near_duplicates":
        assert len([i for i in ids if i == 9005]) == 2 and len(set(key(rows))) == len(rows) and None in ids
        assert sum((r["text"] or "") == "" for r in rows) == 1
        return
    model = (queries.toxicity_model if name == "toxicity" else queries.quality_model)(spark, awkward, FOLDER)
    if name == "toxicity":
        features = model.scorer()
        stays = lambda t: model.score(features(t)) < 0.3
    else:
        features = quality.Features()
        stays = lambda t: model.score(features.row(t)[None])[0] >= 0.5
    assert key(rows) == key([r for r in before if stays(r["text"] or "")])


def test_packing_of_awkward_rows(spark, awkward):
    pieces = STAGES["packing"](spark, awkward, FOLDER).collect()
    sizes = {}
    for p in pieces:
        sizes.setdefault(p["doc_id"], set()).add(p["doc_tokens"])
    assert sizes[9001] == sizes[9002] == {1} and None in sizes
    assert sorted(set(map(repr, sizes))) == sorted({repr(r["doc_id"]) for r in awkward.collect()})
    assert STAGES["packing"](spark, awkward.where("doc_id < 0"), FOLDER).count() == 0


def similar(texts):
    """Classes of texts by brute force: the index of the first of each."""
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)})
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    return label


def test_run_against_plain_python(spark):
    source = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs = sorted((r.asDict() for r in source.collect()), key=lambda r: r["doc_id"])

    def frame(rows):
        return spark.createDataFrame([tuple(r[c] for c in source.columns) for r in rows], source.schema)

    model = queries.toxicity_model(spark, source, FOLDER)
    features = model.scorer()
    docs = [r for r in docs if model.score(features(r["text"] or "")) < 0.3]
    model = queries.quality_model(spark, frame(docs), FOLDER)
    rows = quality.Features()
    docs = [r for r in docs if model.score(rows.row(r["text"] or "")[None])[0] >= 0.5]
    label = similar([r["text"] or "" for r in docs])
    docs = [r for i, r in enumerate(docs) if label[i] == i]
    model = secrets.trained_model(spark, frame(docs))
    for r in docs:
        out, at = [], 0
        for start, _, _, end in all_spans(r["text"] or "", model):
            if start >= at:
                out += [r["text"][at:start], "[SECRET]"]
            at = max(at, end)
        r["text"] = "".join(out) + r["text"][at:] if out else r["text"]
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r["doc_id"]: len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in docs}
    pieces = corpus_pipeline.run(spark, FOLDER).collect()
    assert {p["doc_id"]: p["doc_tokens"] for p in pieces} == want
    assert sum(p["length"] for p in pieces) == sum(want.values())
    left = [d for d in os.listdir(ensure_checkpoint_dir(spark).removeprefix("file:")) if d.startswith("pipeline-")]
    assert all(len(os.listdir(f"{ensure_checkpoint_dir(spark).removeprefix('file:')}/{d}")) == 1 for d in left)


def test_classifiers_are_fitted_in_a_task(spark, monkeypatch):
    from factloom.llm import labelled, toxicity
    from factloom.session import table

    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    for module, made, sample in ((toxicity, queries.toxicity_model, ("toxic", 4, 2)), (quality, queries.quality_model, ("quality", 3, 1))):
        want = module.fit(*labelled.labelled_sample(docs, labels, *sample, module.SAMPLE))
        assert repr(made(spark, docs, FOLDER)) == repr(want)
        assert repr(made(spark, docs.where("doc_id < 0"), FOLDER)) == repr(module.fit([], []))
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels: toxicity.Model(b"", b"", {}, [os.getpid(), len(texts)]))
    pid, n = queries.toxicity_model(spark, docs, FOLDER).weights
    assert pid != os.getpid() and n == len(labelled.labelled_sample(docs, labels, "toxic", 4, 2, toxicity.SAMPLE)[0])


def test_simhash_links_near_texts_by_itself(spark):
    import random

    import xxhash

    from factloom.llm import similar as near

    def fingerprint(text):
        w = text.split()
        hashes = [xxhash.xxh64_intdigest(" ".join(x), seed=42) for x in ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else ())]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    chance = random.Random(5)
    base = [[chance.choice("river stone tower bridge garden harbour lantern valley window copper".split()) + str(chance.randrange(90)) for _ in range(900)] for _ in range(6)]
    texts = [" ".join(w) for w in base] + [" ".join([*w[:k], "changed", *w[k + 1 :]]) for w in base for k in (0, 899)] + ["", "short text"]
    prints, label, close = [fingerprint(t) for t in texts], similar(texts), list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] == label[j] and (prints[i] ^ prints[j]).bit_count() <= 2:
                close = [min(close[i], close[j]) if x in (close[i], close[j]) else x for x in close]
    assert len(set(label)) == 8 and len(set(close)) < 14
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for recall, want in ((0.0, close), (0.998, label)):  # without MinHash keys, what lies within 2 bits; with them, all
        got = {r["doc_id"]: r["component_id"] for r in near.similar_documents(docs, recall=recall).collect()}
        assert got == dict(enumerate(want)), recall
