import random

import numpy as np
import pytest
from test_bpe import LIBRARY
from test_quality import corpus
from test_simhash import plain_components, plain_fingerprint

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    path = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, rng.choice(["en", "en", "en", "de", "fr", "es"]), f"src{i % 3}", len(t)) for i, t, _ in corpus(300)]
    quality = {i: q for i, _, q in corpus(300)}
    passage = " ".join(f"passage{rng.randrange(10**6)}" for _ in range(60)) + "."
    rows += [(1000 + k, f"Slowly walked {k} under the house river of {rng.random()}. " + passage, "en", "src0", 0) for k in range(3)]
    rows += [(2000 + k, rows[k][1], rows[k][2], "copy", 0) for k in range(20)]
    rows += [(3000, None, "en", "src0", 0), (3001, "", "de", "src0", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in quality.items() if i % 4], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, quality, passage


def test_each_stage_on_its_own_input(spark, folder):
    path, quality, passage = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    outs = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = spark.createDataFrame(stage(spark, docs, path).collect(), stage(spark, docs, path).schema)
        assert out.columns == columns or k == 4, name
        outs.append((docs, out))
        docs = out
    ids = lambda df: [r.doc_id for r in df.collect()]
    kept = set(ids(outs[0][1]))
    known = [i for i in quality if i in kept or i in set(ids(outs[0][0]))]
    assert np.mean([(i in kept) == bool(quality[i]) for i in known]) > 0.97 and {1000, 1001, 1002} <= kept
    before = [(r.doc_id, r.text) for r in outs[1][0].collect()]
    group = plain_components([i for i, _ in before], [plain_fingerprint(t) for _, t in before])
    assert sorted(ids(outs[1][1])) == sorted(set(group))
    assert not any(passage[50:450] in (r.text or "") for r in outs[2][1].collect()) and sorted(ids(outs[2][1])) == sorted(ids(outs[2][0]))
    mixed = ids(outs[3][1])
    assert set(mixed) >= {r.doc_id for r in outs[3][0].collect() if r.text}  # nothing with words is dropped
    source = {r.doc_id: r.text for r in outs[4][0].collect()}
    for r in outs[4][1].collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == LIBRARY.encode(source[r.doc_id] or "", add_special_tokens=False).ids


def test_run_has_the_rows_of_the_stages(spark, folder):
    path, _, _ = folder
    got = corpus_pipeline.run(spark, path)
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"] and got.count() > 150


ODD = "doc_id long, text string, lang string, source string, n_chars long, _key string, _hash long, _copies int, _copy int, _score double, row string, digest string, copies int"


def odd_rows():
    words = lambda k: " ".join(f"zq{k * 977 + j}" for j in range(40)) + "."
    rows = [(5, words(1)), (5, words(2)), (None, words(3)), (None, words(4)), (7, words(5)), (7, words(5)), (None, words(3)), (8, None), (9, ""), (None, "")]
    return [(i, t, "en", "s", 0, f"k{k}", k, k, k, float(k), "r", "d", 3) for k, (i, t) in enumerate(rows)]


@pytest.mark.parametrize("k", range(5))
def test_null_and_repeated_ids_and_clashing_columns(spark, folder, k):
    path, _, _ = folder
    docs = spark.createDataFrame(odd_rows(), ODD)
    out = corpus_pipeline.STAGES[k][1](spark, docs, path)
    assert k == 4 or out.columns == docs.columns
    got = out.collect()
    texts = [r[1] for r in odd_rows()]
    if k == 1:
        # one row of each group: five texts of their own, and one of the texts without words
        assert len(got) == 6 and {r.text for r in got if r.text} == {t for t in texts if t}
        assert all((r._key, r._hash) in {(f"k{i}", i) for i in range(10)} for r in got)
    if k == 2:
        # a text as long as a passage that occurs twice goes whole, both times
        left = ["" if t and len(t) >= corpus_pipeline.suffix_dedup.PASSAGE and texts.count(t) > 1 else t for t in texts]
        assert sorted(str(r.text) for r in got) == sorted(map(str, left)) and left != texts
    if k == 3:
        assert {str(r.text) for r in got} == set(map(str, texts)) and len(got) >= len(texts)
        assert {r._copies for r in got} == set(range(10))
    if k == 4:
        assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in got) == sorted((str(r[0]), LIBRARY.encode(r[1] or "", add_special_tokens=False).ids) for r in odd_rows())


@pytest.mark.parametrize("k", range(5))
def test_empty_table_in_every_stage(spark, folder, k):
    path, _, _ = folder
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.STAGES[k][1](spark, docs, path).count() == 0
