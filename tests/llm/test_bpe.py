import hashlib
import random
import tracemalloc
import unicodedata

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from voxlake.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
SOURCE = open(PATH, encoding="utf-8").read()
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.no_truncation()
LIBRARY.no_padding()


def want(text):
    e = LIBRARY.encode(text or "", add_special_tokens=False)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return len(e.ids), sha(np.array(e.ids, "<u4").tobytes()), sha(LIBRARY.decode(e.ids, skip_special_tokens=False).encode())


def texts():
    rng = random.Random(6)
    marks = ["<|endoftext|>", "<|startoftext|>", "'s", "'LL", "é", "É", "Å", "ﬁ", "ΣΑΣ", "İ", "日本", "٣", "½", "😀", "​", "́", "\x1c", "\x85", " ", "　", " ", "\t", "\n", " ", "  ", "Ab", "the", "1", "23", "%%%", "ß", "ǅ", "\x00", "_", "क्षि", "é", "힣", "가"]
    out = [None, "", " ", "<|endoftext|>", "a<|startoftext|><|endoftext|>b", "x" * 5000, "ab" * 3000, "!" * 2000, "the cat's 'tis they'll"]
    out += ["".join(rng.choice(marks) for _ in range(rng.randrange(1, 40))) for _ in range(400)]
    # characters that Unicode 3.2 knows: tables of different libraries disagree on newer ones
    old = lambda c: unicodedata.ucd_3_2_0.category(c) != "Cn"
    out += ["".join(c for c in map(chr, (rng.choice([rng.randrange(32, 127), rng.randrange(160, 1400), rng.randrange(0x2000, 0x3100)]) for _ in range(30))) if old(c)) for _ in range(400)]
    return out


def test_words_and_merges_as_the_library(spark):
    v = bpe.Vocabulary(SOURCE)
    for t in texts():
        ids = [i for w in v.words(t or "") for i in v.encode_word(w)]
        assert ids == LIBRARY.encode(t or "", add_special_tokens=False).ids, repr(t)
        assert v.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def answers(df):
    return sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op8_bpe(df, SOURCE).collect())


def test_query_with_blocks_of_any_size(spark, monkeypatch):
    rows = [(i % 590, t, "clash") for i, t in enumerate(texts())] + [(None, "no id", ""), (None, "none either", ""), (3, "twice twice", ""), (3, "twice twice", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    expected = sorted((str(d), *want(t)) for d, t, _ in rows)
    assert answers(docs) == expected
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(bpe, "ANSWER_ROWS", 50)
    monkeypatch.setattr(bpe, "ROW_WORDS", 20)
    assert answers(docs) == expected


def test_texts_of_one_id(spark):
    rows = [(d, t) for d in (None, 7) for t in ["word70213", "word251767", "word226440", "word231255", None, "", "word70213"] * 3]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert answers(docs) == sorted((str(d), *want(t)) for d, t in rows)


def test_one_word_in_every_text_and_one_very_long_text(spark):
    rows = [(k, f"the word{k % 50}") for k in range(3000)] + [(9999, " ".join(f"w{k % 7001}" for k in range(200_000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert answers(docs) == sorted((str(d), *want(t)) for d, t in rows)


def test_a_partition_that_is_read_in_another_order_raises(spark):
    source = spark.sparkContext.broadcast({"json": SOURCE})
    told = [b.to_pylist()[0] for b in bpe._packed_texts(source)(iter([bpe.pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["a b"]})]))]
    batch = bpe.pa.RecordBatch.from_pylist(told, schema=bpe._MET)
    with pytest.raises(RuntimeError):
        list(bpe._finished(source)(iter([batch])))


def test_another_splitter_is_refused():
    with pytest.raises(ValueError):
        bpe.Vocabulary(SOURCE.replace("'re|'ve", "'ve|'re"))


def test_empty_table(spark):
    assert bpe.op8_bpe(spark.createDataFrame([], "doc_id long, text string"), SOURCE).count() == 0


class Held:
    """What a worker reads of a broadcast."""

    def __init__(self, value):
        self.value = value


def test_a_block_holds_little_beside_its_words():
    # tracemalloc has numpy's arrays, the pool Arrow's
    rng = random.Random(8)
    known = [f"word{k}" for k in range(20_000)]
    rows = [" ".join(rng.choices(known, k=500)) for _ in range(bpe.BLOCK_ROWS)]
    batch = bpe.pa.RecordBatch.from_pydict({"doc_id": list(range(len(rows))), "text": rows})
    source = Held({"json": SOURCE})
    bpe._vocabulary(source)
    usual, pool = bpe.pa.default_memory_pool(), bpe.pa.proxy_memory_pool(bpe.pa.default_memory_pool())
    bpe.pa.set_memory_pool(pool)
    try:
        for run in (bpe._words, bpe._packed_texts):
            tracemalloc.start()
            before, n = pool.bytes_allocated(), sum(out.num_rows for out in run(source)(iter([batch])))
            held = tracemalloc.get_traced_memory()[1] + pool.max_memory() - before
            tracemalloc.stop()
            assert n and held < 1.5 * batch.nbytes, held / batch.nbytes
    finally:
        bpe.pa.set_memory_pool(usual)
