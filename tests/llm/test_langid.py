import random
import zlib

import numpy as np

from voxlake.llm import langid as L


def corpus(n, seed=8):
    rng = random.Random(seed)
    parts = {"aa": "the an ing er tion".split(), "bb": "sch ein ung ß ü".split(), "cc": "eau qué oi tre".split()}
    rows = []
    for i in range(n):
        lang = rng.choice(list(parts))
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.choice([8, 60, 400]))), lang, "clash"))
    return rows


def test_held_out_accuracy_and_edges(spark):
    rows = corpus(700)
    odd = [(9001, None, "aa", ""), (9002, "", "aa", ""), (9003, "12 %% \n", "bb", ""), (None, "schein ung", None, ""), (9004, "ß" * 50_000, None, ""), (9005, "é", None, "")]
    got = {r.doc_id: r for r in L.op10_language_id(spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string")).collect()}
    held = [(got[i].lang_pred, lang) for i, _, lang, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, *_ in rows)
    assert np.mean([a == b for a, b in held]) > 0.97
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (9001, 9002, 9003))
    assert got[None].lang_pred == "bb" and not got[None].held_out and got[9004].lang_pred == "bb"
    assert all(0 <= r.score <= 1 for r in got.values())


def test_no_labels_and_empty_table(spark):
    schema = "doc_id long, text string, lang string"
    assert [r.lang_pred for r in L.op10_language_id(spark.createDataFrame([(1, "abc", None)], schema)).collect()] == ["und"]
    assert L.op10_language_id(spark.createDataFrame([], schema)).count() == 0


def test_windows_cover_all_bytes_and_tables_equal_the_convolution():
    for n in (0, 1, 3, 253, 256, 257, 509, 510, 5000):
        data = bytes(i % 251 for i in range(n))
        w, fresh = L.windows(data)
        assert fresh.sum() == max(n, 1) or n <= L.OVERLAP
        joined = b"".join([w[0].tobytes(), *(x[L.OVERLAP :].tobytes() for x in w[1:])])
        assert joined.rstrip(b"\0") == data.rstrip(b"\0")
    rows = corpus(60)
    net = L.train([r[1] for r in rows], [r[2] for r in rows], epochs=1)
    text = rows[0][1] * 3
    w, fresh = L.windows(text.encode())
    emb = net.embedding[w]
    conv = np.stack([sum(emb[:, i + j] @ net.taps[j] for j in range(4)) for i in range(L.LENGTH - L.OVERLAP)], 1) + net.bias
    z = np.maximum(conv.max(1), 0) @ net.dense + net.offset
    z -= np.log(np.exp(z).sum(1, keepdims=True))
    z = (z * fresh[:, None]).sum(0) / fresh.sum()
    want = np.exp(z) / np.exp(z).sum()
    assert np.allclose(L.classify([text, None], net, net.tables())[0], want, atol=1e-4)


def test_training_learns_whole_texts_of_a_bounded_sample(spark, monkeypatch):
    drawn = []
    monkeypatch.setattr(L, "train", lambda texts, labels: drawn.append((texts, labels)))
    rows = [(k, "ab cd " * 400, "xx", k) for k in range(300)] + [(None, "never learned", "yy", 0)] + [(2, f"again {k}", "xx", 0) for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, h long")
    L.learn(docs, 20)
    L.learn(docs, 300, 10 * 2400 + 100)
    assert [len(t) for t, _ in drawn] == [20, 10] and {"yy"}.isdisjoint(drawn[0][1]) and {len(t) for t, _ in drawn for t in t} <= {2400, 7, 8}


def test_results_of_the_query_against_a_plain_convolution(spark):
    rng = random.Random(2)
    words = {"aa": "the and house river over slow".split(), "bb": "der und haus fluss über straße".split()}
    rows = [(k, " ".join(rng.choice(words[lang]) for _ in range(rng.choice([1, 3, 30, 200]))), lang) for k, lang in ((k, rng.choice(["aa", "bb"])) for k in range(120))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = L.learn(docs)

    def plain(text):
        data, total, weight = text.encode(), np.zeros(len(net.labels)), 0
        step = L.LENGTH - L.OVERLAP
        n = max(1, -(-(len(data) - L.OVERLAP) // step))
        for w in range(n):
            piece = data[w * step : w * step + L.LENGTH].ljust(L.LENGTH, b"\0")
            best = np.full(len(net.bias), -np.inf)
            for at in range(step):
                best = np.maximum(best, net.bias + sum(net.embedding[piece[at + j]] @ net.taps[j] for j in range(4)))
            z = np.maximum(best, 0) @ net.dense + net.offset
            fresh = step if w < n - 1 else max(1, len(data) - w * step)
            total, weight = total + fresh * (z - np.log(np.exp(z).sum())), weight + fresh
        p = np.exp(total / weight)
        return p / p.sum()

    got = {r.doc_id: r for r in L.identify(docs, net).collect()}
    for doc_id, text, _ in rows[:40]:
        p = plain(text)
        assert abs(got[doc_id].score - p.max()) < 1e-4 and (got[doc_id].lang_pred == net.labels[int(p.argmax())] or p.max() < 0.5001)
