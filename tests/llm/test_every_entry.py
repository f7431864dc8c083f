"""Each query by its entry, on written tables with null, empty, equal and very long texts."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from storyspark.llm import registry
from tests.llm.test_filters import plain_statistics
from tests.llm.test_pairs_and_search import components, plain_fingerprint

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """The tables' folder and the texts by id; good texts have long words, toxic ones two marked words."""
    r = random.Random(21)
    prose = [a + b for a in "ba de fi go lu ma ne po ri su".split() for b in "lan mer tin vos ker".split()]
    texts = {}
    for i in range(150):
        words = [r.choice(prose) for _ in range(r.randint(20, 60))]
        if i % 5 == 0:
            words[::3] = [r.choice(["vilemuck", "grotstain"]) for _ in words[::3]]
        if i % 3 == 0:
            words[::2] = [r.choice(["#$", "||", "<>%"]) for _ in words[::2]]
        texts[i] = " ".join(words) + r.choice(["", "\n\n", ".\n"])
    texts |= {200: "", 201: None, 202: texts[7], 203: " ".join(r.choice(prose) for _ in range(30_000)), 204: "x" * 200_000, 205: texts[8].upper()}
    folder = str(tmp_path_factory.mktemp("entries"))
    docs = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 != 0), int(i % 5 == 0)) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    pages = [(0, "https://a.Example.NET/en/x?q", "h"), (1, "http://u.example.com/de/y", "h"), (2, "http://shop.org/fr/z#t", "h"), (3, None, "h"), (4, "no scheme", "h"), (5, "ftp://x.example.net/fr", "h")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder, texts


def run(spark, corpus, name):
    return registry.queries()[name](spark, corpus[0])


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_op1(spark, corpus):
    rows = {r.doc_id: r for r in run(spark, corpus, "op1_quality_rules").collect()}
    assert set(rows) == set(corpus[1])
    for i, t in corpus[1].items():
        if i in (203, 204):
            assert rows[i].n_words == len(t.split(" ")) and rows[i].word_chars == len(t.replace(" ", ""))
            continue
        want = plain_statistics(t or "")
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and (r.kept <= (not r.base_failed))


@pytest.mark.parametrize(("name", "cut", "label"), [("op3_quality_classifier", 0.3, lambda i: i % 3 != 0), ("op6_toxicity", 0.5, lambda i: i % 5 == 0)])
def test_op3_and_op6(spark, corpus, name, cut, label):
    rows = {r.doc_id: r for r in run(spark, corpus, name).collect()}
    assert set(rows) == set(corpus[1])
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= cut) and r.held_out == held_out(i) for i, r in rows.items())
    assert rows[202].score == rows[7].score
    fold = [i for i in range(150) if held_out(i)]
    assert sum(rows[i].predicted == label(i) for i in fold) >= 0.9 * len(fold)


def test_op4(spark, corpus):
    ids = sorted(corpus[1])
    fps = [plain_fingerprint(corpus[1][i]) for i in ids]
    groups = components(fps)
    least = {}
    for i, g in zip(ids, groups, strict=True):
        least.setdefault(g, i)
    want = {i: (f"{fp:016x}", least[g]) for i, fp, g in zip(ids, fps, groups, strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in run(spark, corpus, "op4_simhash").collect()} == want


def test_op7(spark, corpus):
    lib = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = {r.doc_id: r for r in run(spark, corpus, "op7_byte_bpe").collect()}
    for i, t in corpus[1].items():
        ids = lib.encode(t or "", add_special_tokens=False).ids
        decoded = lib.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        assert (rows[i].n_tokens, rows[i].ids_sha256, rows[i].decoded_sha256) == want


def test_op8(spark, corpus):
    lib = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {i: lib.encode(t or "", add_special_tokens=False).ids + [2] for i, t in corpus[1].items()}
    rows = run(spark, corpus, "op8_packing").collect()
    upto, windows = {}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == upto.get(r.doc_id, 0) and r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())
        upto[r.doc_id] = r.start + r.length
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert upto == {i: len(x) for i, x in ids.items()}
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096


def test_op10(spark, corpus):
    rows = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in run(spark, corpus, "op10_url_filter").collect()}
    assert rows == {
        0: ("a.example.net", "/en/x", "example.net/en/", "allow"), 1: ("u.example.com", "/de/y", "example.com/de/", "block"), 2: ("shop.org", "/fr/z", "org/fr/", "allow"),
        3: ("", "", None, "allow"), 4: ("", "", None, "allow"), 5: ("x.example.net", "/fr", "net/", "block"),
    }
