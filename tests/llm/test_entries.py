"""The registered queries themselves, on written tables, against brute force: every column of their contracts."""

import hashlib
import random
from collections import Counter

import pytest
import tokenizers

from storyspark.llm import packing, pii
from storyspark.plans.cutting import materialize
from tests.llm.test_filters import plain_statistics, plain_toxicity
from tests.llm.test_pairs_and_search import components, plain_fingerprint
from tests.llm.test_texts import pii_texts, plain_spans

KINDS = ("email", "ip", "card", "phone")


@pytest.fixture
def tables(spark, tmp_path):
    """Writes tables as a run finds them and gives their folder."""

    def write(**frames):
        for name, (rows, schema) in frames.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_op5_counts_and_digests(spark, tables):
    texts = {i: t for i, t in enumerate([*pii_texts(), "", None, "a@b.c 1.2.3.4 and x@y.z"])}
    sf = tables(documents=([(i, t, "en", "s", 0) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long"))
    got = {r.doc_id: r for r in pii.op5_pii(spark, sf).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        spans = plain_spans(t or "")
        base = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in spans) for n in range(4)], t
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))


def test_pipeline_stages_equal_the_long_way(spark, tables):
    """Each stage on what the one before it kept, against plain versions of all of them."""
    import corpus_pipeline

    r = random.Random(11)
    prose = [f"{a}{b}" for a in "ba de fi go lu ma ne po ri su".split() for b in "lan mer tin vos ker".split()]
    texts = {}
    for i in range(120):
        words = [r.choice(prose) for _ in range(r.randint(4 if i % 20 == 0 else 30, 60))]
        if i % 6 == 0:
            words[::4] = [r.choice(["vilemuck", "grotstain"]) for _ in words[::4]]
        if i % 10 == 3:
            words = words[:12] * 4
        if i % 8 == 5:
            words[3:3] = ["write", "to", f"u{i}@mail.org", "or", "+1 (408) 555-2485"]
        texts[i] = " ".join(words)
    texts |= {200 + i: texts[i] for i in range(0, 120, 7)} | {300: texts[1].upper(), 301: "", 302: None}
    marks = {i: int(i % 6 == 0) for i in range(120)}
    sf = tables(
        documents=([(i, t, "en", "s", None if t is None else len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long"),
        labels=([(i, 1, y) for i, y in marks.items()], "doc_id long, quality int, toxic int"),
    )
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    stages = dict(corpus_pipeline.STAGES)

    def stage(name, docs):
        out = stages[name](spark, docs, sf)
        if name != "packing":
            assert out.columns == corpus_pipeline.COLUMNS
        return materialize(out, name)

    docs = stage("toxicity", docs)
    score = plain_toxicity(texts, marks)
    left = {i: t for i, t in texts.items() if score[i] < 0.5}
    assert {x.doc_id: x.text for x in docs.collect()} == left and 20 < len(texts) - len(left) < 40

    docs = stage("quality_rules", docs)  # all labels are good: only the base rules reject

    def passes(t):
        n, _, _, _, repeated = plain_statistics(t or "")
        return n >= 10 and 100 * repeated <= 20 * n

    left = {i: t for i, t in left.items() if passes(t)}
    assert {x.doc_id: x.text for x in docs.collect()} == left

    docs = stage("simhash_dedup", docs)
    ids = sorted(left)
    groups = components([plain_fingerprint(left[i]) for i in ids])
    least = {g: min(i for i, h in zip(ids, groups, strict=True) if h == g) for g in groups}
    before, left = len(left), {i: left[i] for i in least.values()}
    assert {x.doc_id: x.text for x in docs.collect()} == left and len(left) < before - 5

    docs = stage("pii", docs)

    def mask(t):
        for s, k, e in reversed(plain_spans(t)):
            t = f"{t[:s]}[{KINDS[k].upper()}]{t[e:]}"
        return t

    left = {i: mask(t) for i, t in left.items()}
    assert {x.doc_id: (x.text, x.n_chars) for x in docs.collect()} == {i: (t, len(t)) for i, t in left.items()}
    assert any("[EMAIL]" in t and "[PHONE]" in t for t in left.values())

    rows = stage("packing", docs).collect()
    library = tokenizers.Tokenizer.from_file(packing.word_bpe_path())
    want = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in left.items()}
    got = Counter()
    for x in rows:
        got[x.doc_id] += x.length
    assert got == want
    whole = corpus_pipeline.run(spark, sf).select("doc_id", "start", "length", "ids_crc32").collect()
    assert {x.doc_id for x in whole} == set(left) and sum(x.length for x in whole) == sum(want.values())
