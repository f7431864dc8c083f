"""Personal data, byte BPE, packing, chat formatting, and the pipeline's stages."""

import hashlib
import random
import re
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyspark.llm import byte_bpe, chat_format, packing, pair_index, pii

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

ODD = ["", " ", "a<|endoftext|>b <|endoftext|>", "aaaaaaa bbbb'll DON'T İΣ ΑΣ", "\t\n x 　z \x1c\x1d", "𝔘½²³ ١٢٣ 中文 한국 é ‍👩", "\x00\x7f\r\n ", "<|startoftext|> x", "é" * 500, "word " * 3000, "՘ Ᲊ"]


def texts(n, seed=0):
    r = random.Random(seed)
    parts = ["Stein", "lich", "é", "'s", " ", "  ", "\n", "12", "!!", "für", "ß", "x", "Ab", "--"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 80))) for _ in range(n)] + ODD


def frame(spark, values):
    return spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(values)] + [(None, None, "x", 0), (0, values[0], "x", 0)], "doc_id long, text string, start string, ids int")


def test_word_ids_equal_the_library():
    """Texts cut as a whole and word by word, around every letter up to U+03FF, special tokens in either case."""
    lib = tokenizers.Tokenizer.from_file(packing.word_bpe_path())
    values = texts(200, 3) + [f"{chr(c)}{x}{chr(c)}a{chr(c)} {chr(c)}" for c in range(0x400) for x in ("", "A", "'", "1", ".")]
    values += ["x<|endoftext|>y", "X<|ENDOFTEXT|>y", "<|startoftext|> HI <|endoftext|>", "DON'T'S", "a\x1cb\x85c"]
    for t, ids in zip(values, packing.WordIds(packing.word_bpe_path()).encode_batch(values), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, t


def test_bpe_equals_the_library(spark):
    values = texts(300)
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    rows = byte_bpe.bpe_encode(frame(spark, values), path, ["doc_id"]).collect()
    assert len(rows) == len(values) + 2
    for r in rows:
        t = values[r.doc_id] if r.doc_id is not None else ""
        want = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want)
        assert r.decoded == lib.decode(want, skip_special_tokens=False)
    digests = byte_bpe.bpe_digests(frame(spark, values), path)
    for r in digests.filter("doc_id is not null").collect():
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(lib.encode(values[r.doc_id], add_special_tokens=False).ids, skip_special_tokens=False).encode()).hexdigest()
    assert byte_bpe.bpe_digests(frame(spark, values).limit(0), path).count() == 0


def test_bpe_memory_does_not_change_results(monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 5)
    bpe = byte_bpe.ByteBpe(public_tokenizers.path("byte_bpe_50k.json"))
    values = texts(60, 4)
    once = bpe.encode_batch(values)
    assert [bpe.encode_batch([v])[0] for v in values] == once
    assert [bpe.decode(x) for x in once] == values


def test_packing(spark):
    values = texts(400, 2)
    path = packing.word_bpe_path()
    lib = tokenizers.Tokenizer.from_file(path)
    df = frame(spark, values).repartition(3)
    rows = packing.pack(df, path, window=64).collect()
    ids = {i: lib.encode(t, add_special_tokens=False).ids + [2] for i, t in enumerate(values)}
    ids[None] = [2]
    docs, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        windows[r.sequence_id].append((r.offset, r.length))
    assert set(docs) == set(ids)
    for i, pieces in docs.items():
        times = 2 if i == 0 else 1
        assert sum(p[1] for p in pieces) == times * len(ids[i])
        for start, n, crc, total in pieces:
            assert total == len(ids[i]) and crc == zlib.crc32(np.array(ids[i][start : start + n], "<u4").tobytes())
        if times == 1:
            at = 0
            for start, n, *_ in sorted(pieces):
                assert start == at
                at += n
    padding = total = 0
    for pieces in windows.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 64
        total += at
        padding += 0 if at & (at - 1) == 0 else 64 - at
    assert padding < 0.02 * total
    assert packing.pack(df.limit(0), path).count() == 0


def test_words_of_every_script_without_the_library():
    """One text for a character: beside letters and digits, doubled, under an accent, next to its lower case; every ninth assigned one."""
    words = packing.WordIds(packing.word_bpe_path())
    lib = tokenizers.Tokenizer.from_file(words.path)
    known = [c for c in map(chr, range(0x80, 0x110000, 9)) if unicodedata.category(c) not in ("Cn", "Cs", "Co") and not packing.young_marks({c})]
    values = [f"a{c}b 1{c}{c}. é{c} {c}\u0301x {c.lower()}{c}" for c in known]
    values += ["ΟΔΟΣ ΣΑΣ. Σ", "ΌΔΌΣ τοῦ ΛΌΓΟΥΣ x", "Москва 中文字 テスト ﬁ ǅ", "กำ 한국어 각 1９２", "İstanbul İ"]
    want = [np.array(e.ids, "<u4").tobytes() for e in lib.encode_batch(values, add_special_tokens=False)]
    words.library = None  # a use of it fails
    assert len(known) > 5000 and words.encode_batch(values) == want


def test_young_marks_go_through_the_library():
    words = packing.WordIds(packing.word_bpe_path())
    values = ["\u1df6a\u0301\u0323 \U0001e4ec\u0301 Москва", "a\u0378b \U000e0fff]^-"]
    assert words.encode_batch(values) == [np.array(words.library.encode(v, add_special_tokens=False).ids, "<u4").tobytes() for v in values]
    assert packing.young_marks({"\u0301", "ж", "中", "a"}) == []


def test_word_memory_does_not_change_results(monkeypatch):
    """Words forgotten after each text, and the same words numbered anew."""
    lib = tokenizers.Tokenizer.from_file(packing.word_bpe_path())
    values = texts(80, 5) + ["x<|endoftext|>y Москва ab", "\u1df6a ab", "ab ab AB", ""]
    want = [np.array(e.ids, "<u4").tobytes() for e in lib.encode_batch(values, add_special_tokens=False)]
    monkeypatch.setattr(packing, "REMEMBERED", 5)
    words = packing.WordIds(packing.word_bpe_path())
    for _ in range(2):
        assert [words.encode_batch([v])[0] for v in values] == want
    assert words.encode_batch(values) == want and words.encode_batch([]) == []


def test_new_words_take_passes_by_length():
    """20,000 new words of up to 12 letters: a few rounds of pair look-ups for each length, not some for each rank."""
    r = random.Random(7)
    value = " ".join("".join(r.choice("etaoinshrdlucmwfgypbéß") for _ in range(r.randint(1, 12))) for _ in range(20_000))
    words = packing.WordIds(packing.word_bpe_path())
    found, calls = words.index.ranked, []
    words.index.ranked = lambda left, right: calls.append(len(left)) or found(left, right)
    ids = words.encode_batch([value])[0]
    assert len(calls) < 100
    assert np.frombuffer(ids, "<u4").tolist() == tokenizers.Tokenizer.from_file(words.path).encode(value, add_special_tokens=False).ids


def test_merges_by_length_equal_the_library():
    """Runs of one letter, random letters, other scripts, no bytes at all, and pieces around the bound of SHORT bytes, which go by the index."""
    r = random.Random(8)
    path = packing.word_bpe_path()
    lib = tokenizers.Tokenizer.from_file(path)
    pieces = ["a" * n for n in range(1, 140)] + ["".join(r.choice("aeinrstäß中ж") for _ in range(r.randint(1, 60))) for _ in range(600)] + ["", "é", "!" * 70, "xy" * 900]
    ids, sizes = pair_index.PairIndex(path).merge_by_length(pieces)
    assert sum(len(p.encode()) > pair_index.SHORT for p in pieces) > 50
    assert len(sizes) == len(pieces) and sizes.sum() == len(ids)
    for piece, got in zip(pieces, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
        assert got.tolist() == [i for part in packing.regex.findall(packing.WORD_PIECES, piece) for i in lib.encode(part, add_special_tokens=False).ids], piece
    assert [len(x) for x in pair_index.PairIndex(path).merge_by_length([])] == [0, 0]


@pytest.mark.parametrize("kind", ["smallint", "int", "decimal(10,0)", "string", "date"])
def test_packing_of_ids_of_any_type(spark, kind):
    ids = F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")) if kind == "date" else F.col("id").cast(kind)
    df = spark.range(6).select(F.when(F.col("id") != 3, ids).alias("doc_id"), F.lit("some words").alias("text"))
    rows = packing.pack(df, packing.word_bpe_path()).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in df.collect()} and sum(r.length for r in rows) == 18


def test_level_choice_minimises_squares():
    r = random.Random(0)
    for _ in range(300):
        p = packing.Packer(0, 16)
        for h in range(1, 16):
            p.count[h] = r.choice([0, 0, 1, 2, 5])
        size = r.randint(1, 15)

        def squares(level):
            c = p.count.copy()
            if level:
                c[level] -= 1
            if level + size < 16:
                c[level + size] += 1
            return int((c[1:16] ** 2).sum())

        options = [0] + [h for h in range(1, 17 - size) if p.count[h]]
        assert squares(p.level_for(size)) == min(map(squares, options))


def plain_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        check = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and check % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out)


def pii_texts():
    r = random.Random(7)
    parts = ["a@b.c", "x.y+1@mail-2.example.com", "@", "a@", "@b.c", "a@b", "..", ".", "1.2.3.4", "1.2.3.4.5", "300.1.1.1", "0001.2.3.4", "4539 1488 0343 6467", "4111111111111111", "4111-1111-1111-1112", "+1 (408) 555-2485", "+49.30.1234567", "+1", "é", " ", "_", "-", "12", "\n"]
    return ["".join(r.choice(parts) + r.choice(["", " ", ""]) for _ in range(r.randint(0, 14))) for _ in range(600)]


def test_base_spans_equal_the_patterns():
    for t in [*pii_texts(), "", "a@b.c_d@e.f", "x@y.z@w.v", "1" * 3000 + "@" + "a" * 3000 + ".b"]:
        assert pii.strict(t) == plain_spans(t), t


def test_contexts_find_unseen_identifiers(spark):
    r = random.Random(1)
    rows = [f"please ring me on +1 (408) 555-{r.randint(1000, 9999)} after lunch {i}" for i in range(30)]
    rows += ["please ring me on 408 555 1234 after lunch", "it cost 408 555 1234 in all", "nothing", "", None]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(rows)] + [(None, rows[30], "s"), (30, rows[30], "s")], "doc_id long, text string, spans string")
    got = pii.find_pii(df).collect()
    assert len(got) == len(rows) + 2
    for x in got:
        t = rows[x.doc_id if x.doc_id is not None else 30] or ""
        assert [tuple(s) for s in x.base] == plain_spans(t)
        more = [t[s.start : s.end] for s in x.spans if tuple(s) not in plain_spans(t)]
        assert more == (["408 555 1234"] if t == rows[30] else [])
    masked = {x.doc_id: x.text for x in pii.mask_documents(df, ["doc_id", "text"]).collect()}
    assert masked[0] == "please ring me on [PHONE] after lunch 0" and masked[30] == "please ring me on [PHONE] after lunch" and masked[31] == rows[31]
    assert masked[33] == "" and masked[34] is None
    assert pii.find_pii(df.limit(0)).count() == 0


HIDDEN = ["john at host.com", "john at host dot com", "john [at] host [dot] com", "john(at)host(dot)com", "john[at]host[dot]com", "john [ at ] host [ dot ] com", "john {at} mail.host.com", "john AT host DOT com", "john @ host . com"]


@pytest.mark.parametrize("hidden", HIDDEN)
def test_hidden_addresses_fill_a_slot_alone_in_their_text(hidden):
    for text in (f"write to {hidden}", f"write to {hidden}, please"):
        filled, places = pii.Slots([(0, "< write to")]).find(text, pii.strict(text))
        assert [text[s:e] for _, s, e, _, seed in filled if not seed] == [hidden] and places == [0]


def test_patterns_need_words():
    text = "a@b.c"
    assert pii.seeds_of(text, pii.strict(text)) == [] == pii.seeds_of(": a@b.c !!\n", [(2, 0, 7)])
    assert {x["pattern"] for x in pii.seeds_of("tel +1 408 5552485", [(4, 3, 18)])} == {"< \n tel"}


UNSEEN = {
    "email": ["john@localhost", "john at host dot com", "j.smith(at)mail(dot)example(dot)org", "ann [at] corp-mail [dot] net", "max_at_web_dot_de"],
    "ip": ["10,20,30,40", "fe80::1", "2001:db8:85a3::8a2e:370:7334", "192[.]168[.]1[.]10", "10 . 0 . 0 . 7"],
    "card": ["4539.1488.0343.6467", "4111/1111/1111/1111", "4539_1488_0343_6467", "4539 1488 0343 6460", "4111111111111112"],
    "phone": ["408 555 1234", "(408) 555-9876", "0049-30-123456", "030/1234567", "408.555.7777"],
}
PLACES = {"email": ("kindly write mail", "before noon today"), "ip": ("requests came from host", "during that night"), "card": ("please charge my card", "for this order"), "phone": ("you may ring me on", "after the lunch")}


def test_unseen_identifiers_are_found_in_confident_patterns_alone(spark):
    """All planted strings meet no base pattern; the same strings stand elsewhere as decoys, and so do plain words in the places."""
    r = random.Random(5)

    def card():
        d = [4] + [r.randint(0, 9) for _ in range(14)]
        total = sum(x if i % 2 else sum(divmod(2 * x, 10)) for i, x in enumerate(d))
        return "".join(map(str, [*d, -total % 10]))

    seeds = {"email": lambda: f"u{r.randint(0, 10**6)}@m{r.randint(0, 999)}.org", "ip": lambda: ".".join(str(r.randint(1, 255)) for _ in range(4)), "card": card, "phone": lambda: f"+1 ({r.randint(200, 999)}) 555-{r.randint(1000, 9999)}"}
    prose = "the of and to in is was for on that with as at by from it be this have an they which one you were her all she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must through back years where much your way well down should because each just those people".split()
    rows = []
    for kind, (before, after) in PLACES.items():
        rows += [f"{r.choice(prose)} {r.choice(prose)} {before} {seeds[kind]()} {after} {r.choice(prose)}" for _ in range(60)]
        rows += [f"{r.choice(prose)} {before} {r.choice(prose)} {after}" for _ in range(3)]
    planted = [(f"{PLACES[k][0]} {x} {PLACES[k][1]}", k, x) for k, xs in UNSEEN.items() for x in xs]
    decoys = [f"{r.choice(prose)} {r.choice(prose)} {x} {r.choice(prose)} {r.choice(prose)}" for xs in UNSEEN.values() for x in xs]
    texts = [t for t, _, _ in planted] + decoys + rows
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    extra = set()
    for x in pii.find_pii(df).collect():
        extra |= {(x.doc_id, pii.KINDS[s.kind], texts[x.doc_id][s.start : s.end]) for s in x.spans if s not in x.base}
    want = {(i, k, x) for i, (_, k, x) in enumerate(planted)}
    recall, precision = len(extra & want) / len(want), len(extra & want) / len(extra)
    assert recall == 1 and precision == 1, (recall, precision, want - extra, extra - want)


def test_passes_do_not_change_what_is_found(spark, monkeypatch):
    r = random.Random(2)
    rows = [f"kindly write mail: a{r.randint(0, 10**6)}@b{i}.com before noon" for i in range(40)] + ["kindly write mail: john@localhost before noon"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    want = sorted(map(str, pii.find_pii(df).collect()))
    monkeypatch.setattr(pii, "PATTERNS_AT_ONCE", 1)
    assert sorted(map(str, pii.find_pii(df).collect())) == want and any("start=19, kind=0, end=33" in x for x in want)


def test_confident_contexts_find_hidden_addresses(spark):
    r = random.Random(2)
    rows = [f"kindly write mail: a{r.randint(0, 10**6)}@b{i}.com !! before noon" for i in range(60)]
    rows += [f"kindly write mail: {x} !! before noon" for x in HIDDEN]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {x.doc_id: x.text for x in pii.mask_documents(df, ["doc_id", "text"]).collect()}
    assert set(got.values()) == {"kindly write mail: [EMAIL] !! before noon"} and len(got) == len(rows)


def plain_digest(turns):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)


def test_chat_format(spark):
    rows = [(1, 0, "system", "be [INST] kind"), (1, 1, "user", "hi \\ <s>"), (1, 2, "assistant", "</s>[x]\\e\\l"), (1, 3, "user", "more"), (1, 4, "assistant", ""), (1, 5, "user", "end\n")]
    rows += [(2, 0, "user", None), (3, 0, "assistant", "alone"), (4, 1, "b]a[d\\r", "x"), (4, 0, None, "y"), (5, 0, "user", "t"), (5, 0, "user", "t"), (None, 0, "assistant", "n"), (6, None, "user", "\U0001f600é"), (6, 1, "assistant", "a" * 50_000 + "<")]
    df = spark.createDataFrame([(*r, 1, "f") for r in rows], "conv_id long, turn long, role string, text string, target int, formatted string")
    got = {r.conv_id: r for r in chat_format.digests(chat_format.format_chats(df)).collect()}
    by = defaultdict(list)
    for c, n, role, text in rows:
        by[c].append((n is not None, n or 0, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == plain_digest([t[2:] for t in sorted(turns)])
    examples = chat_format.format_chats(df).filter("conv_id = 1 and target is not null").orderBy("target").collect()
    assert [x.target for x in examples] == [3, 5] and examples[1].formatted.startswith(examples[0].formatted)
    assert chat_format.digests(chat_format.format_chats(df.limit(0))).count() == 0


def test_pipeline_runs_on_the_smallest_tables(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert out.columns[0] == "doc_id"
    kept = out.select("doc_id").distinct()
    n = kept.count()
    assert 0.5 * docs.count() < n < docs.count() and kept.join(docs, "doc_id").count() == n
    assert out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).filter("n <> t").count() == 0
