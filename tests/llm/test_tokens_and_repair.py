"""Piece BPE, alignment of tokenizers, and conversation repair, against the libraries, brute force and SQL."""

import hashlib
import itertools
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from storyspark.llm import alignment, chat_repair, piece_bpe
from storyspark.llm.pair_index import byte_letters

P = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("tokenizers")

ODD = ["", None, " ", "  ", "\n \n", "a▁b", "<|endoftext|> </s><s><0x41>", "x  y\n z \t　w \xa0q);\r\n", " " * 400, "日本 語\x1c\x85z €𝔘", "word " * 3000, "ab" * 60_000, "\0x"]


def values(n, seed):
    r = random.Random(seed)
    pieces = [p.replace("▁", " ") for p in piece_bpe.load(piece_bpe.piece_path()).id_of]
    other = [" ", "  ", "\n", "\r", "\t", "　", "\xa0", "\x1c", "€", "𝔘", "a", "aa", "é", "'s", "12", "\0"]
    return ODD + ["".join(r.choice(pieces) if r.random() < 0.6 else r.choice(other) for _ in range(r.randint(1, 20))) for _ in range(n)]


def documents(spark, tmp_path, texts):
    rows = [(i, t, "x", 0) for i, t in enumerate(texts)] + [(None, None, "x", 0), (0, texts[0], "x", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, ids string, n_a int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_op11_equals_the_library(spark, tmp_path):
    texts = values(800, 1)
    lib = sentencepiece.SentencePieceProcessor(model_file=piece_bpe.piece_path())
    rows = piece_bpe.op11_piece_bpe(spark, documents(spark, tmp_path, texts)).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        t = (texts[r.doc_id] if r.doc_id is not None else "") or ""
        ids = lib.encode(t)
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want, t
    empty = piece_bpe.piece_encode(spark.createDataFrame([], "doc_id long, text string"), piece_bpe.piece_path(), ["doc_id"])
    assert empty.columns == ["doc_id", "ids", "n_tokens", "decoded"] and empty.count() == 0


def test_piece_tables_equal_the_library_on_runs_and_any_ids():
    lib = sentencepiece.SentencePieceProcessor(model_file=piece_bpe.piece_path())
    bpe = piece_bpe.PieceBpe(piece_bpe.piece_path())
    runs = [s * n for s in (" ", "▁", "a", "ab", "0", "=", "-", "lo") for n in range(70)] + [f"x{' ' * n}y" for n in range(70)]
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.encode_batch(runs)] == lib.encode(runs)
    r = random.Random(3)
    for _ in range(3000):
        ids = [r.randrange(32_000) if r.random() < 0.5 else r.randrange(300) for _ in range(r.randint(0, 8))]
        assert bpe.decode(np.array(ids, "<u4").tobytes()) == lib.decode(ids), ids


def test_piece_memory_does_not_change_results(monkeypatch):
    bpe = piece_bpe.PieceBpe(piece_bpe.piece_path())
    texts = [t or "" for t in values(60, 4)]
    once = bpe.encode_batch(texts)
    monkeypatch.setattr(piece_bpe, "PAIRS", 3)
    assert [bpe.encode_spaced([piece_bpe.SPACE + t.replace(" ", piece_bpe.SPACE) if t else ""], 2)[0] for t in texts] == once


def plain_alignment(texts):
    """Rows of the contract after doc_id, by comparing all tokens' ranges."""
    a_lib = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    back = {c: b for b, c in enumerate(byte_letters())}

    def b_bytes(i):
        p = b_lib.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode()

    found, total = [], Counter()
    for t in texts:
        whole = f" {t}".encode()
        a, b = (a_lib.encode(f" {t}", add_special_tokens=False).ids, b_lib.encode(t)) if t else ([], [])
        a_raw, b_raw = [bytes(back[c] for c in a_lib.id_to_token(i)) for i in a], [b_bytes(i) for i in b]
        if not t or b"".join(a_raw) != whole or b"".join(b_raw) != whole:
            found.append(None)
            continue
        a_end, b_end = np.cumsum([len(x) for x in a_raw]), np.cumsum([len(x) for x in b_raw])
        owner = [np.repeat(np.arange(len(x)), [len(y) for y in x]) for x in (a_raw, b_raw)]
        links = Counter((a[i], b[j]) for i, j in set(zip(owner[0].tolist(), owner[1].tolist(), strict=True)))
        cuts = sorted(set(a_end.tolist()) & set(b_end.tolist()))
        groups = [",".join(str(i) for i, e in zip(a, a_end, strict=True) if x < e <= y) + "|" + ",".join(str(i) for i, e in zip(b, b_end, strict=True) if x < e <= y) for x, y in zip([0, *cuts], cuts, strict=False)] if len(t) < 3000 else None
        total += links
        found.append((len(a), len(b), len(cuts), links, groups))
    best = Counter()
    for (_, b), n in total.items():
        best[b] = max(best[b], n)
    out = []
    for f in found:
        if f is None:
            out.append((0,) * 6 + ("",))
        else:
            n_best = sum(n for p, n in f[3].items() if total[p] == best[p[1]])
            out.append((f[0], f[1], f[2], sum(f[3].values()), n_best, sum(n * total[p] for p, n in f[3].items()), f[4] and ";".join(f[4])))
    return out


def test_op12_equals_brute_force(spark, tmp_path):
    texts = values(400, 2)
    want = plain_alignment([*texts, texts[0]])
    rows = alignment.op12_alignment(spark, documents(spark, tmp_path, texts)).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        w = want[r.doc_id] if r.doc_id is not None else (0,) * 6 + ("",)
        assert tuple(r)[1:7] == w[:6], (r.doc_id, w)
        assert w[6] is None or r.groups_sha256 == (hashlib.sha256(w[6].encode()).hexdigest() if w[0] else ""), r.doc_id


def test_alignment_in_small_windows_with_rare_pairs_joined(spark):
    texts = [t for t in values(150, 5) if t is None or len(t) < 3000]
    want = plain_alignment(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(2)
    paths = P.path("byte_bpe_50k.json"), piece_bpe.piece_path()
    rows = alignment.materialize(alignment.align_tokens(docs, *paths, ["row"], window=3), "rows")
    for r in alignment.with_counts(rows, head=50).collect():
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) == want[r.row], texts[r.row]
    assert alignment.align_tokens(docs.limit(0), *paths, ["row"]).count() == 0


def brute_repair(initials, faults):
    """The lightest (cost, audit) over all edits with at most two insertions in a place."""
    import re

    best = None
    for gaps in itertools.product(("", "u", "a", "ua", "au"), repeat=len(initials) + 1):
        for edits in itertools.product("KDUA", repeat=len(initials)):
            cost, audit, roles = 5 * len(gaps[0]), "I" * len(gaps[0]), gaps[0]
            for e, c, f, gap in zip(edits, initials, faults, gaps[1:], strict=True):
                if e != "D" and f in "bd":
                    break
                cost += {"K": 0, "D": 2}.get(e, 1) + 5 * (f == "t" and e != "D") + 5 * len(gap)
                audit += ("R" if e in "UA" else e) + "I" * len(gap)
                roles += ("" if e == "D" else c if e == "K" else e.lower()) + gap
            else:
                if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                    best = (cost, audit)
    return best


def test_lightest_derivations_equal_all_edits():
    r = random.Random(7)
    for n in (0, 1, 1, 2, 2, 2, 3, 3, 3, 3):
        for _ in range(4):
            initials, faults = "".join(r.choice("usax") for _ in range(n)), "".join(r.choice("ooootbd") for _ in range(n))
            found = chat_repair.derive(initials, faults, chat_repair.EMPTY)
            assert min(found[q] for q in chat_repair.GOALS) == brute_repair(initials, faults), (initials, faults)


def test_stretches_put_together_equal_one_derivation():
    r = random.Random(8)
    for _ in range(60):
        n, k = r.randint(2, 30), r.randint(1, 10)
        initials, faults = "".join(r.choice("uuaas\0") for _ in range(n)), "".join(r.choice("ooootbd") for _ in range(n))
        halves = [{(s, q): w for s in range(4) for q, w in chat_repair.derive(initials[x:y], faults[x:y], s).items()} for x, y in ((0, k), (k, n))]
        whole = chat_repair.compose(*halves)
        assert {(s, q): w for s in range(4) for q, w in chat_repair.derive(initials, faults, s).items()} == whole


def test_op13_equals_sql_on_odd_rows_and_any_block(spark, tmp_path):
    r = random.Random(9)
    said = ["Hello.", "Go on", "", " \n", None, "Why? ", "Long. " * 5000, "x!"]
    rows = [(c, t if r.random() < 0.95 else None, r.choice(["user", "assistant", "user", "assistant", "system", "", None, "tool"]), r.choice(said), "x", 1) for c in [*range(30), None] for t in range(r.choice([1, 2, 5, 9, 40]))]
    rows += [(99, t, "user" if t % 2 else "assistant", f"Turn {t}.", "x", 1) for t in range(3000)] + rows[:5]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit string, block int").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = db.sql(chat_repair.SQL)
    found = chat_repair.op13_chat_repair(spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, found), key=str) == sorted(want.fetchall(), key=str)
    damaged = chat_repair.damage(spark.read.parquet(f"{tmp_path}/conversations.parquet"))
    small, repaired = chat_repair.repair(damaged, 3)
    w = {x[0]: (x[7], x[8]) for x in db.sql(f"SELECT conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 FROM ({chat_repair.SQL})").fetchall()}
    assert {x.conv_id: x.audit for x in small.filter("block is null").collect()} == {c: a for c, (a, _) in w.items() if a or c in {x.conv_id for x in damaged.collect()}}
    assert all(w[x.conv_id][1] == x.repaired_sha256 for x in chat_repair.repaired_digests(repaired).collect())
    none = chat_repair.repair(damaged.limit(0))
    assert none[0].count() == 0 and none[1].count() == 0
