"""Quality rules, classifier, toxicity, URL filter: brute force, held-out accuracy, edge cases."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from storyspark.llm import quality_classifier, quality_rules, statistics, toxicity, url_filter
from storyspark.llm.common import fold

DOCS = "doc_id long, text string, lang string, score double, kept boolean, y int"
LABELS = "doc_id long, quality int, toxic int"


def plain_statistics(text):
    """The base counts, written the long way."""
    words, word = [], ""
    for c in text + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    inside = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
    seen, dup = [], 0
    for line in text.split("\n"):
        if any(c not in " \t\n\x0b\x0c\r" for c in line):
            dup += line in seen
            seen.append(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def texts(n, seed=0):
    r = random.Random(seed)
    vocabulary = ["the", "of", "é", "naïve", "a#b", "ON", "x|y", "z\u00a0w", "\U0001f600", "12"]
    return ["".join(r.choice(vocabulary) + r.choice([" ", "  ", "\n", "\t", "\x0b", " \n"]) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_statistics_equal_the_long_way():
    for t in [*texts(200), "", " ", "a b c d e a b c d e", "x x x x x x x", "l\nl\n l\nl"]:
        assert statistics.of_text(t)[:5] == plain_statistics(t), t


def rows_with_junk(spark, n=400):
    r = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        junk = i % 5 == 0
        words = [r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(r.randint(0, 99)) for _ in range(40)]
        toxic = i % 7 == 0
        if toxic:
            words[::6] = [r.choice(["vilemuck", "grotstain", "sludgery"]) for _ in words[::6]]
        rows.append((i, " ".join(w + "###" * junk for w in words), "en", 0.0, True, 9))
        labels.append((i, int(not junk), int(toxic)))
    rows += [(None, "x y", None, None, None, None), (1000, None, "en", 0.0, True, 1), (1001, "", "en", 0.0, True, 1), (3, rows[3][1], "en", 0.0, True, 1), (1002, "w " * 50_000, "en", 0.0, True, 1)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (None, 1, 0), (5, None, None)], LABELS), rows, labels


def test_quality_rules(spark):
    docs, labels, rows, marks = rows_with_junk(spark)
    got = quality_rules.quality_rules(docs, labels).collect()
    assert len(got) == len(rows)
    kept = {(r.doc_id): (r.base_failed, r.kept) for r in got}
    for i, good, _ in marks:
        assert kept[i] == (False, bool(good))
    assert kept[None] == kept[1000] == kept[1001] == (True, False) and kept[1002] == (True, False)


def test_quality_rules_on_nothing(spark):
    docs, labels, *_ = rows_with_junk(spark)
    assert quality_rules.quality_rules(docs.limit(0), labels).count() == 0
    kept = quality_rules.quality_rules(docs, labels.limit(0))
    assert kept.filter("kept").count() == 401  # only base rules are left


def test_rules_cover_only_precise_conjunctions():
    r = np.random.default_rng(0)
    x = {n: r.random(600) for n in quality_rules.FEATURES}
    bad = (x["upper_share"] > 0.7) & (x["mark_share"] > 0.6)
    rules = quality_rules.learn_rules(x, bad)
    hit = np.zeros(600, bool)
    for rule in rules:
        hit |= rule.matches(x)
    assert (hit & bad).sum() >= 0.9 * bad.sum() and (hit & ~bad).sum() <= 3
    assert quality_rules.learn_rules(x, np.zeros(600, bool)) == []


def test_discriminant_equals_the_densities():
    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(0, 1, (50, 10)), r.normal(1, 2, (80, 10))])
    y = np.array([0] * 50 + [1] * 80)
    n = np.array([50, 80])
    s = np.array([x[y == k].sum(0) for k in (0, 1)])
    ss = np.array([x[y == k].T @ x[y == k] for k in (0, 1)])
    model = quality_classifier.fit_from_sums(n, s, ss)
    covs = [np.cov(x[y == k].T, bias=True) for k in (0, 1)]
    pooled = (50 * covs[0] + 80 * covs[1]) / 130
    logs = []
    for k in (0, 1):
        c = 0.7 * covs[k] + 0.3 * pooled
        c = 0.8 * c + 0.2 * np.diag(np.diag(c)) + 0.01 * np.eye(10)
        d = x - x[y == k].mean(0)
        logs.append(np.log(n[k] / 130) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d))
    assert np.allclose(model.scores(x), 1 / (1 + np.exp(logs[0] - logs[1])))
    assert quality_classifier.fit_from_sums(np.array([0, 3]), s, ss) is None


def test_quality_classifier(spark):
    docs, labels, rows, marks = rows_with_junk(spark)
    got = {r.doc_id: r.score for r in quality_classifier.quality_classifier(docs, labels).collect()}
    assert len(got) == len(rows) - 1 and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.3) == bool(q) for i, q, _ in marks if zlib.crc32(str(i).encode()) % 5 == 0]) > 0.95
    assert {r.score for r in quality_classifier.quality_classifier(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.quality_classifier(docs.limit(0), labels).count() == 0


def test_toxicity(spark):
    docs, labels, rows, marks = rows_with_junk(spark)
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows)
    score = {r.doc_id: r.score for r in got}
    assert np.mean([(score[i] >= 0.5) == bool(t) for i, _, t in marks if zlib.crc32(str(i).encode()) % 5 == 0]) > 0.95
    assert all(len(r.evidence) == len(r.cosines) <= toxicity.NEIGHBOURS for r in got)
    by_text = {}
    for r in got:  # an id is no input of a score
        by_text.setdefault({i: t for i, t, *_ in rows}[r.doc_id], set()).add(r.score)
    assert all(len(x) == 1 for x in by_text.values())
    assert score[1000] == score[1001] < 0.5
    columns = ["doc_id", "text", "lang", "score"]
    left = toxicity.drop_toxic(docs, labels, columns)
    assert left.columns == columns
    assert left.count() == sum(r.score < 0.5 for r in got)
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_near_copies_of_examples_are_near(spark):
    docs, labels, rows, marks = rows_with_junk(spark)
    r = random.Random(9)
    lone = " ".join(f"w{r.randint(0, 10**6)}" for _ in range(60))
    fresh = [i for i in range(2000, 2100) if zlib.crc32(str(i).encode()) % 5][:2]
    more = [(fresh[0], lone), (3001, lone), (3002, lone.rsplit(" ", 3)[0] + " other end here"), (3003, lone.upper().replace("W", "v")), (fresh[1], lone.upper().replace("W", "v"))]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    labels = labels.union(spark.createDataFrame([(fresh[0], 1, 1), (fresh[1], 1, 0)], LABELS))
    got = {x.doc_id: x for x in toxicity.toxicity(docs, labels).collect()}
    assert got[3001].score == got[fresh[0]].score > 0.8 and got[3001].evidence[0] == fresh[0] and got[3002].score > 0.7 and got[3003].score < 0.5
    left = {x.doc_id for x in toxicity.drop_toxic(docs, labels, ["doc_id", "text"]).collect()}
    assert not {3001, 3002} & left and 3003 in left


def plain_toxicity(docs, marks, k=9):
    """Scores the long way: dictionaries of words, all cosines. docs: id to text, marks: id to label."""
    tf = {i: Counter(re.findall(r"\w+", (t or "").lower())) for i, t in docs.items()}
    examples = {}
    for i, y in sorted(marks.items()):
        if zlib.crc32(str(i).encode()) % 5:
            examples.setdefault((y, docs[i]), i)
    y = {i: label for (label, _), i in examples.items()}
    n1, n0 = sum(y.values()), len(y) - sum(y.values())
    weight = {}
    for w in set().union(*(tf[i] for i in y)):
        b, g = (sum(w in tf[i] for i in y if y[i] == c) for c in (1, 0))
        pooled = (b + g + 1) / (n0 + n1 + 1)
        df = sum(w in x for x in tf.values())
        weight[w] = math.log((len(docs) + 1) / (df + 0.5)) * abs(b / n1 - g / n0) / math.sqrt(pooled * (1 / n1 + 1 / n0))

    def vector(i):
        v = {w: (1 + math.log(n)) * weight[w] for w, n in tf[i].items() if w in weight}
        length = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / length for w, x in v.items()} if length else {}

    vectors = {i: vector(i) for i in y}
    empty = [y[i] for i in y if not vectors[i]]
    base = (sum(empty) + 1) / (len(empty) + 10)
    out = {}
    for i in docs:
        q = vector(i)
        near = sorted(((sum(x * vectors[e].get(w, 0) for w, x in q.items()), y[e]) for e in y), reverse=True)[:k]
        v = [(1 / (1 - min(c, 1) + 0.02), label) for c, label in near if c > 0]
        out[i] = (sum(x * label for x, label in v) + 0.25 * base) / (sum(x for x, _ in v) + 0.25) if v else base
    return out


def test_toxicity_scores_equal_the_long_way(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    docs = {i: " ".join(r.choice(words[: 300 if i % 3 else 40]) for _ in range(r.randint(0, 40))) for i in range(150)} | {900: None, 901: "none of these", 902: "w1 " * 30_000 + "w2"}
    marks = {i: int(i % 4 == 0) for i in range(0, 120)}
    want = plain_toxicity(docs, marks)
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {x.doc_id: x.score for x in toxicity.toxicity(frame, spark.createDataFrame([(i, 1, y) for i, y in marks.items()], LABELS)).collect()}
    assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_nearest_examples_are_exact(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 8)
    r = random.Random(3)
    idf = np.array([0.5 + r.random() for _ in range(40)])
    rows = []
    for i in range(500):
        terms = sorted(r.sample(range(40), r.randint(0, 5)))
        rows.append((i, int(i % 3 == 0), terms, [r.randint(1, 4) for _ in terms]))
    index = toxicity.BlockMaxIndex.build(rows, idf)
    where = {d: k for k, d in enumerate(index.ids.tolist())}
    dense = np.zeros((500, 40))
    for i, _, t, n in rows:
        if t:
            dense[i, t] = toxicity.weights(np.array(n), idf[t])
    for _ in range(100):
        t = sorted(r.sample(range(40), r.randint(1, 6)))
        w = toxicity.weights(np.array([1] * len(t)), idf[t])
        q = np.zeros(40)
        q[t] = w
        cos = dense @ q
        want = sorted(((-round(c, 12), where[i]) for i, c in enumerate(cos) if c > 1e-15), key=lambda x: x)[:9]
        at, got = index.nearest(np.array(t), w, 9)
        assert np.allclose(sorted(got), sorted(-c for c, _ in want)) and len(at) == len(want)


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]


def plain_rule(host, path):
    fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return (best.text, best.verdict) if best else (None, None)


def test_url_filter(spark):
    urls = ["http://A.Example.NET/en/1", "https://example.net/de/1?x=/en/", "http://b.example.com/de/", "x.org/fr/", "ftp://q.org/fr/2#t", "http://net", "http://net/", "http://network/a", "http://a?b://c/d", None, "", "://", "http://É.org/fr/\n1", "http://bad.io/spam/1.html"]
    urls += [f"http://mixed.io/good/{i}" for i in range(40)] + [f"http://mixed.io/spam/{i}" for i in range(40)]
    pages = spark.createDataFrame([(i, u, "h", "x") for i, u in enumerate(urls)] + [(None, urls[0], "h", "x"), (3, urls[3], "h", "x")], "page_id long, url string, html string, host string")
    labels = spark.createDataFrame([(i, int("spam" not in (u or "")), 0) for i, u in enumerate(urls)], LABELS)
    got = url_filter.filter_urls(pages, labels).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        u = urls[r.page_id if r.page_id is not None else 0]
        assert (r.host, r.path) == plain_url(u)
        rule, verdict = plain_rule(*plain_url(u))
        assert r.rule == rule and (rule is None or r.verdict == verdict)
    own = {urls[r.page_id]: r.verdict for r in got if r.page_id is not None and (urls[r.page_id] or "").startswith("http://mixed")}
    assert all(v == ("block" if "spam" in u else "allow") for u, v in own.items())
    assert url_filter.filter_urls(pages.limit(0), labels).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages.filter("url like '%mixed%'"), labels.limit(0)).collect()} == {"allow"}


def test_mixed_shapes_and_deep_segments_are_told_apart(spark):
    deep = "http://deep.io/a/b/c/d/e/f/g/"
    urls = [f"http://mix.io/article-{i}" for i in range(40)] + [f"http://mix.io/casino-{i}" for i in range(40)]
    urls += [f"{deep}good/{i}" for i in range(40)] + [f"{deep}spam/{i}" for i in range(40)]
    urls += [f"http://ids.io/{i}" for i in range(40)] + ["http://long.io" + "/x" * 300, "http://long.io"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, int("casino" not in u and "spam" not in u), 0) for i, u in enumerate(urls)], LABELS)
    got = {urls[r.page_id]: r for r in url_filter.filter_urls(pages, labels).collect()}
    assert len(got) == len(urls)
    assert all(r.verdict == ("block" if "casino" in u or "spam" in u else "allow") for u, r in got.items())
    assert got["http://mix.io/casino-7"].template == "/casino-{n}" and got["http://mix.io/article-7"].template == "/article-{n}"
    assert got["http://ids.io/7"].template == "/*"
    assert got[deep + "spam/7"].template == "/*" * 7 + "/spam/*"
    assert got["http://long.io" + "/x" * 300].template == "/*" * 300 and got["http://long.io"].template == ""


def plain_templates(rows):
    """The tree the long way, by recursion: rows (host, shape, good or None) to {(host, shape): template}."""
    out = {}

    def grow(paths, depth, prefix):
        # paths: {shape: [n, known, good]} that share the prefix and have a segment at depth
        children = {}
        for shape, c in paths.items():
            children.setdefault(shape[depth], {})[shape] = c
        total = {seg: [sum(c[k] for c in x.values()) for k in range(3)] for seg, x in children.items()}
        all_n = sum(c[0] for c in total.values())
        varying = len(children) >= url_filter.MANY and len(children) > url_filter.SINGLE_SHARE * all_n
        name = {seg: "*" for seg in children}
        tested = sorted((g / k, k, g, seg) for seg, (_, k, g) in total.items() if not varying and seg not in ("{n}", "{x}") and k >= url_filter.LEAST_TESTED)
        groups = []
        for share, k, g, seg in tested:
            if groups:
                s0, k0, g0, _ = groups[-1][-1]
                p = (g + g0) / (k + k0)
                if share - s0 <= 1.96 * math.sqrt(p * (1 - p) * (1 / k + 1 / k0)):
                    groups[-1].append((share, k, g, seg))
                    continue
            groups.append([(share, k, g, seg)])
        for at, group in enumerate(groups):
            for *_, seg in group:
                name[seg] = "*" if len(groups) == 1 else seg if len(group) == 1 else f"*{at + 1}"
        merged = {}
        for seg, x in children.items():
            merged.setdefault(name[seg], {}).update(x)
        for branch, x in merged.items():
            for shape in [s for s in x if len(s) == depth + 1]:
                out[host, shape] = f"{prefix}/{branch}"
            further = {s: c for s, c in x.items() if len(s) > depth + 1}
            if len(paths) == 1:
                for shape in further:
                    out[host, shape] = f"{prefix}/{branch}" + "/*" * (len(shape) - depth - 1)
            elif further:
                grow(further, depth + 1, f"{prefix}/{branch}")

    by = {}
    for host, shape, good in rows:
        c = by.setdefault(host, {}).setdefault(shape, [0, 0, 0])
        c[0] += 1
        c[1] += good is not None
        c[2] += good or 0
    for host, paths in by.items():
        out[host, ()] = ""
        if deep := {s: c for s, c in paths.items() if s}:
            grow(deep, 0, "")
    return out


def test_templates_and_verdicts_equal_the_long_way(spark):
    r = random.Random(8)
    quality = {"news": 0.95, "blog": 0.9, "casino": 0.05, "pills": 0.1, "misc": 0.5, "shop": 0.55, "rare": 0.0}
    urls, marks = {}, {}
    for i in range(3000):
        first, second = r.choice(list(quality)[: 6 if i % 50 else 7]), r.choice(["a", "b", "tag", f"p-{r.randint(0, 9)}", str(r.randint(0, 99)), ""])
        path = "/".join(["", first, second, *(["x"] * r.randint(0, 2)), f"w{r.choice('abcdefghijkl')}{r.choice('abcdefghijkl')}{r.choice('abcdefghijkl')}"][: r.randint(1, 6)])
        urls[i] = f"http://{r.choice(['one.io', 'two.io'])}{path}"
        if r.random() < 0.6:
            marks[i] = int(r.random() < quality[first] + (0.3 if second == "tag" else 0))
    pages = spark.createDataFrame(list(urls.items()), "page_id long, url string")
    got = {x.page_id: x for x in url_filter.filter_urls(pages, spark.createDataFrame([(i, q, 0) for i, q in marks.items()], LABELS)).collect()}
    shape = {}
    for i, u in urls.items():
        parts = [p for p in plain_url(u)[1].split("/") if p]
        shape[i] = plain_url(u)[0], tuple(re.sub("[0-9]+", "{n}", re.sub("[0-9a-fA-F]{12,}", "{x}", p)) for p in parts)
    template = plain_templates([(*shape[i], marks.get(i)) for i in urls])
    known, good = Counter(), Counter()
    for i, q in marks.items():
        key = shape[i][0], template[shape[i]]
        known[key] += 1
        good[key] += q
    base = sum(marks.values()) / len(marks)
    for i in urls:
        key = shape[i][0], template[shape[i]]
        rejected = known[key] >= url_filter.LEAST_LABELLED and (good[key] + 10 * base) / (known[key] + 10) < 0.5
        assert got[i].template == key[1] and got[i].verdict == ("block" if rejected else "allow"), (urls[i], got[i], key)
    assert {got[i].verdict for i in urls} == {"allow", "block"}
    assert len({x.template for x in got.values()} & {"/*1", "/*2", "/*3"}) > 1  # similar siblings have merged, different ones not


@pytest.mark.parametrize("i", [0, 7, -1, 10**12])
def test_fold_is_crc32_of_the_decimal_text(spark, i):
    from pyspark.sql import functions as F

    assert spark.range(1).select(fold(F.lit(i).cast("long")).alias("f")).first().f == zlib.crc32(str(i).encode()) % 5
