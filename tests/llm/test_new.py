"""Spelling variants, vector codes and URL rules against brute force on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointweave.llm import spelling, url_rules, vector_codes
from tests.compare import spark_rows

# ---- spelling variants


def edits(a, b):
    """Whether b is one insertion, deletion or replacement away from a."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants_by_hand(docs):
    count = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    count = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in count if edits(w, v)] for w in count}
    best = {w: min(v, key=lambda x: (-count[x], x)) if v else None for w, v in near.items()}
    form = {w: b if b and count[b] >= 2 * count[w] else None for w, b in best.items()}
    rows = []
    for w, n in count.items():
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n, len(near[w]), count[form[w]] if form[w] else None))
    return rows


def spelling_docs():
    r = random.Random(5)
    base = ["garden", "gardens", "Gärten", "gartén", "letter", "leter", "lettter", "leetter", "aaaaa", "aaaaaa", "aaaab", "ÀÖÿ×÷x", "straße", "abcde", "bcdea"]
    words = [w for k, w in enumerate(base) for _ in range(3 * 2 ** (k % 5))]
    docs = []
    for i in range(60):
        r.shuffle(words)
        docs.append((i % 50 if i % 7 else None, r.choice([" ", ", ", "_", "1", "\n"]).join(words[: r.randint(1, 80)])))
    return [*docs, (99, None), (98, ""), (97, "é à b"), (96, "long" * 4000), (95, "GARDEN " * 30_000)]


def test_spelling_variants_equal_brute_force(spark):
    docs = spelling_docs()
    df = spark.createDataFrame([(i, t, "w", 1, "f") for i, t in docs], "doc_id long, text string, word string, n int, form string")
    out = spelling.spelling_variants(df)
    rows = sorted(tuple(r) for r in out.collect())
    want = variants_by_hand(docs)
    assert rows == sorted(want) and any(r[2] not in (r[0], r[1]) for r in want)


@pytest.mark.parametrize(("size", "cells"), [(16, 1 << 19), (1 << 26, 8)])
def test_spelling_variants_with_a_full_filter_and_small_blocks(spark, monkeypatch, size, cells):
    monkeypatch.setattr(spelling, "FILTER_BYTES", size)
    monkeypatch.setattr(spelling, "BLOCK_CELLS", cells)
    docs = spelling_docs()
    out = spelling.spelling_variants(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(tuple(r) for r in out.collect()) == sorted(variants_by_hand(docs))


def test_spelling_variants_of_no_words(spark, awkward):
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert spelling.spelling_variants(spark.createDataFrame([(1, "a bb"), (2, None)], "doc_id long, text string")).collect() == []
    docs = [(r["doc_id"], r["text"]) for r in awkward.select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in spelling.spelling_variants(awkward).collect()) == sorted(variants_by_hand(docs))


@pytest.mark.parametrize("words", [["a", "b"], ["aa", "ab", "ba"], ["aab", "aba", "bbb", "abc"]])
def test_neighbourhoods_are_whole_and_distinct(words):
    letters = "abc"
    made = [
        (words[row], near.tobytes().decode())
        for rows, out in spelling.neighbours(np.frombuffer("".join(words).encode(), np.uint8).reshape(len(words), -1), np.frombuffer(letters.encode(), np.uint8))
        for row, near in zip(rows, out, strict=True)
    ]
    assert len(made) == len(set(made))
    want = set()
    for w in words:
        want |= {(w, w[:k] + w[k + 1 :]) for k in range(len(w))}
        want |= {(w, w[:k] + c + w[k + 1 :]) for k in range(len(w)) for c in letters if c != w[k]}
        want |= {(w, w[:k] + c + w[k:]) for k in range(len(w) + 1) for c in letters}
    assert set(made) == want
    # a filter drops no word, and most others
    block = spelling.letter_keys(0, len(words[0]), np.frombuffer(b"abc", np.uint8))
    at = np.array([[letters.index(c) for c in w] for w in words])
    h = np.bitwise_xor.reduce(block[np.arange(at.shape[1]), at], axis=1)
    known = np.zeros(64, np.uint64)
    np.bitwise_or.at(known, (h & np.uint64(63)).astype(int), spelling.filter_bits(h))
    held = {near.tobytes().decode() for _, out in spelling.neighbours(np.frombuffer("".join(words).encode(), np.uint8).reshape(len(words), -1), np.frombuffer(b"abc", np.uint8), known) for near in out}
    assert held >= {b for a, b in want if b in words} and len(held) < len({b for _, b in want})


# ---- vector codes


def codes_by_hand(rows):
    """Rows and digest of the contract in plain integers; rows: vec_id, vector, label."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[math.floor(4096 * float(np.float32(x))) for x in r[1]] for r in kept]
    width = len(whole[0]) // 8
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for v in whole[:16]] for p in range(8)]

    def nearest(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(6):
        at = [[nearest(v, p)[1] for p in range(8)] for v in whole]
        for p in range(8):
            for k in range(len(books[p])):
                if mine := [cut(v, p) for v, a in zip(whole, at, strict=True) if a[p] == k]:
                    books[p] = [*books[p][:k], [sum(c) // len(mine) for c in zip(*mine, strict=True)], *books[p][k + 1 :]]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [[nearest(v, p) for p in range(8)] for v in whole]
    error = [sum(d for d, _ in f) for f in found]
    labels = Counter()
    for r, e in zip(kept, error, strict=True):
        labels[r[2]] += e
    return [(r[0], "".join(f"{k:02x}" for _, k in f), e, labels[r[2]], digest) for r, f, e in zip(kept, found, error, strict=True)]


def vectors(n, dims, seed=1, step=0.25):
    """Vectors on a coarse grid, so that distances tie."""
    r = random.Random(seed)
    return [(k // 2 * 2 if k % 10 == 3 else k, [round(r.gauss(0, 1) / step) * step for _ in range(dims)], r.choice([None, 1, 1, 1, 2])) for k in range(n)]


def coded(spark, rows, tmp_path):
    path = str(tmp_path / "embeddings.parquet")
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "vec_id long, embedding array<float>, label int, code string, error double")
    df.repartition(3).write.parquet(path)
    out = vector_codes.op12_vector_codes(spark, str(tmp_path))
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_vector_codes_equal_brute_force(spark, tmp_path):
    rows = vectors(150, 16)
    rows += [(500, None, 1), (501, [1.0] * 15 + [None], 1), (502, [float("nan")] * 16, 1), (503, [float("inf")] * 16, 2), (None, [0.5] * 16, None), (504, [-1e4] * 16, 7)]
    r = random.Random(0)
    r.shuffle(rows)
    assert coded(spark, rows, tmp_path) == sorted(codes_by_hand(rows), key=str)


def test_vector_codes_of_few_and_equal_rows(spark, tmp_path):
    rows = [(k, [0.1 * (k % 3)] * 8, None) for k in range(9)]
    assert coded(spark, rows, tmp_path) == sorted(codes_by_hand(rows), key=str)


def test_vector_codes_beyond_a_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 1)
    rows = vectors(40, 8)
    assert coded(spark, rows, tmp_path) == sorted(codes_by_hand(rows), key=str)


def test_vector_codes_of_no_rows(spark, tmp_path):
    assert coded(spark, [(1, None, 1)], tmp_path) == []


def test_vectors_of_other_lengths_are_padded_and_huge_ones_clipped(spark):
    rows = [(1, [1.0] * 9, 1), (2, [1.0], 1), (3, [], 1), (4, [3e38, -3e38], 1)]
    df, books = vector_codes.encode_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert books[0].shape == (4, 2) and {r["vec_id"]: r["error"] for r in df.collect()} == {1: 0, 2: 0, 3: 0, 4: 0}


@pytest.mark.parametrize(("k", "d", "spread"), [(16, 8, 2000), (16, 4, 3), (5, 2, 2), (1, 3, 10)])
def test_cell_file_finds_the_nearest_entry_and_measures_few(k, d, spread):
    r = np.random.default_rng(k + d)
    entries, q = r.integers(-spread, spread + 1, (k, d)), r.integers(-spread, spread + 1, (400, d))
    book = vector_codes.CellFile(entries)
    exact = ((q[:, None] - entries[None]) ** 2).sum(2)
    lower, upper = book.bounds(q)
    assert (lower <= exact).all() and (exact <= upper).all()
    best, error = book.nearest(q)
    assert (best == exact.argmin(1)).all() and (error == exact.min(1)).all()
    if k == 16 and d == 8:
        assert (lower <= upper.min(1, keepdims=True)).mean() < 0.5


# ---- URL rules

URLS = [
    None, "", "no scheme", "http://", "http:///en/1", "HTTP://Example.ORG/en/1", "http://example.org/en/12?x", "http://a.example.org/en/2",
    "http://xexample.org/en/1", "http://example.org", "http://example.org?/es/", "http://example.org/es", "http://example.org/es/#a",
    "http://org/", "http://a.org/x", "http://borg/", "http://b.com/fr/1", "http://com/de/", "http://b.com/DE/", "http://b.com/de/x/y.zip",
    "http://example.org:80/en/1", "http://u@example.org/en/1", "x://y://example.org/en/1", "http://spam-farm.net/x", "http://notspam.net/x",
    "http://ads.b.com/x", "http://a.ads.net/x", "http://b.net/wp-login.php", "http://b.net/my-casino", "http://best-casino.net/", "http://casino.net",
    "http://b.net/tag/x/page/2", "http://b.net/tag/page/2", "http://É.com/fr/é", "http://a\nb.com/fr/\n", "http://b.com/fr/" + "x/" * 5000, "http://b.net/a.b.zip",
]


def judged_by_hand(url, rules):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        k = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:k])
        path = re.split(r"[?#]", rest[k:])[0]
    fit = []
    for layer, verdict, rule in rules:
        if not rule or "/" not in rule:
            continue
        h, _, p = rule.partition("/")
        wild = lambda part, star: star.join(re.escape(x) for x in part.split("*"))
        hosts = re.compile(wild(h, "[^/]*"), re.DOTALL)
        names = [host, *[host[i + 1 :] for i, c in enumerate(host) if c == "."]]
        if any(hosts.fullmatch(n) for n in names) and re.compile(wild("/" + p, ".*"), re.DOTALL).match(path):
            fit.append((layer, -len(rule), rule, verdict != "block", verdict))
    best = min(fit, default=None)
    return (host, path, best[0], best[2], best[4]) if best else (host, path, None, None, "allow")


def url_rows(spark, rules, urls):
    pages = spark.createDataFrame([(k, u, "h", "r") for k, u in enumerate(urls)], "page_id long, url string, Host string, rule string")
    table = spark.createDataFrame(rules, "layer int, verdict string, rule string")
    out = url_rules.judge_urls(pages, table)
    assert out.columns == ["page_id", "url", "host", "path", "layer", "rule", "verdict"]
    return {r["page_id"]: tuple(r)[2:] for r in out.collect()}


@pytest.mark.parametrize("broadcast", [200_000, 2])
def test_urls_are_judged_as_by_hand(spark, monkeypatch, broadcast):
    monkeypatch.setattr(url_rules, "BROADCAST_RULES", broadcast)
    rules = [
        *url_rules.HOST_RULES, *url_rules.PATTERN_RULES, (2, "allow", "*/"), (2, "block", "*/"), (1, "block", "b.net/a.b"), (1, "block", "é.com/"),
        (0, "block", None), (0, "block", "nothing"), (0, "block", ""), (3, "block", "a.b.c.d.e/(x|y)[z]+"), (0, "block", "com/fr/"),
    ]
    urls = URLS + ["http://b.com/fr/1"] * 50 + [None] * 3
    assert url_rows(spark, rules, urls) == {k: judged_by_hand(u, rules) for k, u in enumerate(urls)}


def test_a_rule_waits_under_its_rarest_token(spark):
    rules = spark.createDataFrame([(0, "block", "example.org/en/1"), (0, "block", "*/x"), (0, "block", "spam*.net/a/b")], "layer int, verdict string, rule string")
    seen = spark.createDataFrame([("example", 9), ("org", 5), ("en", 7), ("net", 4), ("a", 4)], "token string, n long")
    found = {r["rule"]: r["token"] for r in url_rules.rule_index(rules, seen).collect()}
    assert found == {"example.org/en/1": "org", "*/x": "", "spam*.net/a/b": "a"}


def test_no_pages_and_no_rules(spark):
    none = spark.createDataFrame([], "layer int, verdict string, rule string")
    pages = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    assert [tuple(r)[2:] for r in url_rules.judge_urls(pages, none).collect()] == [("a.org", "/x", None, None, "allow")]
    assert url_rules.judge_urls(pages.limit(0), none).collect() == []


def test_the_three_queries_run_native_or_whole(spark):
    from tests.compare import SF

    out = url_rules.op13_url_rules(spark, SF)
    assert "Python" not in out._jdf.queryExecution().toString()
    assert out.where(F.col("verdict") == "block").count() > 0
    assert spark_rows(out)[0] == sorted(["page_id", "host", "path", "rule", "verdict", "pattern"])
