"""The operators with Python inside their tasks: brute force, held-out quality and awkward rows."""

import itertools
import random
import re
import tracemalloc
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from pointweave.llm import chat, decontaminate, ngram_join, quality_model, registry, secrets, tokens, toxicity
from pointweave.operators import components
from tests.compare import SF, spark_rows, sql_rows
from tests.llm.conftest import prose

BIGGER = "/root/testdata/sf0.01"


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# words and hashes


def test_pieces_cut_between_texts():
    texts = ["a b", None, "", "c" * 3000 + " d", "e  f\n\tg"]
    for limit in (1, 10, 1 << 20):
        got = {}
        for i, j, d, starts in tokens.pieces(pa.array(texts), limit):
            s, e = tokens.word_spans(d)
            for r, lo, hi in zip(range(i, j), starts, [*starts[1:], len(d)], strict=True):
                got[r] = [d[a:b].tobytes().decode() for a, b in zip(s, e, strict=True) if lo <= a < hi]
        assert [got[k] for k in range(5)] == [(t or "").split() for t in texts]


def test_equal_hashes_for_equal_words_only():
    words = list({prose(k, 1) * (k % 40 + 1) for k in range(300)} | {"x" * n for n in (7, 8, 9, 16, 17, 1024, 1025, 5000)})
    d = np.frombuffer((" ".join(words * 2) + " ").encode(), np.uint8)
    h = tokens.hash_spans(d, *tokens.word_spans(d))
    assert len(set(h.tolist())) == len(words) and (h[: len(words)] == h[len(words) :]).all()


# n-gram join


def brute_join(texts, size=4, percent=85):
    sets = []
    for t in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return [(i, len(sets[i]), root(i)) for i in range(len(texts))]


def near_copies(seed, n):
    r = random.Random(seed)
    base = [prose(seed * 100 + k, r.randint(5, 120)) for k in range(6)]
    out = []
    for _ in range(n):
        w = r.choice(base).split()
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
            w[r.randrange(len(w))] = r.choice(["changed", "word", "here"])
        out.append(" ".join(w).title() if r.random() < 0.2 else "  ".join(w))
    return out


@pytest.mark.parametrize("seed,paired,hot,batch", [(1, 64, 1 << 16, 10_000), (2, 4, 1 << 16, 50), (3, 2, 10, 10_000)])
def test_join_against_brute_force(spark, monkeypatch, seed, paired, hot, batch):
    monkeypatch.setattr(ngram_join, "PAIRED", paired)
    monkeypatch.setattr(ngram_join, "HOT_ROWS", hot)
    monkeypatch.setattr(ngram_join, "PIVOTS", (2,))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        texts = near_copies(seed, 160) + ["", None, "one", "ONE ", "one two three", "a b c d"]
        got = ngram_join.ngram_jaccard_join(docs_of(spark, texts)).collect()
        assert sorted(tuple(r) for r in got) == brute_join(texts)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


class Caught:
    """Stands for a DataFrame and gives back the function that mapInArrow is handed."""

    sparkSession = property(lambda self: self)
    sparkContext = property(lambda self: self)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])

    def broadcast(self, value):
        return SimpleNamespace(value=value)

    def mapInArrow(self, run, schema):
        return run


def batch_of(texts):
    ids = pa.array(range(len(texts)), pa.int64())
    return pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.string()), ids], names=["doc_id", "text", "text_key"])


def test_counting_shingles_takes_little_more_than_the_block(monkeypatch):
    monkeypatch.setattr(ngram_join, "COUNT_BLOCK", 1 << 20)
    texts = [" ".join(str(k % 9_000 + 7 * t) for k in range(9_000)) for t in range(100)] * 2
    batches = [batch_of(texts[k : k + 10]) for k in range(0, len(texts), 10)]
    run = ngram_join.sketch(Caught(), 5)
    tracemalloc.start()
    out = list(run(batches))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 22 << 20
    sets = [s for b in batches for _, s, _ in tokens.shingle_sets(b.column("text"), 5)]
    ends = np.cumsum([len(s) for s in sets])
    cut = int(np.searchsorted(ends, 1 << 20)) + 1
    want = []
    for block in (sets[:cut], sets[cut:]):
        value, count = np.unique(np.concatenate(block), return_counts=True)
        want += zip(value[count >= 3].view(np.int64).tolist(), count[count >= 3].tolist(), strict=True)
    got = [(r["shingle"], r["count"]) for b in out for r in b.to_pylist() if r["shingle"] is not None]
    assert got == want and len(want) > 1000


@pytest.mark.parametrize("values", [[], [5], [5, 5], [5, 5, 5], [1, 2, 2, 2, 2, 3, 9, 9, 9], [4, 4, 4, 4, 7]])
def test_repeated_shingles(values):
    value, count = ngram_join.repeated(np.array(values, np.uint64), 3)
    assert dict(zip(value.tolist(), count.tolist(), strict=True)) == {v: values.count(v) for v in values if values.count(v) > 2}


def test_rows_of_regions_and_scores_are_handed_on_in_parts(monkeypatch):
    monkeypatch.setattr(ngram_join, "HANDED_ON", 1000, raising=False)
    texts = [None, ""] + [prose(k, 500) for k in range(60)]
    nothing = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(tokens.WORD_BUCKETS, np.int64)
    parts = list(ngram_join.region_rows(Caught(), 5, 80, SimpleNamespace(value=nothing))([batch_of(texts)]))
    assert len(parts) > 3 and max(p.num_rows for p in parts) < 1200
    assert sum(p.num_rows for p in parts) == sum(ngram_join.boundary_width(len(set(brute_words(t, 5))), 80) for t in texts[2:])
    long = [None, "", *(prose(k, 12_000) for k in range(40))]
    run = quality_model.score_texts(Caught(), quality_model.fit([], np.zeros(0)), ["doc_id", "text"])
    parts = list(run([batch_of(long)]))
    assert len(parts) > 1 and [x for p in parts for x in p.column("text").to_pylist()] == long
    net = quality_model.fit([], np.zeros(0))
    for p in parts:
        assert p.column("score").to_pylist() == net.scores([(t or "").encode() for t in p.column("text").to_pylist()]).tolist()


def brute_words(text, size):
    w = text.split()
    return [tuple(w[k : k + size]) for k in range(len(w) - size + 1)]


def test_join_of_repeated_and_missing_ids(spark):
    a, b, c = prose(1, 60), prose(2, 60), prose(3, 60)
    near = lambda t: t + " end"
    rows = [(3, near(a)), (4, near(b)), (5, a), (5, b), (None, near(a) + " more"), (None, c), (None, near(c)), (7, a), (7, a)]
    got = ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sorted(((r["doc_id"], r["component_id"]) for r in got), key=str)
    assert found == sorted([(3, 3), (4, 4), (5, 3), (5, 4), (None, 3), (None, None), (None, None), (7, 3), (7, 3)], key=str)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, _text_key string")
    docs = docs.withColumnRenamed("_text_key", "extra")
    kept = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == sorted([("3", near(a)), ("4", near(b)), ("None", min(c, near(c), key=lambda t: key_of(spark, t)))])


def key_of(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(F.xxhash64("t")).collect()[0][0]


def test_vectors_never_exceed_the_difference():
    r = np.random.default_rng(1)
    for n in (3, 100, 600, 3000, 9000):
        x = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        for m in (n, n // 2, 4 * n):
            y = np.unique(np.concatenate([x[: m // 2], r.integers(0, 1 << 63, m - m // 2, dtype=np.uint64)]))
            va, vb = (np.frombuffer(ngram_join.set_vector(v), np.uint8)[None] for v in (x, y))
            assert ngram_join.vector_gap(va, vb)[0] <= len(np.setxor1d(x, y))
    assert ngram_join.set_vector(np.arange(300, dtype=np.uint64)) == b""


def test_join_same_rows_as_sql(spark):
    assert spark_rows(registry.queries()["op7_ngram_join"](spark, SF)) == sql_rows(registry.oracle_sql()["op7_ngram_join"])


def test_join_on_awkward_rows(spark, awkward):
    got = ngram_join.ngram_jaccard_join(awkward).collect()
    assert len(got) == awkward.count()
    by = {r["doc_id"]: r for r in got}
    assert [(by[i]["n_shingles"], by[i]["component_id"]) for i in (1, 2, 3)] == [(0, 1), (0, 2), (0, 3)]
    assert by[4]["component_id"] == by[5]["component_id"] == by[6]["component_id"] == 4
    assert by[7]["component_id"] == by[8]["component_id"] == 7
    assert by[9]["component_id"] == by[10]["component_id"] == 9 and by[11]["component_id"] == 11
    assert ngram_join.ngram_jaccard_join(awkward.limit(0)).count() == 0


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100)] + [(500, k) for k in range(501, 700)] + [(7, 7), (None, 3)]
    got = {r["child"]: r["parent"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 101)}, **{k: 500 for k in range(501, 700)}}


# decontamination


def test_planted_items_are_found(spark):
    item = "A farmer in Ohio sold 48 clips to Anna in April and then she sold half as many clips to Anna again in May for 3 dollars"
    other = item.replace("48", "96").replace("Anna", "Maria").replace("Ohio", "Texas")
    mixed_up = other.replace("Maria again", "Julia again")
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "7 8 9 10")], "item_id long, text string")
    docs = docs_of(spark, [prose(1, 40) + ". " + item + " " + prose(2, 40), prose(3, 30) + ".\n" + other, prose(4, 90), None, "", prose(5, 20) + "\n" + mixed_up])
    got = {r["doc_id"]: r for r in decontaminate.contaminated(docs, bench).collect()}
    assert set(got) == {0, 1} and got[0]["exact"] and not got[1]["exact"]
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0


def test_items_of_the_tables_against_containment(spark):
    got = {(r["doc_id"], r["item_id"]) for r in registry.queries()["op1_template_windows"](spark, BIGGER).collect()}
    flat = lambda t: " ".join(t.split())
    items = [(r["item_id"], flat(r["text"])) for r in spark.read.parquet(f"{BIGGER}/benchmark.parquet").collect()]
    docs = [(r["doc_id"], flat(r["text"])) for r in spark.read.parquet(f"{BIGGER}/documents.parquet").select("doc_id", "text").collect()]
    assert got == {(d, i) for d, t in docs for i, x in items if x in t}


def test_blocks_of_the_benchmark_give_the_same(spark, monkeypatch):
    whole = spark_rows(registry.queries()["op1_template_windows"](spark, SF))
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", 300)
    assert spark_rows(registry.queries()["op1_template_windows"](spark, SF)) == whole


def test_items_full_of_numbers_are_found(spark):
    item = "Divide the total of these values by seven: 3 4 kg 8 9 kg 12 15 kg 7 21 kg 33 40 kg 5 6 kg 11 2 kg 14 and 18"
    sums = "12 + 7 = 19 and 30 - 4 = 26 so 19 * 26 = 494 and 494 / 2 = 247"
    other = item.translate(str.maketrans("123456789", "234567891"))
    phrase = "Divide the total of these values by seven: nothing more is asked of anybody here today"
    bench = spark.createDataFrame([(1, item), (2, sums)], "item_id long, text string")
    texts = [prose(1, 30) + ". " + item + " " + prose(2, 30), prose(3, 30) + ". " + sums + " " + prose(4, 30), prose(5, 30) + ". " + other, phrase, "3 4 kg 8 9 kg 12 15 kg"]
    got = {(r["doc_id"], r["item_id"]): (r["coverage"], r["exact"]) for r in decontaminate.contaminated(docs_of(spark, texts), bench).collect()}
    assert got == {(0, 1): (1.0, True), (1, 2): (1.0, True), (2, 1): (1.0, False)}


def test_values_that_coincide_and_names_that_open_sentences(spark):
    """New values may be equal by chance; a name counts as one wherever it stands; one value must not become two."""
    miles = "A truck drives 60 miles in 2 hours and then it drives 90 miles in 3 hours on the same road"
    shop = "Anna has twelve red apples in her old basket. Anna gives some of the apples to her younger brother. Bob then eats two of the apples at home"
    total = "Take the first number 3 and add to it 5 and then add 8 and then add 13 and at last add 21 to the sum"
    bench = spark.createDataFrame([(1, miles), (2, shop), (3, total)], "item_id long, text string")
    both_four = miles.replace("60", "70").replace("90", "80").replace("2 hours", "4 hours").replace("3 hours", "4 hours")
    two_alike, all_alike = ("Take the first number {} and add to it {} and then add {} and then add {} and at last add {} to the sum".format(*v) for v in ((4, 6, 6, 14, 22), [4] * 5))
    renamed = shop.replace("Anna", "Maria").replace("Bob", "Tom")
    torn = shop.replace("Anna gives", "Julia gives").replace("Anna has", "Maria has").replace("red", "green").replace("younger", "older").replace("two", "six")
    texts = [miles, both_four, shop, renamed, prose(3, 20) + ".\n" + renamed + ". " + prose(4, 20), two_alike, torn, all_alike, prose(5, 80)]
    got = {(r["doc_id"], r["item_id"]): (r["coverage"], r["exact"]) for r in decontaminate.contaminated(docs_of(spark, texts), bench).collect()}
    assert set(got) == {(0, 1), (1, 1), (2, 2), (3, 2), (4, 2), (5, 3)}
    assert got[0, 1] == got[2, 2] == (1.0, True) and got[3, 2] == got[4, 2] == (1.0, False) and got[1, 1] == (1.0, False)


def test_openers_do_not_spoil_a_match(spark):
    """Where openers taken as names contradict each other, the literal windows still decide."""
    item = "The seven old ships sail slowly out of the small harbour at dawn. The nine young sailors sing a song about 40 whales in the sea"
    other = item.replace("The seven", "These seven").replace("The nine", "Those nine").replace("40", "50")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontaminate.contaminated(docs_of(spark, [other, prose(6, 60)]), bench).collect()
    assert [(r["doc_id"], r["exact"]) for r in got] == [(0, False)] and 0.5 <= got[0]["coverage"] < 1


def test_short_items_inside_longer_texts_are_found(spark):
    items = ["Who first climbed the Eiger", "What is 12 plus 30 minus 4", "Which river flows through old Vienna today"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [prose(k, 30) + ". " + t + "? " + prose(k + 9, 30) for k, t in enumerate(items)] + [prose(7, 60), items[0], "What is 13 plus 31 minus 5"]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs_of(spark, texts), bench).collect()}
    assert got == {(0, 0), (1, 1), (2, 2), (4, 0)}


def test_decontamination_on_awkward_rows(spark, awkward):
    bench = awkward.where("doc_id IN (1, 2, 4, 7)").select(F.col("doc_id").alias("item_id"), "text")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(awkward, bench).collect()}
    assert {(4, 4), (5, 4), (7, 7), (8, 7)} <= got and not {d for d, _ in got} & {1, 2, 3, 12, 14}


# models


def held_out(name, spark, value, truth):
    got = {r["doc_id"]: r[value] for r in registry.queries()[name](spark, BIGGER).collect()}
    labels = spark.read.parquet(f"{BIGGER}/labels.parquet").collect()
    unseen = [r for r in labels if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    good = [got[r["doc_id"]] for r in unseen if r[truth] == 1]
    bad = [got[r["doc_id"]] for r in unseen if r[truth] == 0]
    return sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad))


def test_quality_on_unseen_labels(spark):
    assert held_out("op2_byte_cnn", spark, "score", "quality") > 0.95


def test_severity_on_unseen_labels(spark):
    # these tables hold some twenty toxic documents to learn from; over 0.1 GB the area is above 0.999
    assert held_out("op10_severity", spark, "severity", "toxic") > 0.7


def test_every_byte_counts(spark):
    r = np.random.default_rng(0)
    net = quality_model.ByteCnn(r.normal(size=(8, 256, 16)).astype(np.float32), np.zeros(16, np.float32), r.normal(size=32).astype(np.float32), 0.0)
    long_text = bytes(r.integers(32, 120, quality_model.STEP_BYTES * 2 + 77, dtype=np.uint8))
    alone, step = net.scores([long_text])[0], quality_model.STEP_BYTES
    quality_model.STEP_BYTES = 1 << 24
    try:
        assert abs(net.scores([long_text])[0] - alone) < 1e-5
        both = net.scores([b"", long_text, b"x"])
        assert abs(both[1] - alone) < 1e-5 and abs(both[2] - net.scores([b"x"])[0]) < 1e-6
    finally:
        quality_model.STEP_BYTES = step


def test_models_on_awkward_rows(spark, awkward):
    labels = spark.createDataFrame([(4, 1, 0), (14, 0, 1), (99, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    docs = awkward.withColumn("toxic", F.lit("t")).withColumn("predicted", F.lit("p"))
    for out in (quality_model.quality_scores(docs, labels, docs.columns), toxicity.severity_scores(docs, labels, docs.columns)):
        assert len(set(out.columns)) == len(out.columns) and set(docs.columns) <= set(out.columns)
        assert out.count() == docs.count()
        assert out.where("severity IS NULL" if "severity" in out.columns else "score IS NULL").count() == 0
    none = labels.limit(0)
    assert quality_model.quality_scores(docs, none, ["doc_id"]).count() == docs.count()
    assert toxicity.severity_scores(docs.limit(0), none, ["doc_id"]).count() == 0


def test_thresholds_are_ordered():
    rows = [np.array([k % 40]) for k in range(400)]
    model = toxicity.fit(rows, np.array([float(k % 40 < 10) for k in range(400)]))
    assert (np.diff(model.thresholds) > 0).all()


def test_secrets(spark, awkward):
    model = secrets.train(spark, secrets.labelled_findings(1200))
    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    texts = [f'so token = "{key}" ends', "see internationalizationoftheconfiguration", None, "", f"set token={key} now", "password: Xk9#mQ2$vL7p, then"]
    found = secrets.scan_secrets(docs_of(spark, texts), model)
    assert sorted((r["doc_id"], r["start"], r["end"]) for r in found.collect()) == [(0, 12, 52), (4, 10, 50), (5, 10, 22)]
    secrets.scan_secrets(awkward, model).count()
    assert secrets.scan_secrets(awkward.limit(0), model).count() == 0
    # spans of unseen findings, and of a format that no training finding has
    rows = secrets.labelled_findings(400, 77)
    r = random.Random(3)
    rows += [("the build uses api_key = '", "glpat-" + "".join(r.choices("abcdefXYZ0123456789_", k=20)), "' here", 1) for _ in range(40)]
    frame = docs_of(spark, [a + t + b for a, t, b, _ in rows])
    got = {(x["doc_id"], x["start"], x["end"]) for x in secrets.scan_secrets(frame, model).collect()}
    want = {(i, len(a), len(a) + len(t)) for i, (a, t, _, y) in enumerate(rows) if y}
    assert len(got & want) > 0.9 * len(want) and len(got - want) < 0.1 * len(got)
    assert sum(i >= 400 for i, _, _ in got & want) >= 36


def test_planted_secrets_of_the_tables(spark):
    got = {(r["doc_id"], r["start"], r["end"]) for r in registry.queries()["op9_secret_forest"](spark, BIGGER).collect()}
    docs = spark.read.parquet(f"{BIGGER}/documents.parquet").select("doc_id", "text").collect()
    want = {(d["doc_id"], *m.span(1)) for d in docs for m in re.finditer(r'token = "([0-9a-f]{40})"', d["text"] or "")}
    assert want and len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.2 * len(want)


def test_candidates_of_training_are_those_of_the_scan():
    for a, t, b, y in secrets.labelled_findings(500, 9):
        spans = secrets.find_candidates(a + t + b)
        assert all(p[1] <= q[0] for p, q in zip(spans, spans[1:], strict=False))
        assert not y or (len(a), len(a) + len(t)) in spans, (a, t, b)


# chat


def brute_cost(roles):
    """Least cost over all ways to keep, merge, relabel and insert, by search over (place, last role)."""
    best = {None if not roles else (0, "start"): 0.0}
    if not roles:
        return 0.0
    states = {(0, "start"): 0.0}
    done = []
    while states:
        (k, last), cost = min(states.items(), key=lambda x: x[1])
        del states[(k, last)]
        if (k, last) in done:
            continue
        done.append((k, last))
        best[(k, last)] = cost
        if k == len(roles) and last == "assistant":
            return cost

        def go(key, c):
            if c < states.get(key, 1e9):
                states[key] = c

        for new in chat.ROLES:
            if (last, new) in chat.LEGAL:
                go((k, new), cost + chat.INSERT)
                if k < len(roles):
                    known = roles[k] in chat.ROLES
                    go((k + 1, new), cost + (0 if roles[k] == new else chat.RELABEL if known else chat.UNKNOWN))
        if k < len(roles) and last != "start":
            known = roles[k] in chat.ROLES
            go((k + 1, last), cost + chat.MERGE + (0 if roles[k] == last else chat.RELABEL if known else chat.UNKNOWN))


def conversations(rows):
    """conv_id -> (cost, turns, text) of the pieces in order."""
    got = {}
    for x in sorted(rows, key=lambda r: r["piece"]):
        cost, turns, text = got.get(x["conv_id"], (x["cost"], 0, ""))
        assert cost == x["cost"]
        got[x["conv_id"]] = (cost, turns + x["turns"], text + x["rendered"])
    return got


@pytest.mark.parametrize("segment", [2, 4096])
def test_repair_against_search(spark, segment):
    r = random.Random(4)
    convs = [[r.choice([*chat.ROLES, "tool", None]) for _ in range(r.randint(1, 7))] for _ in range(80)]
    rows = [(i, k, role, f"t{k}") for i, c in enumerate(convs) for k, role in enumerate(c)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = conversations(chat.format_chat(turns, segment=segment).collect())
    assert set(got) == set(range(80))
    for i, c in enumerate(convs):
        cost, count, text = got[i]
        assert cost == brute_cost(c)
        written = [p.split("\n", 1) for p in text.split("<|im_start|>")[1:]]
        names = [w[0] for w in written]
        assert all(pair in chat.LEGAL for pair in zip(["start", *names], names, strict=False)) and names[-1] == "assistant"
        assert len(written) == count and all(w[1].endswith("<|im_end|>\n") for w in written)
        bodies = [w[1].removesuffix("<|im_end|>\n") for w in written]
        assert [x for body in bodies if body for x in body.split("\n")] == [f"t{k}" for k in range(len(c))]


def test_chat_pieces_do_not_depend_on_partitions(spark, monkeypatch):
    r = random.Random(8)
    rows = [(i % 90 if i % 90 else None, r.randint(0, 9), r.choice(["user", "assistant", None]), f"t{i}" * r.randint(0, 9)) for i in range(700)]
    rows += [(500, k % 37, "user", f"long {k % 50}") for k in range(300)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    whole, pieces = [], []
    monkeypatch.setattr(chat, "SEGMENT_BYTES", 1 << 12)
    for n in (4, 8, 64):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        whole.append(sorted((tuple(x) for x in chat.format_chat(turns, segment=200).collect()), key=str))
        pieces.append(sorted((tuple(x) for x in chat.format_chat(turns, segment=7).collect()), key=str))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert whole[0] == whole[1] == whole[2] and pieces[0] == pieces[1] == pieces[2]
    assert len(whole[0]) == 91 + 1 and len(pieces[0]) > 100  # 300 turns are two segments, all else is one
    assert conversations(chat.format_chat(turns, segment=200).collect()) == conversations(chat.format_chat(turns, segment=7).collect())


def test_rendering_by_hand():
    text, turns, repairs = chat.render(["user", "user", "assistant"], ["a", "b", "c"], 0, 3, True, chat.CHATML)
    assert text == "<|im_start|>user\na\nb<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n" and (turns, repairs) == (2, 1)


def test_chat_on_awkward_rows(spark, monkeypatch):
    rows = [
        (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (2, 0, " Assistant ", ""), (None, 0, "user", "x"),
        (3, 9000, "user", "later"), (3, 1, "system", "first" * 10_000), *[(4, None, "user", "same")] * 50,
    ]
    turns = spark.createDataFrame([(*r, 1.0, "seg") for r in rows], "conv_id long, turn long, role string, text string, cost double, segment string")
    got = conversations(chat.format_chat(turns).collect())
    assert set(got) == {1, 2, 3, 4, None}
    assert got[3][2].index("first") < got[3][2].index("later")
    monkeypatch.setattr(chat, "SEGMENT_BYTES", 64)
    small = chat.format_chat(turns).collect()
    assert conversations(small)[4][0] == got[4][0] and max(r["piece"] for r in small) >= 3
    assert all(len(r["rendered"]) < 1000 or r["conv_id"] == 3 for r in small)
    assert chat.format_chat(turns.limit(0)).count() == 0


# pipeline


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, SF)
    assert kept.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    ids = sorted(texts)
    want = {ids[i] for i, _, root in brute_join([texts[i] for i in ids], 5, 80) if i == root}
    one = corpus_pipeline.near_duplicates(spark, kept, SF)
    assert {r["doc_id"] for r in one.collect()} == want and one.columns == docs.columns
    clean = corpus_pipeline.decontamination(spark, one, SF)
    flat = lambda t: " ".join(t.split())
    items = [flat(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {r["doc_id"] for r in clean.collect()} == {i for i in want if not any(x in flat(texts[i]) for x in items)}
    mixed = corpus_pipeline.mixture(spark, clean, SF)
    assert mixed.columns == docs.columns and mixed.groupBy("doc_id").count().where("count > 3").count() == 0
    assert corpus_pipeline.shards(spark, mixed, SF).count() == mixed.count()


def test_decontamination_judges_rows_of_shared_and_missing_ids(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    rows = [(1, f"before it {item} after it"), (1, prose(4, 60)), (None, f"again {item}"), (None, prose(5, 60)), (2, None), (3, "")]
    kept = corpus_pipeline.decontamination(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[1], *rows[3:]], key=str)


def test_pipeline_stages_on_awkward_rows(spark, awkward):
    docs = awkward.withColumn("_text_key", F.lit("k")).withColumn("_gone", F.lit(1)).withColumn("repeats", F.lit("r"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString(), name
        assert out.where("size <> -1 OR score <> -1 OR _text_key <> 'k' OR repeats <> 'r'").count() == 0
        assert stage(spark, docs.limit(0), SF).count() == 0
