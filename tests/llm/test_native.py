"""The native operators: line rules, spans, mixing and shards, against SQL, brute force and awkward rows."""

import hashlib
import re

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pointweave.llm import mixing, pii, quality_rules, registry, sharding
from tests.compare import SF, rows_of, spark_rows, sql_rows

GIVEN = ["op3_pii_spans", "op4_mix_sources", "op8_line_rules"]


@pytest.mark.parametrize("name", GIVEN)
def test_same_rows_as_sql(spark, name):
    assert spark_rows(registry.queries()[name](spark, SF)) == sql_rows(registry.oracle_sql()[name])


def test_crc_of_shards_against_zlib(spark):
    import zlib

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in sharding.shard_by_bytes(docs).collect()}
    texts = {r["doc_id"]: r["text"].encode() for r in docs.select("doc_id", "text").collect()}
    assert {i: (r["size"], r["text_crc32"]) for i, r in got.items()} == {i: (len(t) + 8, zlib.crc32(t)) for i, t in texts.items()}


def brute_repeats(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    return len({p for i, g in enumerate(grams) if grams.count(g) > 1 for p in (i, i + 1, i + 2)})


def test_line_rules_on_awkward_rows(spark, awkward):
    clashing = awkward.withColumn("n_words", F.lit("x")).withColumn("kept", F.lit("x")).withColumn("_lines", F.lit("x"))
    got = quality_rules.quality_rules(clashing)
    assert len(set(got.columns)) == len(got.columns) and dict(got.dtypes)["n_words"] == "bigint"
    by = {r["doc_id"]: r for r in got.collect()}
    assert got.count() == awkward.count()
    for i in (1, 2, 3):
        assert (by[i]["n_words"], by[i]["word_chars"], by[i]["base_failed"], by[i]["kept"]) == (0, 0, True, False)
    assert by[7]["n_words"] == 60_000
    assert by[13]["n_words"] == 1 and by[13]["word_chars"] == 50_000
    texts = {r["doc_id"]: r["text"] for r in awkward.collect() if r["text"] and len(r["text"]) < 5000}
    for i, t in texts.items():
        assert by[i]["n_repeat_words"] == brute_repeats(t)
    assert quality_rules.quality_rules(awkward.select("doc_id", "text").limit(0)).count() == 0


def test_line_rules_remove_failing_lines(spark):
    text = "A plain sentence of words.\nHome | About | Contact | Terms\nLicensed under the Apache License.\nBUY!! NOW!! OR!! NEVER!!\n$$ %% ##\nA plain sentence of words."
    r = quality_rules.quality_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r["clean_text"] == "A plain sentence of words.\nA plain sentence of words."
    assert r["n_dup_lines"] == 1 and r["lost_words"] == 7 + 5 + 4 + 3
    assert r["n_repeat_words"] == 10


def base_spans(text):
    def luhn(d):
        return sum(v if k % 2 == 0 else v * 2 - 9 * (v > 4) for k, v in enumerate(map(int, reversed(d)))) % 10 == 0

    out = []
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 13 <= len(d) <= 19 and luhn(d),
                "phone": 9 <= len(d) <= 15,
            }[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_spans_against_regular_expressions(spark):
    texts = [
        "", "a@b.c_d@e.f x@y", "é𝄞 mail me: a.b+c@d-e.f.g, or @x.y", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 1.2.3",
        "4111 1111 1111 1111 and 4111-1111-1111-1112 42", "+1 (415) 555-2671 +12 3 +1..........2 +123456789012345678",
        "4111111111111111" * 3, "a" * 3000 + "@", "1" * 3000, "x@y." + "z." * 500 + "com", " ".join(f"u{i}@h{i}.org" for i in range(300)),
        "card 4111111111111111+49 30 1234567", "99999999999999999999.1.1.1",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    base = [k.name for k in pii.KINDS if k.base]
    got = pii.find_pii(df).select("doc_id", F.filter("pii", lambda s: s["kind"].isin(base)).alias("p")).collect()
    for r in got:
        assert [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["p"]] == base_spans(texts[r["doc_id"]])


def test_checksums_and_context_add_spans(spark):
    texts = [
        "IBAN GB82 WEST 1234 5698 7654 32 end", "IBAN GB83 WEST 1234 5698 7654 32 end", "passport 123456789", "number 123456789",
    ]
    got = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [[s["kind"] for s in r["pii"]] for r in got] == [["iban"], [], ["account"], []]
    assert got[0]["pii"][0]["score"] == 1.0


def test_spans_on_awkward_rows(spark, awkward):
    got = pii.find_pii(awkward)
    assert got.count() == awkward.count()
    assert {r["doc_id"] for r in got.where("size(pii) = 0").collect()} >= {1, 2, 3}
    assert pii.find_pii(awkward.limit(0)).count() == 0


def test_mix_on_awkward_rows(spark, awkward):
    size = mixing.word_count(F.col("text"))
    docs = awkward
    out = mixing.mix(docs, size)
    rows = out.collect()
    assert len(rows) == docs.count()
    assert spark_rows(out.select("doc_id", "size", "repeats", "extra")) == spark_rows(mixing.mix(docs, size).select("doc_id", "size", "repeats", "extra"))
    taken, target = {}, {}
    for r in rows:
        t = r["repeats"] * r["size"] + r["extra"]
        assert 0 <= t <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + t
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert mixing.mix(docs.limit(0), size).count() == 0
    nothing = docs.where("text IS NULL")
    assert [r["extra"] + r["repeats"] * r["size"] for r in mixing.mix(nothing, size).collect()] == [0] * nothing.count()


def test_quotas_against_rounds(spark):
    sizes = {"a": 100, "b": 5, "c": 400, "d": 0, "e": 3000, None: 7}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_quotas(df).collect()}
    names = ["a", "b", "c", "d", "e", None]
    weight = dict(zip(names, (5, 2, 1, 5, 2, 1), strict=True))
    fixed, total = {}, float(sum(sizes.values()))
    while True:
        free = [s for s in names if s not in fixed]
        left, w = total - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w >= 3 * sizes[s]]
        if not over:
            break
        fixed.update({s: 3.0 * sizes[s] for s in over})
    want = fixed | {s: left * weight[s] / w for s in free}
    assert all(abs(got[s] - want[s]) < 1e-9 for s in names)


def test_shards_on_awkward_rows(spark, awkward):
    out = sharding.shard_by_bytes(awkward, 5)
    rows = out.collect()
    assert len(rows) == awkward.count()
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert spark_rows(out) == spark_rows(sharding.shard_by_bytes(awkward.repartition(3), 5))
    assert sharding.shard_by_bytes(awkward.limit(0)).count() == 0
    docs = spark.createDataFrame([(i, "x" * (i % 7)) for i in range(3000)], "doc_id long, text string")
    sizes = [r["b"] for r in sharding.shard_by_bytes(docs).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 24 and max(sizes) - min(sizes) <= 2 * 15


def test_shard_sql_on_a_few_texts(spark):
    frame = pa.table({"doc_id": [1, 2, 3, 4], "text": ["é", None, "", "ab" * 200]})
    docs = spark.createDataFrame([(1, "é"), (2, None), (3, ""), (4, "ab" * 200)], "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", frame)
    out = con.execute(sharding.SQL)
    want = rows_of([c[0] for c in out.description], out.fetchall())
    got = sharding.shard_by_bytes(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
    assert spark_rows(got) == want


def test_digest_is_of_the_joined_spans(spark):
    r = registry.queries()["op3_pii_spans"](spark, SF).where("n_email + n_ip + n_card + n_phone = 0").first()
    assert r["base_sha256"] == hashlib.sha256(b"").hexdigest()
