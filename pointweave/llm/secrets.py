"""Secret scan: patterns find candidates, a random forest on their shape and surroundings removes false positives."""

from __future__ import annotations

import base64
import math
import random
import re
import uuid
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Runs that can be a secret: long enough, in the alphabets of keys and encodings; = only fills up an encoding's end.
RUN = re.compile(r"(?<![A-Za-z0-9_+/.~-])[A-Za-z0-9_+/.~-]{16,}={0,2}")
#: Values after a key word and an assignment; they may be shorter and hold other symbols.
KEYED = re.compile(
    r"(?i)(?:(?:secret|token|passw(?:or)?d|passphrase|pwd|api[_-]?key|access[_-]?key|credentials?)[\"']?\s{0,4}[:=]|bearer(?=\s))"
    r"\s{0,4}[\"'`]?([^\s\"'`<>]{8,})"
)
#: Code points around a candidate from which path and neighbouring words are read.
AROUND = 48
KEY_WORDS = re.compile(r"(?i)(secret|token|passw|passwd|api.?key|access.?key|credential|private|auth|bearer|pwd)")
OTHER_WORDS = re.compile(r"(?i)(sha-?(1|256|512)|md5|checksum|digest|hash|commit|revision|uuid|guid|version|etag|build|id)\b")
PATH = re.compile(r"(://|www\.|\.(com|org|net|html?|php|png|jpe?g|js|css|py|txt)\b|[a-z]{3,}/[a-z]{3,})", re.I)
#: Words of identifiers that any corpus has; the dictionary is these and the corpus's own frequent words.
WORDS = (
    "with this that from have data name file path user your here test example config service request response client"
    " server index page image style script module package class method function value string number object array list"
    " table column error message info debug time date year version update create delete insert select return null true"
    " false token secret password change default placeholder"
).split()
#: Frequent words of a corpus that are learned at most, documents that such a word needs, and their lengths.
DICTIONARY_WORDS, DICTIONARY_LEAST, SHORTEST, LONGEST = 5000, 20, 4, 12
FEATURES = (
    "length", "transitions", "digits", "upper", "symbols", "hex", "entropy", "longest_letters", "dictionary", "vowels",
    "path", "assigned", "quoted", "key_word", "other_word",
)
TRAIN_FINDINGS, TREES, DEPTH, SEED = 3000, 30, 8, 5
THRESHOLD = 0.5


def find_candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of the candidates of a text, in order and apart; a keyed value goes before a run inside it."""
    found = []
    for m in KEYED.finditer(text):
        end = m.start(1) + len(m[1].rstrip(".,;:!?)]}"))
        if end - m.start(1) >= 8:
            found.append((m.start(1), end))
    keyed, k = list(found), 0
    for m in RUN.finditer(text):
        end = m.start() + len(m[0].rstrip(".~-"))
        while k < len(keyed) and keyed[k][1] <= m.start():
            k += 1
        if end - m.start() >= 16 and not (k < len(keyed) and keyed[k][0] < end):
            found.append((m.start(), end))
    return sorted(found)


def covered(token: str, dictionary: frozenset[str]) -> int:
    """Characters of a token that dictionary words cover, the longest from the left first."""
    low, at, got = token.lower(), 0, 0
    while at < len(low):
        for n in range(min(LONGEST, len(low) - at), SHORTEST - 1, -1):
            if low[at : at + n] in dictionary:
                got += n
                at += n
                break
        else:
            at += 1
    return got


def describe(left: str, token: str, right: str, dictionary: frozenset[str]) -> list[float]:
    """The FEATURES of a candidate between the text to its left and right."""
    n = len(token)
    kind = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "s" for c in token]
    counts = {c: token.count(c) for c in set(token)}
    entropy = -sum(v / n * math.log2(v / n) for v in counts.values())
    letters = max((len(m) for m in re.findall("[A-Za-z]+", token)), default=0)
    near = left[-AROUND:]
    return [
        float(n),
        sum(a != b for a, b in zip(kind, kind[1:], strict=False)) / n,
        kind.count("d") / n,
        kind.count("u") / n,
        kind.count("s") / n,
        sum(c in "0123456789abcdefABCDEF" for c in token) / n,
        entropy,
        letters / n,
        covered(token, dictionary) / n,
        sum(c in "aeiouAEIOU" for c in token) / n,
        float(bool(PATH.search(near[-12:] + token + right[:8]))),
        float(bool(re.search(r"[:=]\s*[\"'`]?$", left))),
        float(left[-1:] in "\"'`" and right[:1] in "\"'`" and left[-1:] != ""),
        float(bool(KEY_WORDS.search(near))),
        float(bool(OTHER_WORDS.search(near))),
    ]


def described(text: str, dictionary: frozenset[str]):
    """(start, end, features) of each candidate of a text; training and scan both read candidates through here."""
    for s, e in find_candidates(text):
        yield s, e, describe(text[max(0, s - AROUND) : s], text[s:e], text[e : e + AROUND], dictionary)


def labelled_findings(n: int = TRAIN_FINDINGS, seed: int = SEED, words=tuple(WORDS)) -> list[tuple[str, str, str, int]]:
    """(left, token, right, label): seeded findings as a reviewer labels them.

    Secrets are keys of the usual formats, mostly after a key word; the rest are digests, identifiers, versions, paths,
    long words, repeated characters and placeholders, some of them after a key word too.
    """
    r = random.Random(seed)
    words = list(words)
    hexes = lambda k: "".join(r.choices("0123456789abcdef", k=k))
    chars = lambda k: "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=k))
    word = lambda: "".join(r.choice(words + ["er", "on", "re", "st", "en", "ly", "ch"]) for _ in range(r.randint(4, 8)))
    pseudo = lambda: "".join(r.choice("bcdfghklmnprstvwzh") + r.choice(["a", "e", "i", "o", "u", "er", "sch", "ch", "tz", "en"]) for _ in range(r.randint(6, 10)))
    symbols = lambda k: chars(k // 2) + r.choice("!@#$%^&*") + chars(k - k // 2 - 1)
    prose = lambda: " ".join(r.choices(words, k=5)) + " "
    keyed = ["token = ", "secret: ", "api_key=", "password = ", "access_key: ", "Authorization: Bearer ", "auth_token="]
    other = ["sha256: ", "commit ", "checksum=", "uuid: ", "md5 ", "build ", "digest = ", "etag: "]
    out = []
    for _ in range(n):
        quote = r.choice(["", '"', "'"])
        if r.random() < 0.5:
            token = r.choice([
                lambda: hexes(r.choice([32, 40, 48, 64])), lambda: chars(r.randint(20, 64)), lambda: hexes(40),
                lambda: "AKIA" + chars(16).upper(), lambda: "ghp_" + chars(36), lambda: "sk_live_" + chars(24),
                lambda: base64.b64encode(r.randbytes(r.randint(18, 48))).decode(), lambda: "xoxb-" + chars(12) + "-" + chars(24),
                lambda: symbols(r.randint(10, 20)),
            ])()
            lead = r.choice(keyed) if len(token) < 24 or r.random() < 0.85 else prose()
            out.append((prose() + lead + quote, token, quote + " " + prose(), 1))
        else:
            token, lead = r.choice([
                lambda: (hexes(r.choice([32, 40, 64])), r.choice(other)), lambda: (str(uuid.UUID(int=r.getrandbits(128))), r.choice(["", "uuid: ", "id "])),
                lambda: (word(), r.choice(["", *keyed])), lambda: ("/".join(word()[:9] for _ in range(4)), r.choice(["", "/", "https://"])),
                lambda: (".".join(str(r.randint(0, 999)) for _ in range(6)), "version "), lambda: (r.choice("x*0a-_") * r.randint(16, 60), r.choice(["", *keyed])),
                lambda: (word().upper(), ""), lambda: (pseudo().upper(), ""), lambda: (pseudo().upper(), ""), lambda: (pseudo(), ""), lambda: (word() + "." + word()[:8] + ".com", ""), lambda: ("".join(r.choices("0123456789", k=r.randint(16, 19))), ""),
                lambda: ("your_" + r.choice(["token", "secret", "api_key"]) + "_goes_here", r.choice(keyed)), lambda: ("".join(word()[:7].title() for _ in range(3)), "class "),
                lambda: (r.choice(words) + r.choice(words), r.choice(keyed)), lambda: (pseudo()[:12], r.choice(keyed)),
            ])()
            out.append((prose() + lead + quote, token, quote + " " + prose(), 0))
    return out


@dataclass
class SecretModel:
    forest: RandomForestClassificationModel
    dictionary: frozenset[str]


def corpus_words(docs: DataFrame) -> list[str]:
    """The words of SHORTEST to LONGEST letters in at least DICTIONARY_LEAST documents, the most frequent first.

    Counts cover every whole text; DICTIONARY_WORDS bounds what comes to the driver.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(f"\\b[a-z]{{{SHORTEST},{LONGEST}}}\\b"), F.lit(0)))
    count = docs.select(F.explode(words).alias("word")).groupBy("word").count().where(F.col("count") >= DICTIONARY_LEAST)
    return [r["word"] for r in count.orderBy(F.desc("count"), "word").limit(DICTIONARY_WORDS).collect()]


def train(spark: SparkSession, findings: list[tuple[str, str, str, int]], words=()) -> SecretModel:
    """A forest from labelled findings; their candidates are found as those of a scan, others than the finding are none."""
    dictionary = frozenset([*WORDS, *words])
    rows = [
        (*x, float(y == 1 and (s, e) == (len(a), len(a) + len(t))))
        for a, t, b, y in findings
        for s, e, x in described(a + t + b, dictionary)
    ]
    frame = spark.createDataFrame(rows, [*FEATURES, "label"])
    forest = RandomForestClassifier(
        featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, subsamplingRate=0.8
    )
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(frame)
    return SecretModel(forest.fit(ready), dictionary)


def candidates(docs: DataFrame, dictionary: frozenset[str]) -> DataFrame:
    """(doc_id, start, end, token, features...) of every candidate in every whole text; offsets count code points."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionary)

    def run(batches):
        for pdf in batches:
            rows = [
                (i, s, e, t[s:e], *x)
                for i, t in zip(pdf["doc_id"], pdf["text"], strict=True)
                if t
                for s, e, x in described(t, shared.value)
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "end", "token", *FEATURES])

    features = ", ".join(f"{f} double" for f in FEATURES)
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id long, start long, end long, token string, {features}")


def scan_secrets(docs: DataFrame, model: SecretModel, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, start, end, token, score) of the candidates that the forest keeps.

    A candidate is a run of 16 characters or more, or a value of 8 or more after a key word and an assignment. Null,
    empty and candidate-free texts give no rows; equal texts give equal findings each; other columns are ignored.
    """
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(candidates(docs, model.dictionary))
    scored = model.forest.transform(ready).withColumn("score", vector_to_array("probability")[1])
    return scored.where(F.col("score") >= threshold).select("doc_id", "start", "end", "token", "score")


def op9_secret_forest(spark, sf_dir) -> DataFrame:
    """Findings without the secrets themselves: their place and score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_secrets(docs, train(spark, labelled_findings(), corpus_words(docs)))
    return found.select("doc_id", "start", "end", "score")
