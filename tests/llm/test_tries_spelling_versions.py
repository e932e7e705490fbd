"""The prefix trie, spelling variants and document fingerprints against plain Python, odd rows included."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from brute_trie import brute_trie
from pyspark.sql import functions as F

from strataline.llm import prefix_trie, spelling, versions

TURNS = "conv_id long, turn long, role string, text string, node string, turns int"


def chats(spark):
    rng = random.Random(1)
    rows = []
    for c in list(range(0, 60)) + list(range(100, 130)) + list(range(201, 240)) + [10**12, 10**12 + 7]:
        shape = 7 if c % 3 == 0 else rng.randrange(1, 9)  # a third are copies
        for t in range(shape):
            text = f"t{t}" if c % 3 == 0 else rng.choice(["t0", "t1", "é" * 5, "", None])
            rows.append((c, None if t == 0 and c % 5 == 0 else t, rng.choice(["user", None]) if c % 7 == 0 else "user", text, "x", 1))
    rows += [(None, 0, "user", "lost", "x", 1), (250, 1, "user", "twice", "x", 1), (250, 1, "user", "twice", "x", 1)]
    rows += [(251, t, "user", "y" * 50_000 if t == 3 else "z", "x", 1) for t in range(300)]
    return rows, spark.createDataFrame(rows, TURNS).repartition(5)


@pytest.mark.parametrize("cells", [1 << 20, 64, 1])
def test_trie_matches_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(prefix_trie, "BLOCK_CELLS", cells)
    monkeypatch.setattr(prefix_trie, "IDS_ROWS", 3)
    rows, df = chats(spark)
    got = [tuple(r) for r in prefix_trie.conversation_trie(df).collect()]
    want = brute_trie([r[:4] for r in rows])
    assert len(got) == len(want) and set(got) == want


def test_trie_of_nothing(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], TURNS)).count() == 0
    assert prefix_trie.conversation_trie(spark.createDataFrame([(None, 1, "user", "a", "", 1)], TURNS)).count() == 0


def brute_forms(docs):
    total = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc}:{word}".encode())
            if h % 31 == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            if len(word) >= 7:
                total[word] += 1
    n = {w: k for w, k in total.items() if k >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        if abs(len(a) - len(b)) != 1:
            return False
        short, long = sorted((a, b), key=len)
        return any(long[:i] + long[i + 1:] == short for i in range(len(long)))

    around = {w: [v for v in n if near(w, v)] for w in n}
    form = {w: min(around[w], key=lambda v: (-n[v], v)) if around[w] else None for w in n}
    form = {w: f if f and n[f] >= 10 * n[w] else None for w, f in form.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(around[w]), n[form[w]] if form[w] else None) for w in n}


def test_spelling_matches_brute_force(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdeéÿ") for _ in range(rng.randrange(7, 11))) for _ in range(25)] + ["aaaaaaaa", "Ünicode×Ü", "x" * 5000]
    pool = []
    for i, w in enumerate(base):
        pool += [w] * 10 ** (i % 4)
        for _ in range(6):
            p = rng.randrange(len(w))
            pool += [rng.choice([w[:p] + w[p + 1:], w[:p] + "b" + w[p + 1:], w[:p] + "ÿ" + w[p:]])] * rng.choice([1, 2, 3, 30])
    rng.shuffle(pool)
    docs = [(i, " ".join(pool[i::40]) + "; don't STOPPING stopping") for i in range(40)] + [(50, None), (51, ""), (52, "123 --"), (53, pool[0]), (53, pool[0])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", F.lit("x")).withColumn("n", F.lit(1)).repartition(3)
    got = [tuple(r) for r in spelling.spelling_variants(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_forms(docs)
    assert spelling.spelling_variants(df.limit(0)).count() == 0


def test_full_filters_lose_nothing(spark, monkeypatch):
    words = [(w, i + 2) for i, w in enumerate(sorted({a + "aaaaaa" + b for a in "abcdef" for b in "abcdef"}))]
    df = spark.createDataFrame(words, "word string, n long")
    want = sorted(map(tuple, spelling.near_words(df).collect()))
    monkeypatch.setattr(spelling, "MAX_BLOCKS", 1)
    monkeypatch.setattr(spelling, "BITS_PER_WORD", 1)
    assert sorted(map(tuple, spelling.near_words(df).collect())) == want and len(want) == 36 * 10


def brute_digests(text):
    found = re.findall(r"[^\n]{%d,}?[.!?](?=\s)|[^\n]+" % versions.PARAGRAPH_CHARS, text or "")
    return set(Counter(p for p in (f.strip(" \t\x0b\x0c\r\n") for f in found) if p).items())


def test_versions_match_brute_force(spark):
    rng = random.Random(3)

    def prose(n):
        return "\n".join(" ".join("".join(rng.choice("abcé") for _ in range(5)) for _ in range(8)) + "." for _ in range(n))

    docs = [(i, prose(rng.choice([0, 1, 2, 5, 30, 80]))) for i in range(60)] + [(70, None), (71, ""), (72, "a\na\na"), (73, "a\na"), (74, "one"), (-5, prose(900))]
    docs += [(100 + i, docs[3][1]) for i in range(30)]  # copies
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("_text", F.lit("clash")).withColumn("n_chars", F.lit(0)).repartition(4)
    got = {r["doc_id"]: r for r in versions.document_versions(df).collect()}
    assert len(got) == len(docs)
    ordered = sorted(((i, t or "") for i, t in docs), reverse=True)
    for k, (i, text) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        row = got[i]
        assert row["n_chars"] == len(text) and row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for column, other in (("near_edited", edited), ("near_next", following)):
            a, b = brute_digests(text), brute_digests(other)
            assert row[column] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0), (i, column)
    prints = defaultdict(set)
    for i, t in docs:
        prints[t or ""].add(got[i]["fingerprint"])
    assert all(len(p) == 1 for p in prints.values()) and len({min(p) for p in prints.values()}) == len(prints)


def test_odd_versions(spark):
    schema = "doc_id long, text string"
    assert versions.document_versions(spark.createDataFrame([], schema)).count() == 0
    one = versions.document_versions(spark.createDataFrame([(1, "abcd")], schema)).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and one["near_next"] == 1.0
    rows = versions.document_versions(spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (None, "z"), (None, None)], schema)).collect()
    assert len(rows) == 5 and sum(r["doc_id"] is None for r in rows) == 2


def test_versions_recover_what_differs(spark):
    old = "\n".join(f"line {i}" for i in range(200))
    new = old.replace("line 7\n", "").replace("line 150", "changed") + "\nadded"
    df = spark.createDataFrame([(old, new), (old, old), (None, ""), ("a", None)], "a string, b string")
    rows = versions.compare_versions(df, "a", "b").collect()
    assert [(len(r["only_old"]), len(r["only_new"])) for r in rows] == [(2, 2), (0, 0), (0, 0), (1, 0)]
    assert [r["likeness"] for r in rows] == [pytest.approx(198 / 202), 1.0, 1.0, 0.0]
    cells = df.select(versions.sketch(versions.paragraph_digests(F.col("a"))).alias("c")).select("c", versions.cells_of(versions.fingerprint_text(F.col("c"))).alias("d"))
    assert all(r["c"] == r["d"] for r in cells.collect())
