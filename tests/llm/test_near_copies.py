"""Near copies by five-word similarity against brute force over all pairs."""

import random
from itertools import combinations

import pytest

from strataline.llm import components as link_groups, near_copies, passages

FOLDER = "/root/testdata/sf0.001"


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def similarity(a, b):
    return len(a & b) / len(a | b)


def slow_groups(texts):
    """The least index that each text reaches through pairs of similarity 0.8 or more."""
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        if root[i] != root[j] and 0.8 * len(sets[i]) <= len(sets[j]) <= len(sets[i]) / 0.8 and similarity(sets[i], sets[j]) >= 0.8:
            low, high = sorted((root[i], root[j]))
            root = [low if r == high else r for r in root]
    return root


def groups_of(spark, texts):
    rows = spark.createDataFrame([(1000 + i, i, t) for i, t in enumerate(texts)], "row long, id long, text string")
    found = near_copies.near_copy_groups(rows).collect()
    assert len(found) == len(texts)
    return [r["first_row"] - 1000 for r in sorted(found)]


def edited(rnd, words, n):
    out = list(words)
    for place in rnd.sample(range(len(out)), n):
        out[place] = f"new{rnd.random()}"
    return out


def test_given_documents(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    assert groups_of(spark, texts) == slow_groups(texts)


def test_planted_copies(spark):
    """Pairs around similarity 0.8, in short and long texts, most of them further apart than anchors reach."""
    rnd = random.Random(3)
    texts = []
    for i in range(150):
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.choice([45, 90, 400, 1500]))]
        texts += [" ".join(words), " ".join(edited(rnd, words, max(1, len(words) // rnd.choice([46, 50, 70, 200]))))]
    expected = slow_groups(texts)
    copies = sum(e != i for i, e in enumerate(expected))
    found = groups_of(spark, texts)
    assert copies > 100 and all(f in (e, i) for i, (f, e) in enumerate(zip(found, expected)))
    assert sum(f == e != i for i, (f, e) in enumerate(zip(found, expected))) >= 0.98 * copies


@pytest.mark.parametrize("edits", [2, 6])
def test_one_text_with_many_variants(spark, edits):
    """Variants of one text: most pairs are similar, or few; links must not be lost to the choice of a leader."""
    rnd = random.Random(edits)
    words = [f"w{i}" for i in range(300)]
    chain = [words]
    for _ in range(120):
        chain.append(edited(rnd, rnd.choice(chain[:30]), edits))
    texts = [" ".join(w) for w in chain]
    rnd.shuffle(texts)
    expected, found = slow_groups(texts), groups_of(spark, texts)
    assert sum(f == e for f, e in zip(found, expected)) >= 0.98 * len(texts)


def test_repetition_counts_once(spark):
    """The same shingles, one line once and two hundred times."""
    rnd = random.Random(9)
    head = " ".join(f"w{rnd.randrange(900)}" for _ in range(200))
    line = " ".join(f"x{i}" for i in range(12))
    assert groups_of(spark, [head + " " + line, head + " " + " ".join([line] * 200)]) == [0, 0]


def test_odd_rows(spark):
    """Null and repeated ids, texts without words, short texts, rows repeated, an empty table, a clashing column."""
    long_text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, None, 1), (3, "", 2), (2, " \n", 3), (5, "one two", 4), (5, "ONE\ttwo", 5), (5, "one three", 6), (7, long_text, 7),
            (7, long_text, 7), (None, long_text + " more", 8), (None, "alone", 9), (7, "another", 10), (1, "x " * 20_000, 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row long")
    kept = near_copies.keep_first_copies(docs)
    assert kept.columns == docs.columns
    got = sorted((r["_row"] for r in kept.collect()))
    assert got[0] == 3 and got[1] in (4, 5) and got[2:] == [6, 7, 9, 10, 11]
    assert near_copies.keep_first_copies(docs.limit(0)).count() == 0


# passages

def passage_texts(pairs):
    """Two texts for each pair, that share a passage of 60 words with one word of it changed."""
    rnd = random.Random(21)
    fresh = lambda n: [f"w{rnd.randrange(10 ** 6)}" for _ in range(n)]
    texts = []
    for _ in range(pairs):
        passage = fresh(60)
        changed = edited(rnd, passage[5:-5], 1)
        texts += [" ".join(fresh(80) + words + fresh(80)) for words in (passage, passage[:5] + changed + passage[-5:])]
    return texts


def passages_of(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return passages.repeated_passages(docs).collect()


def test_passages_with_a_changed_word(spark):
    """Shingle similarity 0.836: the changed word may leave few matches on one side of it."""
    texts = passage_texts(120)
    found = {(r["doc_id"], r["other_id"]) for r in passages_of(spark, list(enumerate(texts)))}
    pairs = {(2 * k + 1, 2 * k) for k in range(120)}
    assert len(found & pairs) >= 0.95 * 120 and {max(p) // 2 for p in found} == {min(p) // 2 for p in found}


def test_passages_of_texts_that_share_an_id(spark):
    texts = passage_texts(4)
    one_id = passages_of(spark, [(7, t) for t in texts] + [(7, "short"), (7, texts[0]), (None, texts[0])])
    assert one_id and {(r["doc_id"], r["other_id"]) for r in one_id} == {(7, 7)}
    two_ids = passages_of(spark, [(i % 2, t) for i, t in enumerate(texts)] + [(0, "short " * 3), (1, texts[0])])
    assert {(r["doc_id"], r["other_id"]) for r in two_ids} >= {(1, 0)}
    assert any(r["similarity"] == 1.0 and r["stop"] == len(texts[0].split()) for r in two_ids)


def test_texts_that_only_their_base_resembles_are_not_compared(spark, monkeypatch):
    """Variants of one text that are too far from it, and so from one another, to be linked: pairs grow with the group, not with its square."""
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(150)]
    texts = [" ".join(edited(rnd, words, 1 + i % 6)) for i in range(200)] + [" ".join(words)]
    compared = []
    similar_pairs = near_copies.similar_pairs
    monkeypatch.setattr(near_copies, "similar_pairs", lambda pairs, *rest: compared.append(pairs.count()) or similar_pairs(pairs, *rest))
    expected, found = slow_groups(texts), groups_of(spark, texts)
    assert sum(f == e for f, e in zip(found, expected)) >= 0.98 * len(texts)
    assert sum(compared) <= 15 * len(texts)


def test_variants_that_all_miss_the_similarity_are_not_compared(spark, monkeypatch):
    """Each pair of variants has a similarity of about 0.66, and shingles that one text alone has do not rule it out."""
    rnd = random.Random(10)
    words = [f"w{i}" for i in range(150)]
    texts = [" ".join(edited(rnd, words, 3)) for _ in range(150)]
    texts += [" ".join(edited(rnd, text.split(), 1)) for text in texts[:20]]
    compared = []
    similar_pairs = near_copies.similar_pairs
    monkeypatch.setattr(near_copies, "similar_pairs", lambda pairs, *rest: compared.append(pairs.count()) or similar_pairs(pairs, *rest))
    expected, found = slow_groups(texts), groups_of(spark, texts)
    assert sum(f == e for f, e in zip(found, expected)) >= 0.98 * len(texts) and len(set(expected)) < len(texts) - 15
    assert sum(compared) <= 15 * len(texts)


@pytest.mark.parametrize("similarity", [0.8, 0.5])
def test_parities_rule_no_similar_pair_out(spark, similarity):
    """Sets of all sizes, pairs just similar enough and their parities of equal and of other lengths."""
    import numpy as np

    rnd = np.random.default_rng(6)
    rows, differing = [], []
    for n in [1, 2, 9, 63, 64, 65, 100, 127, 129, 500, 1023, 1025, 4000]:
        for part in (0.0, 0.3, 1.0):
            one = np.unique(rnd.integers(0, 2 ** 63, n).astype(np.uint64))
            most = int((1 - similarity) * n)  # left out of one and put into the other, so that the pair stays similar
            other = np.unique(np.append(one[int(most * part):], rnd.integers(0, 2 ** 63, int(most * (1 - part) / 2)).astype(np.uint64)))
            rows.append((near_copies.parities(one).tolist(), near_copies.parities(other).tolist()))
            differing.append(len(np.setxor1d(one, other)))
    df = spark.createDataFrame(rows, "a array<long>, b array<long>").select(near_copies._odd_bits("a", "b").alias("n"))
    found = [r["n"] for r in df.collect()]
    assert all(0 <= n <= most and (n - most) % 2 == 0 for n, most in zip(found, differing)) and any(len(a) != len(b) for a, b in rows)
    assert sum(found) > 0.8 * sum(differing)


def test_passages_of_a_chain_of_variants_stay_connected(spark):
    rnd = random.Random(31)
    fresh = lambda n: [f"w{rnd.randrange(10 ** 6)}" for _ in range(n)]
    hashes = passages.Shingler()
    while True:  # a passage whose variants have the same least shingle under both functions, half a passage before any change
        variants = [fresh(50)]
        for place in (30, 36, 42):
            variants.append(variants[-1][:place] + fresh(1) + variants[-1][place + 1:])
        bases = [hashes.shingles(" ".join(v), 5) for v in variants]
        if all(int(passages.mixed(b, fn).argmin()) <= 2 for b in bases for fn in (1, 2)):
            break
    # neighbours of the chain are similar, others are not; the two ends have the least ids and lead first
    texts = [" ".join(fresh(80) + variants[k]) for k in (0, 3, 1, 2) for _ in range(9)]
    of = list(range(len(texts)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in passages.repeated_passages(docs, hashes=2).collect():
        one, two = of[r["doc_id"]], of[r["other_id"]]
        of = [min(one, two) if x in (one, two) else x for x in of]
    assert set(of) == {0}


def test_passages_with_keys_of_a_small_and_a_large_group_are_compared(spark, monkeypatch):
    """Two texts share one key with each other and one with 18 more; beside the place of that one all shingles differ."""
    rnd = random.Random(41)
    fresh = lambda n: [f"w{rnd.randrange(10 ** 6)}" for _ in range(n)]
    one, c = fresh(600), 300
    two = list(one)
    for place in [*range(c - 1, c - 27, -5), *range(c + 5, c + 30, 5)]:
        two[place] = "changed" + str(place)
    texts = [" ".join(x) for x in [fresh(100), one, two, *(fresh(100) for _ in range(17))]]

    def windows(rows, *_):
        doc = {r["text"]: r["doc"] for r in rows.collect()}
        found = [(100, doc[t], 0, 0, 50, 250) for t in texts[1:3]]
        found += [(200, doc[t], 1, 0, c if t in texts[1:3] else 0, 595 if t in texts[1:3] else 95) for t in texts]
        return spark.createDataFrame(found, "key long, doc long, fn int, l int, c int, r int")

    monkeypatch.setattr(passages, "text_windows", windows)
    found = {(r["doc_id"], r["other_id"], r["start"], r["stop"], r["n_hashes"]) for r in passages_of(spark, list(enumerate(texts)))}
    assert found == {(2, 1, 0, 600, 2), (1, 2, 0, 600, 2)}


def test_few_spans_of_edited_copies_are_compared(monkeypatch):
    """Copies with a word changed in every 25: each hit has many spans that matches outweigh, and all miss the similarity."""
    import numpy as np

    rnd = np.random.default_rng(8)
    words = rnd.integers(0, 2 ** 62, 1500).astype(np.uint64)
    other = words.copy()
    other[rnd.permutation(1500)[:60]] += np.uint64(2 ** 40)
    one, other = (passages.mixed(sum(w[i:i + 1496] * np.uint64(2 * i + 3) for i in range(5)), 0) for w in (words, other))
    hits = [(k % 4, max(c - 80, 0), c, min(c + 80, 1495), max(c - 80, 0), c, min(c + 80, 1495))
            for k, c in enumerate(np.flatnonzero(one == other)[::5].tolist())]
    calls, unique = [], np.unique
    monkeypatch.setattr(np, "unique", lambda *a, **k: calls.append(1) or unique(*a, **k))
    found = passages.matched_passages(one, other, hits, 46, 0.8, 2)
    assert len(found) == 18 and all(p[4] >= 0.8 for p in found)
    assert len(calls) <= 500  # 78,272 with every span compared


def test_replicas_of_few_prints_are_not_one_partition(spark):
    from strataline.llm import simhash

    prints = spark.range(300).selectExpr("xxhash64(id) as fp").coalesce(1)
    assert simhash.anchor_replicas(prints).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1


def named_tables(monkeypatch, module):
    """The (name, columns) of the tables that ``module`` writes from now on."""
    written, write = [], module.materialise

    def noted(df, name="stage"):
        written.append((name, df.columns))
        return write(df, name)

    monkeypatch.setattr(module, "materialise", noted)
    return written


def test_stars_are_settled_without_a_further_round(spark, monkeypatch):
    written = named_tables(monkeypatch, link_groups)
    links = [(1, n) for n in range(2, 30)] + [(50, 60), (70, 50), (60, 50), (80, 80), (None, 3)]
    found = link_groups.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
    assert sorted(map(tuple, found)) == [(n, 1) for n in range(1, 30)] + [(50, 50), (60, 50), (70, 50)]
    assert sum(name == "small-star" for name, _ in written) == 1


def test_components_of_paths_and_random_links(spark):
    rnd = random.Random(5)
    path = rnd.sample(range(1000, 1060), 60)
    links = list(zip(path, path[1:])) + [(rnd.randrange(120), rnd.randrange(120)) for _ in range(70)] + [(rnd.randrange(120), 7)]
    root = {n: n for link in links for n in link if link[0] != link[1]}
    for a, b in links:
        if a != b:
            low, high = sorted((root[a], root[b]))
            root = {n: low if r == high else r for n, r in root.items()}
    found = link_groups.components(spark.createDataFrame(links + links[:9], "a long, b long"), "a", "b").collect()
    assert sorted(map(tuple, found)) == sorted(root.items())


def test_buckets_hold_no_min_hashes_of_texts_that_share_none(spark, monkeypatch):
    """Each text is in 17 buckets: what is shuffled for all of them is narrow."""
    rnd = random.Random(8)
    texts = [" ".join(f"w{rnd.randrange(500)}" for _ in range(60)) for _ in range(20)]
    written = named_tables(monkeypatch, near_copies)
    assert groups_of(spark, texts + [texts[4] + " end"]) == [*range(20), 4]
    assert dict(written)["buckets"] == ["key", "cls"]


def test_pairs_that_share_too_few_shingles_have_no_passage_grown():
    import numpy as np

    class Untouched(list):
        def __iter__(self):
            raise AssertionError("looked at")

    one, other = np.arange(100, dtype=np.uint64), np.arange(1000, 1100, dtype=np.uint64)
    hits = [(fn, 0, 20, 99, 0, 20, 99) for fn in (0, 1)]
    other[:36] = one[:36]
    assert passages.matched_passages(one, other, Untouched(hits), 46, 0.8, 2) == []
    other[:50] = one[:50]
    assert [p[:4] for p in passages.matched_passages(one, other, hits, 46, 0.8, 2)] == [(0, 49, 0, 49)]
