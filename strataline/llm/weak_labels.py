"""Quality without labels: overlapping heuristics, a label model and a hashed linear scorer.

Each heuristic votes good (2), bad (0) or abstains (1) on a whole text. A row's votes make one number, its
pattern; how many rows have each pattern is all that expectation-maximisation needs, so the label model uses
every row while the driver holds at most 3**n counts. The model estimates how often each heuristic is right
in each class; the posterior of its pattern is the soft label of a row. A hashed linear scorer trained on these labels gives
the verdicts. Two label models work side by side, one for prose quality and one for abuse.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialise
from .batches import WORD_SPACE, map_columns, struct
from .hashed import WordIndex, sigmoid, train
from .quality_rules import fit_heads, repeated_lines, repeated_words

#: Rows that the scorer is fitted on at most, for each head half of them likely bad; the least hashes of the ids.
TRAIN_ROWS = 4000
#: Fixed thresholds of the verdict.
MIN_QUALITY, MAX_TOXIC = 0.5, 0.5
QUALITY_VOTERS = ("symbols", "capitals", "repeats", "word_length", "lines", "endings", "shouts", "fragments")
TOXIC_VOTERS = ("insult", "keyword", "two_hits", "share_of_hits", "kinds_of_hits")
#: Voters that a class of bad rows may start from; the others only lend weight.
QUALITY_FOUNDERS = ("symbols", "capitals", "repeats", "word_length", "fragments")
TOXIC_FOUNDERS = ("insult", "keyword")
#: A founder is taken to be wrong about this share of the good rows at most; without that, voters that never meet
#: in a row could as well be the noise of good rows.
FOUNDER_ERROR = 0.005
#: Common insults; a parameter of the abuse heuristics, replace it for other languages or tastes.
INSULTS = (
    "idiot", "idiots", "idiotic", "moron", "morons", "moronic", "imbecile", "stupid", "dumb", "dumbass", "fool",
    "loser", "losers", "scum", "scumbag", "trash", "garbage", "worthless", "pathetic", "disgusting", "clown",
    "clowns", "jerk", "creep", "freak", "pig", "vermin", "filth", "filthy", "bastard", "bitch", "asshole", "shit",
    "fuck", "fucking", "cunt", "whore", "slut", "retard", "retarded", "crap", "bullshit", "dickhead", "twat", "wanker",
)


_PUNCTUATION = b".,;:!?\"'()#*$%&|<>"


def _vote(value: float, good: float, bad: float) -> int:
    """2 up to ``good``, 0 from ``bad``, 1 between."""
    return 2 if value <= good else 0 if value >= bad else 1


def quality_votes(text: str, words: list[bytes], local_ids) -> list[int]:
    """The votes of QUALITY_VOTERS; a text without words is bad for all."""
    n = len(words)
    if not n:
        return [0] * len(QUALITY_VOTERS)
    lines = [line for line in text.split("\n") if line.strip(WORD_SPACE)]
    upper = sum(map(str.isupper, text)) if text.upper() == text or n < 3 else None
    letters = sum(map(str.isalpha, text)) if upper is not None else 0
    capitals = upper / letters if letters else None
    if capitals is None:
        shouted = sum(1 for w in words if len(w) > 3 and w.isupper())
        long_words = sum(1 for w in words if len(w) > 3)
        capitals = shouted / long_words if long_words else 0.0
    length = len(text) / n
    ended = sum(1 for line in lines if line.rstrip()[-1:] in ".!?:;\"'»”)")
    alone = sum(1 for w in words if len(w) == 1 and not w.isalnum())
    return [
        _vote(sum(map(text.count, "#*$%&|<>")) / n, 0.05, 0.3),
        _vote(capitals, 0.1, 0.4),
        _vote(repeated_words(local_ids) / n, 0.2, 0.5),
        2 if 4 <= length <= 10 else 0 if not 2.5 <= length <= 14 else 1,
        _vote(repeated_lines(text) / len(lines), 0.1, 0.3) if len(lines) > 1 else 1,
        _vote(1 - ended / len(lines), 0.3, 0.7),
        _vote(text.count("!") / n, 0.05, 0.3),
        _vote(alone / n, 0.05, 0.2),
    ]


def toxic_votes(words: list[bytes], insults: frozenset, keywords: frozenset = frozenset()) -> list[int]:
    """The votes of TOXIC_VOTERS, where 0 stands for abuse."""
    if not words:
        return [1] * len(TOXIC_VOTERS)
    bare = {w: w.strip(_PUNCTUATION).lower() for w in set(words)}
    suspects = {w for w, b in bare.items() if b in insults or b in keywords}
    if not suspects:
        return [2, 2, 1, 2, 1]
    kinds = {bare[w] for w in suspects}
    hits = sum(1 for w in words if w in suspects)
    return [0 if kinds & insults else 2, 0 if kinds & keywords else 2, 0 if hits > 1 else 1,
            _vote(hits / len(words), 0.0, 0.002), 0 if len(kinds) > 1 else 1]


def abuse_keywords(docs: DataFrame, labels: DataFrame, rows_per_class: int = 1000, least_places: int = 8,
                   least_lift: float = 20.0) -> frozenset:
    """Words of labelled abusive texts that other labelled texts hardly have, from at most ``rows_per_class`` rows each.

    A word must come after ``least_places`` different words in the drawn abusive texts, ``least_lift`` times as
    many as in the drawn others (half a place is added to these): copies of one text have one place each. Both draws take the least hashes of the id.
    """
    known = (labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .filter("doc_id is not null and toxic in (0, 1)").distinct())
    drawn = None
    for toxic, n in ((1, rows_per_class), (0, 2 * rows_per_class)):
        part = known.filter(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        drawn = part if drawn is None else drawn.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = struct("toxic int, word binary, before binary")

    def run(columns):
        out = {"toxic": [], "word": [], "before": []}
        for toxic, text in zip(columns["toxic"], columns["text"]):
            words = [w.strip(_PUNCTUATION).lower() for w in (text or "").encode("utf-8").split()]
            for before, word in set(zip([b"", *words], words)):
                if word:
                    out["word"].append(word)
                    out["before"].append(before)
                    out["toxic"].append(toxic)
        return out

    rows = texts.join(F.broadcast(drawn), "doc_id")  # at most 3 * rows_per_class rows
    places = map_columns(rows, run, schema, 64).distinct()
    counts = (places.groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("other"))
              .filter(F.col("bad") >= least_places).filter(F.col("bad") >= least_lift * (F.col("other") + 0.5) / 2))
    return frozenset(bytes(r["word"]) for r in counts.select("word").collect())


def _pattern(votes: list[int]) -> int:
    code = 0
    for v in votes:
        code = code * 3 + v
    return code


def _votes_of(pattern: int, n: int) -> list[int]:
    return [pattern // 3 ** (n - 1 - i) % 3 for i in range(n)]


def vote_patterns(docs: DataFrame, insults=INSULTS, keywords: frozenset = frozenset()) -> DataFrame:
    """(doc_id, quality_pattern, toxic_pattern) of every row."""
    listed = frozenset(w.encode("utf-8").lower() for w in insults)
    schema = struct("doc_id long, quality_pattern int, toxic_pattern int")

    def run(columns):
        import numpy as np

        out = {"doc_id": columns["doc_id"], "quality_pattern": [], "toxic_pattern": []}
        for text in columns["text"]:
            text = text or ""
            words = text.encode("utf-8").split()
            index: dict = {}
            ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
            out["quality_pattern"].append(_pattern(quality_votes(text, words, ids)))
            out["toxic_pattern"].append(_pattern(toxic_votes(words, listed, keywords)))
        return out

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_columns(rows, run, schema, 256)


def label_model(counts: dict[int, int], voters: int, founders: list[int], rounds: int = 200) -> dict[int, float]:
    """Posterior probability of good for every pattern, by expectation-maximisation.

    ``counts`` says how many rows have each pattern. There is one class of good rows and, as bad rows come in kinds
    that different voters see, a class of bad ones for each of the ``founders`` among the voters. A class gives every
    voter its own chances of voting good, bad or not, its accuracy among them; votes are independent within
    a class. Rows start in the classes of the founders that vote against them, else mostly in the good one. Two
    rows' worth of smoothing keeps every probability positive. Without rows the result is empty.
    """
    import math

    classes = 1 + len(founders)
    votes = {p: _votes_of(p, voters) for p in counts}
    share = {}
    for p, v in votes.items():
        against = [1 + k for k, j in enumerate(founders) if v[j] == 0]
        share[p] = [0.02 / (classes - 1)] * classes
        share[p][0] = 0.98 if not against else 0.02
        for k in against:
            share[p][k] += 0.96 / len(against)
    for _ in range(rounds):
        total = [2.0] * classes
        tally = [[[2 / 3] * 3 for _ in range(voters)] for _ in range(classes)]
        for p, n in counts.items():
            for k in range(classes):
                total[k] += n * share[p][k]
                for j, v in enumerate(votes[p]):
                    tally[k][j][v] += n * share[p][k]
        for j in founders:
            tally[0][j][0] = min(tally[0][j][0], FOUNDER_ERROR * total[0])
        change = 0.0
        for p, v in votes.items():
            logs = [math.log(total[k]) + sum(math.log(tally[k][j][x] / total[k]) for j, x in enumerate(v)) for k in range(classes)]
            top = max(logs)
            odds = [math.exp(x - top) for x in logs]
            new = [x / sum(odds) for x in odds]
            change = max(change, abs(new[0] - share[p][0]))
            share[p] = new
        if change < 1e-7:
            break
    return {p: s[0] for p, s in share.items()}


def _soft_aims(name: str, posterior: dict, sizes: dict):
    def aims(table):
        targets = [posterior[int(p)] for p in table["pattern"]]
        taken = {v: sum((t >= 0.5) == v for t in targets) for v in (True, False)}
        return [(name, targets, [sizes.get(t >= 0.5, 0) / taken[t >= 0.5] for t in targets])]

    return aims


def fit_scorer(docs: DataFrame, insults=INSULTS, keywords: frozenset = frozenset(), train_rows: int = TRAIN_ROWS):
    """(posteriors, heads): for ``quality`` and ``toxic`` the posterior of each pattern and the trained head.

    The label models use the votes on all rows. The scorer takes at most ``train_rows`` rows for each head: for
    each side, likely good and likely bad, those with the least hashes of their id, weighted back to their shares.
    """
    votes = materialise(vote_patterns(docs, insults, keywords), "votes")
    posteriors = {}
    for name, voters, founders in (("quality", QUALITY_VOTERS, QUALITY_FOUNDERS), ("toxic", TOXIC_VOTERS, TOXIC_FOUNDERS)):
        column = f"{name}_pattern"
        counts = {r[column]: r["count"] for r in votes.groupBy(column).count().collect()}  # at most 3**voters rows
        good = label_model(counts, len(voters), [voters.index(f) for f in founders])
        posteriors[name] = {p: g if name == "quality" else 1 - g for p, g in good.items()}
    heads = {}
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for name, posterior in posteriors.items():
        column = f"{name}_pattern"
        likely = [p for p, g in posterior.items() if g >= 0.5]
        side = F.col(column).isin(likely) if likely else F.lit(False)
        sizes = {r["side"]: r["count"] for r in votes.filter("doc_id is not null").groupBy(side.alias("side")).count().collect()}
        drawn = None
        for value in sorted(sizes):
            part = (votes.filter("doc_id is not null").filter(side == F.lit(value)).select("doc_id", F.col(column).alias("pattern"))
                    .orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows // 2))
            drawn = part if drawn is None else drawn.unionByName(part)
        if drawn is None:
            heads[name] = train([], [], [], [], [], [])
            continue
        found = texts.join(F.broadcast(drawn.dropDuplicates(["doc_id"])), "doc_id")  # at most train_rows rows
        heads |= fit_heads(found, ["pattern"], train_rows, _soft_aims(name, posterior, sizes))
    return posteriors, heads


def quality_classifier(docs: DataFrame, insults=INSULTS, keywords: frozenset = frozenset(),
                       train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, n_words, weak_quality, weak_toxic, p_quality, p_toxic, kept): one row per row of ``docs``.

    ``keywords`` may bring further words of abuse, as ``abuse_keywords`` finds them. ``weak_*`` are the label models' posteriors, ``p_*`` the scorer's calibrated probabilities. A row is kept if it
    has a word and both probabilities pass their fixed thresholds. A null or empty text has no word. Equal texts get equal verdicts;
    null and repeated ids keep their rows. Columns other than doc_id and text are not looked at.
    """
    posteriors, heads = fit_scorer(docs, insults, keywords, train_rows)
    names = ("quality", "toxic")
    model = docs.sparkSession.sparkContext.broadcast(({n: tuple(h) for n, h in heads.items()}, posteriors))
    listed = frozenset(w.encode("utf-8").lower() for w in insults)
    schema = struct("doc_id long, n_words long, weak_quality double, weak_toxic double, p_quality double, p_toxic double, kept boolean")

    def run(columns, state=[]):
        import numpy as np

        heads, posteriors = model.value
        if not state:
            state.append(WordIndex([heads[n][0] for n in names]))
        index = state[0]
        out = {f.name: [] for f in schema}
        for doc, text in zip(columns["doc_id"], columns["text"]):
            text = text or ""
            words = text.encode("utf-8").split()
            ids = index.ids(words)
            distinct = np.unique(ids)
            votes = _pattern(quality_votes(text, words, np.searchsorted(distinct, ids))), _pattern(toxic_votes(words, listed, keywords))
            weak = [posteriors[n][v] for n, v in zip(names, votes)]
            good, toxic = (sigmoid(heads[n][1] * s + heads[n][2]) for n, s in zip(names, index.scores(ids, distinct)))
            row = (doc, len(words), *weak, good, toxic, bool(words) and good >= MIN_QUALITY and toxic < MAX_TOXIC)
            for f, v in zip(out, row):
                out[f].append(v)
        return out

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_columns(rows, run, schema, 256)
