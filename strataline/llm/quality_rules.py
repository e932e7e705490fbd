"""Quality rules: exact counts with limits, and a calibrated classifier trained on labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .batches import map_columns, struct
from .hashed import Head, WordIndex, features, sigmoid, train

#: Labelled rows of one (quality, toxic) class that training takes at most; the counts of all rows weigh them.
ROWS_PER_CLASS = 1000
#: Fixed thresholds of the verdict.
MIN_QUALITY, MAX_TOXIC = 0.5, 0.5
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
_SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"


def repeated_words(ids) -> int:
    """Words in three-word windows that occur twice or more; ``ids`` number a text's words from 0."""
    import numpy as np

    if len(ids) < 4:
        return 0
    size = np.int64(ids.max()) + 1
    pair = ids[:-1] * size + ids[1:]
    if size > 2_000_000:  # three numbers would not fit in 64 bits
        _, pair = np.unique(pair, return_inverse=True)
    code = pair[:-1] * size + ids[2:]
    _, inverse, count = np.unique(code, return_inverse=True, return_counts=True)
    again = count[inverse] > 1
    marks = np.zeros(len(ids), bool)
    for shift in range(3):
        marks[shift:len(ids) - 2 + shift] |= again
    return int(marks.sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split("\n")
    if len(lines) == len(set(lines)):
        return 0
    seen, repeats = set(), 0
    for line in lines:
        if line in seen:
            repeats += 1
        elif line.strip(_SPACES):
            seen.add(line)
    return repeats


def train_heads(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> dict[str, Head]:
    """The heads ``quality`` and ``toxic``, fitted on at most ``rows_per_class`` rows of each pair of labels.

    The rows of a class are those with the least hashes of their id, so the draw does not depend on how the
    tables are split. A quarter of them, by another hash, is held out for the calibration.
    """
    known = (labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"),
                           F.col("toxic").cast("int").alias("toxic"))
             .filter("doc_id is not null and quality in (0, 1) and toxic in (0, 1)"))
    sizes = {(r["quality"], r["toxic"]): r["count"] for r in known.groupBy("quality", "toxic").count().collect()}
    drawn = None
    for q, t in sorted(sizes):
        part = known.filter(f"quality = {q} and toxic = {t}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_class)
        drawn = part if drawn is None else drawn.unionByName(part)
    if drawn is None:
        return {name: train([], [], [], [], [], []) for name in ("quality", "toxic")}
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(drawn.distinct()), "doc_id")  # at most 4 * rows_per_class rows
    def aims(table):
        kinds = list(zip(table["quality"], table["toxic"]))
        taken = {k: kinds.count(k) for k in set(kinds)}
        weights = [sizes[k] / taken[k] for k in kinds]
        return [(name, table[name], weights) for name in ("quality", "toxic")]

    return fit_heads(found, ["quality", "toxic"], 4 * rows_per_class, aims)


def fit_heads(rows: DataFrame, columns: list[str], limit: int, aims) -> dict[str, Head]:
    """Heads fitted on at most ``limit`` rows (doc_id, text and ``columns``), in one task.

    ``aims`` takes a dict of the columns' lists, in the order of doc_id, and lists (name, targets, weights) of the heads. Texts
    become features where they are; the bounded features meet in the task that fits, and only what a head weighs comes to the
    driver. If the task is lost, it is run again on the same rows.
    """
    import numpy as np

    schema = struct("doc_id long, hold int, slots ints, vals floats" + "".join(f", {c} double" for c in columns))
    fitted = struct("name string, slope double, offset double, slots ints, weights floats")

    def run(batch):
        pairs = [features(t) for t in batch["text"]]
        return {"doc_id": batch["doc_id"], "hold": batch["hold"], "slots": [p[0] for p in pairs],
                "vals": [p[1] for p in pairs], **{c: batch[c] for c in columns}}

    def fit(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        table = pa.Table.from_batches(list(batches), to_arrow_schema(schema)).sort_by([("doc_id", "ascending")])
        chunks = [table[n].chunks for n in ("slots", "vals")]
        sizes = np.concatenate([np.asarray(c.value_lengths()) for c in chunks[0]] or [np.zeros(0, np.int32)])
        slots, vals = (np.concatenate([c.flatten().to_numpy() for c in part] or [np.zeros(0, kind)])
                       for part, kind in zip(chunks, (np.int32, np.float32)))
        known, held = {c: table[c].to_pylist() for c in columns}, table["hold"].to_pylist()
        del table, chunks
        for name, targets, weights in aims(known):
            head = train(sizes, slots, vals, targets, weights, held)
            used = np.flatnonzero(head.weights).astype(np.int32)
            out = to_arrow_schema(fitted)
            yield pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(
                (name, head.slope, head.offset, used, head.weights[used]), out)], schema=out)

    hold = (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0).cast("int")
    source = rows.select("doc_id", "text", hold.alias("hold"), *[F.col(c).cast("double").alias(c) for c in columns])
    # repeated ids may bring more rows than were drawn; the bound holds for them too
    bounded = map_columns(source, run, schema, 64).limit(limit).repartition(1)
    heads = {}
    for r in bounded.mapInArrow(fit, fitted).collect():
        weights = train([], [], [], [], [], []).weights
        weights[r["slots"]] = r["weights"]
        heads[r["name"]] = Head(weights, r["slope"], r["offset"])
    return heads


def quality_rules(docs: DataFrame, heads: dict[str, Head]) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, p_quality, p_toxic, kept).

    One row per row of ``docs``. Words are runs without ASCII white space; a null text has none and fails. A text
    is kept if it passes the counts and both probabilities pass their thresholds. The heads, a few MB, are
    broadcast; whole texts are scored. Other columns, whatever their names, are not looked at.
    """
    model = docs.sparkSession.sparkContext.broadcast({n: tuple(h) for n, h in heads.items()})  # plain: workers need not have this package
    schema = struct("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
                    "base_failed boolean, p_quality double, p_toxic double, kept boolean")

    def run(columns, state=[]):
        import numpy as np

        if not state:
            state.append(WordIndex([model.value[n][0] for n in ("quality", "toxic")]))
        index, names = state[0], ("quality", "toxic")
        out = {f.name: [] for f in schema}
        for doc, text in zip(columns["doc_id"], columns["text"]):
            text = text or ""
            words = text.encode("utf-8").split()
            ids = index.ids(words)
            distinct = np.unique(ids)
            local = np.searchsorted(distinct, ids)
            repeats = repeated_words(local)
            failed = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEATED_PERCENT * len(words)
            good, toxic = (sigmoid(model.value[n][1] * s + model.value[n][2]) for n, s in zip(names, index.scores(ids, distinct)))
            row = (doc, len(words), len(text) - sum(map(text.count, _SPACES)), sum(map(text.count, _SYMBOLS)),
                   repeated_lines(text), repeats, failed, good, toxic,
                   not failed and good >= MIN_QUALITY and toxic < MAX_TOXIC)
            for f, v in zip(out, row):
                out[f].append(v)
        return out

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_columns(rows, run, schema, 256)


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns. Ids must be unique; rows without one go."""
    verdicts = quality_rules(docs, train_heads(docs, labels))
    kept = verdicts.filter("kept").select(F.col("doc_id").alias("_kept"))
    return docs.join(kept, docs["doc_id"] == kept["_kept"], "left_semi")
