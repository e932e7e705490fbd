"""Hand-computed goldens of the column functions."""

import pytest
from pyspark.sql import functions as F

from strataline.functions import classify as C, messages as M, text as X


def values(spark, inputs, expr, schema="c string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, {schema}").coalesce(1)
    return [r[0] for r in rows.orderBy("i").select(expr).collect()]


def test_split_think(spark):
    inputs = ["<think> a </think> b", "Sure! <think>x</think>y", "</think>q<think>z", "<think>only",
              "<think>1</think>p<think>2</think>f", "<think></think>", ""]
    got = values(spark, inputs, X.split_think(F.col("c")))
    assert [tuple(g) for g in got] == [("a", "b"), ("x", "y"), ("", "q<think>z"), ("", "<think>only"),
                                       ("1", "p<think>2</think>f"), ("", ""), ("", "")]


def test_split_think_lengths(spark):
    inputs = ["<think> a </think> b", "Sure! <think>x</think>y", "</think>q<think>z",
              "<think>1</think>p<think>2</think>f", "<think></think>"]
    got = values(spark, inputs, X.split_think_lengths(F.col("c")))
    assert [tuple(g) for g in got] == [(18, 1), (22, 1), (8, 9), (16, 9), (15, 0)]


def test_answer_and_clean(spark):
    inputs = ["<think> a </think> b", "Sure! <think>x</think>y", "</think>q<think>z",
              "<think>1</think>p<think>2</think>f", "<think></think>"]
    assert values(spark, inputs, X.extract_answer(F.col("c"))) == ["b", "y", "q<think>z", "p<think>2</think>f", ""]
    cleaned = values(spark, inputs + ["hi <|end|> \n"], X.clean_response(F.col("c")))
    assert cleaned == ["b", "Sure! y", "</think>q<think>z", "pf", "", "hi"]


def test_think_parts_and_output(spark):
    inputs = ["a <think> t </think> b", "</think>q<think>z", "plain", "<think></think>x"]
    got = values(spark, inputs, X.split_think_parts(F.col("c")))
    assert [tuple(g) for g in got] == [("a", " t ", "b"), ("</think>q", None, "q<think>z"), (None, None, "plain"),
                                       (None, None, "x")]
    shown = values(spark, inputs, X.format_output(F.col("c")))
    assert shown == ["[Think]\nt\n\nb", "</think>q<think>z", "plain", "x"]


def test_names(spark):
    names = {"ds_12": "ds", "hard_coded_3": "hard_coded", "coconot_ab12cd3": "coconot",
             "x_0a1b2c3d-1111-2222-3333-444455556666_9": "x", "ds_1234567": "ds", "my_persona_4": "my_persona",
             "a_persona": "a", "x_12\n": "x_12\n"}
    assert values(spark, names, X.dataset_name_from_id(F.col("c"))) == list(names.values())


def test_strip(spark):
    assert values(spark, ["\n a ", "\x1ca\x1f", "　"], X.strip(F.col("c"))) == ["a", "a", ""]
    assert values(spark, ["\x1ca\x1f"], X.strip(F.col("c"), X.UNICODE_SPACE)) == ["\x1ca\x1f"]


MESSAGES = "c array<struct<role:string,content:string>>"


def test_message_selection(spark):
    talks = [[("user", "u1"), ("assistant", ""), ("user", "u2")],
             [("system", "s"), ("user", "u1"), ("assistant", "a1"), ("user", "u2"), ("assistant", "a2")],
             [("system", "s"), ("user", "u")], [("assistant", "first")]]
    c = F.col("c")
    assert values(spark, talks, M.last_assistant(c), MESSAGES) == [None, "a2", None, "first"]
    assert values(spark, talks, M.last_user_before(c), MESSAGES)[1] == "u2"
    assert values(spark, talks, M.prior_context(c), MESSAGES) == ["u1", "s\n\nu1\n\na1\n\nu2", "", ""]
    assert values(spark, talks, M.num_assistant_turns(c), MESSAGES) == [1, 2, 0, 1]
    assert values(spark, talks, M.chars_by_role(c, "user"), MESSAGES) == [4, 4, 1, 0]


def test_classification(spark):
    c = F.col("c")
    assert values(spark, ["I am Qwen by Alibaba", "I run on DeepSeek and OpenAI", "hi", "I am Nova"],
                  C.classify_identity(c, [("nova", "Nova")])) == ["Qwen", "DeepSeek", "Generic AI", "Nova"]
    assert values(spark, ["anneal-round5-x", "Base25-20250101T000000+0000", "Base25-20250101T000000+0000-b"],
                  C.classify_run(c, "Base25")) == ["annealing", "pre-training", "named-pre-training"]
    assert values(spark, ["my-sft-rl", "world-model", "x"], C.classify_posttraining(c)) == ["SFT", "RL", "other"]
    assert values(spark, [0, 4, 5, 500, 9999, 10000], C.config_bucket(c), "c int") == [
        "0-4", "0-4", "5-19", "500+", "500+", None]


@pytest.mark.parametrize("name,short", [("owner/a_b", "a b"), ("x" * 31, "x" * 27 + "..."), ("y" * 30, "y" * 30)])
def test_shorten(spark, name, short):
    assert values(spark, [name], X.shorten_source(F.col("c"), "owner/")) == [short]


def test_metric_names(spark):
    names = ["train/CE loss", "throughput", "eval/lm/pile/PPL", "eval/downstream/arc (accuracy)", "lm/PPL"]
    assert values(spark, names, X.metric_prefix(F.col("c"))) == ["train", "(top-level)", "eval", "eval", "lm"]
    assert values(spark, names, X.metric_short_name(F.col("c"))) == [
        "train/CE loss", "throughput", "pile", "arc", "lm/PPL"]
