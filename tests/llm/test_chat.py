import random

import pytest
from pyspark.sql import functions as F

from tests.llm.data import words
from wellspark.llm import chat

COLUMNS = "conv_id bigint, turn bigint, role string, text string, at string, ts string, pieces string"


def made(seed=1):
    rng = random.Random(seed)
    odd = ["<s>", "</s>", "[ROLE]", "[TEXT]", "[MORE]", "[INST]", "[/INST]", "\\", "\\a", "\\b", "<", "/s>", "[", "]", "é", "𝄞", "\n", " ", "x"]
    out = []
    for conv in [None, *range(30)]:
        for turn in [None, *range(rng.randint(0, 9))][rng.randint(0, 1) :]:
            role = rng.choice(("user", "assistant", "assistant", "system", None, "[TEXT]</s>"))
            text = rng.choice((None, "", "".join(rng.choice(odd) for _ in range(rng.randint(1, 30)))))
            out.append((conv, turn, role, text, "a", "b", "c"))
    out.append((77, 0, "assistant", " ".join(words(3, 20_000)) + "</s>" * 50, "a", "b", "c"))
    out.extend([(78, 1, "user", "same", "a", "b", "c")] * 3)
    return out


def expected(rows):
    convs = {}
    for conv, turn, role, text, *_ in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for *_, r, t in sorted(ts)] for c, ts in convs.items()}


@pytest.mark.parametrize("template", [chat.Template(), chat.Template(begin="«", role="{r:", text="}t", more="~m", end="#", reserved=(), learned=("user", "system"))])
def test_round_trip(spark, template):
    rows = made()
    df = chat.format_conversations(spark.createDataFrame(rows, COLUMNS).repartition(4), template=template)
    read = df.withColumns({"turns": chat.parse_turns(F.col("formatted"), template), "learned": chat.learned_texts(F.col("formatted"), F.col("loss_spans"), template)})
    found, want = read.collect(), expected(rows)
    assert len(found) == len(want)
    for r in found:
        turns = want[r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == turns
        assert r["learned"] == [t for role, t in turns if role in template.learned]
        blocks = 1 + sum(a[0] != b[0] for a, b in zip(turns, turns[1:]))
        text = r["formatted"]
        assert text.count(template.begin) == 1 and text.count(template.role) == text.count(template.end) == text.count(template.text) == blocks
        assert text.count(template.more) == len(turns) - blocks
        assert not any(x in text for x in template.reserved)


def test_masks_are_spans_of_the_format(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "a</s>"), (1, 2, "assistant", "")], "conv_id int, turn int, role string, text string")
    row = chat.format_conversations(df).first()
    assert row["formatted"] == "<s>[ROLE]user[TEXT]hi</s>[ROLE]assistant[TEXT]a\\f[MORE]</s>"
    assert [row["formatted"][s["start"] :][: s["length"]] for s in row["loss_spans"]] == ["a\\f", ""]


def test_templates_that_could_be_misread():
    for bad in (dict(begin=""), dict(end="<s>"), dict(role="a[b"), dict(text="\\t"), dict(more="x<")):
        with pytest.raises(ValueError):
            chat.Template(**bad)


def test_nothing(spark):
    df = chat.format_conversations(spark.createDataFrame([], COLUMNS))
    assert df.count() == 0 and df.columns == ["conv_id", "formatted", "loss_spans"]


def test_native(spark):
    df = chat.format_conversations(spark.createDataFrame(made(), COLUMNS))
    plan = df.select(chat.parse_turns(F.col("formatted")).alias("t"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
