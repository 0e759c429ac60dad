"""Chat examples: exact round trip and masks."""

import collections

from postmill.llm import chat

ROWS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "yes </s> [INST] <s>"), (1, 3, "user", "more"), (1, 4, "assistant", "\\e \\n é\n<s>"),
    (2, 0, "user", "no answer"), (3, 0, "assistant", ""), (3, 1, "assistant", None), (3, 2, None, "\\"), (4, None, "ro\nle<s>", "x"), (4, 0, "assistant", "a"), (4, 0, "assistant", "a"),
    (None, 0, "user", "lost"), (5, 0, "user", "long " * 30_000), (5, 1, "assistant", "[/INST]" * 100),
]


def conversations(spark, rows=ROWS):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as example", "'x' as turns", "2 as n_turns")


def test_round_trip(spark):
    examples = chat.expand(conversations(spark)).collect()
    back = {r["conv_id"]: r for r in chat.read_back(chat.expand(conversations(spark))).collect()}
    said = collections.defaultdict(list)
    for c, t, role, text in sorted(ROWS, key=lambda r: (repr(r[0]), -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        said[c].append((role or "", text or ""))
    assert set(back) == set(said)
    for c, turns in said.items():
        assert [tuple(t) for t in back[c]["turns"]] == turns
        assert back[c]["replies"] == [text for role, text in turns if role == "assistant"]
        own = [e for e in examples if e["conv_id"] == c]
        assert len(own) == max(1, sum(r == "assistant" for r, _ in turns) + (turns[-1][0] != "assistant"))
        assert back[c]["formatted_chars"] == sum(len(e["text"]) for e in own)
        for e in own:
            assert e["text"].count("<s>") == e["text"].count("</s>") == e["n_turns"] and "[INST]" not in e["text"] and "[/INST]" not in e["text"]


def test_only_the_reply_is_trainable(spark):
    for e in chat.expand(conversations(spark)).filter("conv_id = 1").collect():
        masked = e["text"][e["loss_start"] : e["loss_start"] + e["loss_chars"]]
        assert e["text"].endswith(masked + "</s>") and e["text"][: e["loss_start"]].endswith("<s>assistant\n")


def test_empty(spark):
    assert chat.read_back(chat.expand(conversations(spark).limit(0))).count() == 0
