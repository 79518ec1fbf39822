"""Greedy decoding against texts that a table-driven scorer knows."""

import json

from diptych.operators import scorers


class FromTable(scorers.Scorer):
    """Says the words of a known text one by one, and keeps how many were asked for at once."""

    def __init__(self, texts, folder):
        self.texts, self.folder = texts, folder

    def score(self, prompts):
        out = []
        for p in map(json.loads, prompts):
            words = self.texts[p["prompt"]].split()
            assert p["tokens"][0] == "<s>" and p["tokens"][1:] == words[: len(p["tokens"]) - 1]
            out.append((words + ["</s>"])[len(p["tokens"]) - 1])
            with open(f"{self.folder}/{len(p['tokens'])}", "a") as f:
                f.write(".")
        return out


def test_sequences_end_by_themselves(spark, tmp_path):
    texts = {"a": "one", "b": "one two three", "c": "", "d": " ".join("x" * 9)}
    rows = [(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, None), (6, "b")]
    frame = spark.createDataFrame(rows, "id int, prompt string").repartition(2)
    found = {r.id: r.tokens for r in scorers.decoded(frame, "prompt", FromTable(texts, str(tmp_path)), "</s>", 6, start="<s>").collect()}
    assert found == {1: ["one"], 2: ["one", "two", "three"], 3: [], 4: ["x"] * 6, 5: [], 6: ["one", "two", "three"]}
    # Each round asked for what was open alone, and once.
    assert [len((tmp_path / str(k)).read_text()) for k in range(1, 7)] == [5, 4, 3, 3, 1, 1]
    assert scorers.decoded(frame.where("false"), "prompt", FromTable(texts, str(tmp_path)), "</s>", 6).collect() == []
