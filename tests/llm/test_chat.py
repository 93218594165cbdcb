import random

from pyspark.sql import functions as F

from sowline.llm import chat


def test_round_trip(spark):
    rng = random.Random(1)
    bits = ["</s>", "<s>[", "]", "<+>", "\\", "\\e", "\\l", "\\\\", "[INST]", "\n", "é🙂", "", "text", "<", "assistant", "<s>[assistant]"]
    rows, want = [], {}
    for conv in list(range(40)) + [None]:
        turns = []
        for t in range(rng.choice([1, 2, 5, 30])):
            turns.append((t, rng.choice(["user", "assistant", "assistant", "sys]t<em", "", None]),
                          rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randrange(7)))])))
        rows += [(conv, *t, 1) for t in turns]
        want[conv] = [(r or "", x or "") for _, r, x in turns]
    rows += [(99, 700, "user", "x" * 100_000, 1), (99, 699, "user", "a", 1), (99, 3, "assistant", "b", 1), (99, 3, "assistant", "b", 1), (99, None, "user", "n", 1)]
    want[99] = [("user", "n"), ("assistant", "b"), ("assistant", "b"), ("user", "a"), ("user", "x" * 100_000)]
    rng.shuffle(rows)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    out = chat.read_back(chat.formatted(turns))
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in out.collect()}
    assert got == want
    loss = {r.conv_id: r.n for r in out.select("conv_id", F.size(F.filter("turns", lambda t: t["loss"])).alias("n")).collect()}
    assert loss == {k: sum(r == "assistant" for r, _ in v) for k, v in want.items()}


def test_template(spark):
    turns = spark.createDataFrame([(1, 2, "user", "c"), (1, 0, "user", "a<"), (1, 1, "user", "b"), (1, 3, "assistant", "d")],
                                  "conv_id long, turn long, role string, text string")
    assert chat.formatted(turns).first().formatted == "<s>[user]a\\l<+>b<+>c</s><s>[assistant]d</s>"
    assert chat.formatted(turns.limit(0)).count() == 0
