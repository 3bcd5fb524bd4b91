import random
import re
import time

from pyspark.sql import functions as F

from loomfold.functions.rewards import repetition_penalty
from loomfold.functions.text import has_repetition, strip

PATTERN = re.compile(r"(\S+(?:\s+\S+){0,4})(?:\s+\1){3,}")


def short_texts(n=4000, seed=1):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        phrase = "".join(rng.choice(["a", "b", "ab", " ", "  "]) for _ in range(rng.randint(1, 4)))
        t = rng.choice(["", "a", " ", "b a"])
        for _ in range(rng.randint(2, 5)):
            t += phrase + rng.choice([" ", " ", "  ", "\n", ""])
        out.append((t + rng.choice(["", "a", "b", " x"]))[:26])
    return out


def test_flags_are_those_of_the_pattern(spark):
    texts = [*short_texts(), "", " ", "a", "a a a", "a a a a", "xa a a ab", "a  b a b a b a b", "a  b\na  b a  b\t a  b", "a b c d e " * 4, "a b c d e f " * 4, "xa b c a b c a b c a b cd"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    found = {r["i"]: r["flag"] for r in df.select("i", has_repetition(df["t"]).alias("flag")).collect()}
    wrong = [t for i, t in enumerate(texts) if found[i] != bool(PATTERN.search(t))]
    assert not wrong, wrong[:5]
    assert 300 < sum(found.values()) < len(texts) - 300
    assert spark.range(1).select(has_repetition(F.lit(None).cast("string")).alias("x")).first()["x"] is None


def test_long_loops_and_long_tokens_take_seconds(spark):
    rng = random.Random(3)
    texts = {"on and " * 5000: True, " ".join(f"w{rng.randrange(3000)}" for _ in range(1_000_000)): False, "x" * 1_000_000: False, "a b c d e f " * 100_000: False, "a" + " " * 300_000 + "b": False}
    for t, loops in texts.items():
        began = time.time()
        df = spark.createDataFrame([(t,)], "t string")
        r = df.select(has_repetition(df["t"]).alias("flag"), repetition_penalty(df["t"]).alias("penalty"), F.length(strip(df["t"])).alias("n")).first()
        assert r["flag"] is loops and (r["penalty"] == 1.0 or not loops) and r["n"] == len(t.strip())
        assert time.time() - began < 60
