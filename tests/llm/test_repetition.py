import random
import re

from pyspark.sql import functions as F

from rowkin.llm import repetition as rep


def brute(text):
    """Every figure by comparing all pairs of positions."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, reach = len(words), [0] * len(words)
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and words[i + k] == words[j + k]:
                k += 1
            reach[i] = max(reach[i], k)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    window = {p for i, r in enumerate(reach) if r >= 3 for p in range(i, i + 3)}
    covered = {p for i, r in enumerate(reach) if r >= rep.MIN_REPEAT for p in range(i, i + r)}
    failed = n < 50 or 100 * len(window) > 50 * n
    longest = max(reach, default=0)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(window), failed,
            not failed and len(covered) <= rep.MAX_COVERED * n and longest <= rep.MAX_REPEAT, len(covered), longest)


def texts():
    rng = random.Random(5)
    out = [None, "", " \n ", "one", "a a a", "été # été\n\nx\n x\nx\nété # été", "w " * 300, "a b \x1c c\x0bd"]
    for _ in range(40):
        base = [rng.choice("abcdefghijklmnopqrstuvw") + rng.choice("xyz") for _ in range(rng.randrange(20, 120))]
        words = base + base[: rng.randrange(0, 60)] + [rng.choice("ab")] * rng.randrange(0, 9)
        out.append("".join(w + rng.choice((" ", " ", "\n", "\t ")) for w in words))
    return out + out[-3:]


def test_equals_brute_force(spark):
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts())]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash"))
    got = sorted((tuple(r) for r in rep.judge(frame).collect()), key=repr)
    assert got == sorted(((i, *brute(t)) for i, t in rows), key=repr)


def test_limits_of_the_method(spark):
    rng = random.Random(6)
    fresh = lambda n: [f"{rng.getrandbits(40):x}" for _ in range(n)]
    passage = fresh(30)
    half = fresh(40) + passage + fresh(40) + passage
    long_once = (p := fresh(rep.MAX_REPEAT + 1)) + fresh(900) + p
    got = rep.measure([" ".join(t) for t in (half, long_once)])
    assert got["covered_words"].tolist() == [60, 2 * rep.MAX_REPEAT + 2] and got["longest_repeat"].tolist() == [30, rep.MAX_REPEAT + 1]
    frame = spark.createDataFrame([(0, " ".join(half)), (1, " ".join(long_once))], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in rep.judge(frame).collect()} == {0: True, 1: False}


def test_each_limit_alone_rejects_what_the_base_limit_passes(spark):
    rng = random.Random(7)
    fresh = lambda n: [f"{rng.getrandbits(40):x}" for _ in range(n)]
    passage, block, short = fresh(100), fresh(150), fresh(60)
    thrice = [*passage, *fresh(200), *passage, *fresh(200), *passage]
    five_times = [w for _ in range(5) for w in [*block, *fresh(500)]]
    covered = [w for _ in range(6) for w in [*short, *fresh(70)]]
    clean = [*short, *fresh(400), *short]
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate((thrice, five_times, covered, clean))], "doc_id long, text string")
    got = {r.doc_id: r for r in rep.judge(frame).collect()}
    assert not any(r.base_failed for r in got.values())
    assert {i: r.kept for i, r in got.items()} == {0: False, 1: False, 2: False, 3: True}
    assert got[1].longest_repeat == 150 and got[1].covered_words <= rep.MAX_COVERED * got[1].n_words
    assert got[2].covered_words == 360 and got[2].longest_repeat == 60 <= rep.MAX_REPEAT
    assert {r.doc_id for r in rep.keep_clean(frame).collect()} == {3}


def test_empty_table_and_long_text(spark):
    assert rep.judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    words = [f"w{i}" for i in range(20_000)]
    got = rep.measure([" ".join(words + words)])
    assert got["longest_repeat"][0] == 20_000 and got["covered_words"][0] == 40_000
