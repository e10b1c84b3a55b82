import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowkin.llm import langid

SOUNDS = {"aa": ("ka", "lo", "mi"), "bb": ("str", "ung", "ich"), "cc": ("eau", "oie", "que"), "dd": ("ció", "ñas", "rra")}


def text(rng, lang, words=20):
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(words))


def corpus(rng, n, langs=tuple(SOUNDS)):
    return [(i, text(rng, langs[i % len(langs)]), langs[i % len(langs)]) for i in range(n)]


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.createDataFrame(corpus(random.Random(1), 200), "doc_id long, text string, lang string")


def test_held_out_accuracy(spark, labelled):
    model = langid.train(labelled)
    fresh = spark.createDataFrame(corpus(random.Random(2), 120), "doc_id long, text string, lang string").withColumn("score_", F.lit(1))
    got = langid.predict(fresh, model, "doc_id", "lang", "score_").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 118
    assert all(0 <= r.score <= 1 and not r.ambiguous for r in got if r.lang == r.lang_pred)


def test_mixed_text_is_less_sure(labelled):
    model = langid.train(labelled)
    rng = random.Random(3)
    pure, mixed = text(rng, "aa", 40), text(rng, "aa") + " " + text(rng, "bb")
    _, top, _ = model.decode(model.margins([pure, mixed]))
    assert top[0] > top[1]


def test_nulls_no_letters_and_repeats(spark, labelled):
    model = langid.train(labelled)
    rows = [(1, None), (2, ""), (3, "12 34 -- ²½"), (None, "kalomi lomika"), (None, "kalomi lomika")]
    got = {(r.doc_id, r.lang_pred, r.score) for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), model, "doc_id").collect()}
    assert {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)} <= got and len(got) == 4
    assert any(r[0] is None and r[1] == "aa" for r in got)


def test_no_or_one_language(spark):
    none = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    one = spark.createDataFrame([(1, "abc", "xx"), (2, None, "yy")], "doc_id long, text string, lang string")
    assert langid.predict(none, langid.train(none), "doc_id").first().lang_pred == "und"
    assert langid.predict(one, langid.train(one), "doc_id").orderBy("doc_id").first().lang_pred == "xx"
    assert langid.predict(one.limit(0), langid.train(one.limit(0)), "doc_id").count() == 0


def test_identify_learns_from_the_rest_only(spark, labelled):
    wrong = labelled.withColumn("lang", F.when(F.col("doc_id") % 4 == 2, "zz").otherwise(F.col("lang")))
    got = langid.identify(wrong, F.col("doc_id") % 4 == 2).collect()
    assert len(got) == 200 and {r.lang_pred for r in got} <= set(SOUNDS) and sum(r.held_out for r in got) == 50


def test_codewords_separate_many_languages():
    code = langid.codewords([f"l{i:02d}" for i in range(40)])
    gaps = [(code[i] != code[j]).sum() for i in range(40) for j in range(i)]
    assert min(gaps) >= 10 and np.array_equal(code, langid.codewords([f"l{i:02d}" for i in range(40)]))


def test_trigrams_stay_inside_texts():
    both, counts = langid.trigrams(["abc", None, "x"])
    alone = [langid.trigrams([t])[0].tolist() for t in ("abc", None, "x")]
    assert both.tolist() == sum(alone, []) and counts.tolist() == [len(a) for a in alone]


def plain_trigrams(text):
    data = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in text.lower().encode())
    data = b" " + data + b" "
    return [(int.from_bytes(data[i: i + 3], "big") * 2654435761 % 2**32) >> 18 for i in range(len(data) - 2)]


def by_plain_loops(rows, texts):
    """Languages and scores from loops over single trigrams; few languages, so every split is a bit."""
    langs = sorted({lang for _, text, lang in rows if text})
    counts = {lang: [0.5] * langid.BUCKETS for lang in langs}
    for _, text, lang in rows:
        for b in plain_trigrams(text or "") if lang in counts else ():
            counts[lang][b] += 1
    share = {lang: [c / sum(counts[lang]) for c in counts[lang]] for lang in langs}
    bits = [{lang: 1 if split >> i & 1 else -1 for i, lang in enumerate(langs)} for split in range(1, 2 ** (len(langs) - 1))]

    def mean(b, bit, side):
        group = [lang for lang in langs if bit[lang] == side]
        return sum(share[lang][b] for lang in group) / len(group)

    weight = {}

    def margin(text, n):
        for b in set(plain_trigrams(text)) - {b for b, m in weight if m == n}:
            weight[b, n] = math.log(mean(b, bits[n], 1) / mean(b, bits[n], -1))
        grams = plain_trigrams(text)
        return sum(weight[b, n] for b in grams) / len(grams)

    raw = [(lang, [margin(text, n) for n in range(len(bits))]) for _, text, lang in rows if text and lang in langs]
    scale = [sum(abs(m[n]) for _, m in raw) / len(raw) for n in range(len(bits))]
    trust = {}
    for lang in langs:
        own = [m for of, m in raw if of == lang]
        hits = [1e-6 + sum(m[n] * bit[lang] > 0 for m in own) / len(own) for n, bit in enumerate(bits)]
        trust[lang] = [h / sum(hits) for h in hits]
    out = []
    for text in texts:
        z = [langid.SHARPNESS * margin(text, n) / scale[n] for n in range(len(bits))]
        loss = {lang: sum(trust[lang][n] * math.log1p(math.exp(-bit[lang] * z[n])) for n, bit in enumerate(bits)) for lang in langs}
        odds = {lang: math.exp(-langid.SHARPNESS * (v - min(loss.values()))) for lang, v in loss.items()}
        best = max(odds, key=odds.get)
        out.append((best, odds[best] / sum(odds.values())))
    return out


def test_equals_plain_loops(spark):
    rng = random.Random(11)
    rows = corpus(rng, 36, ("aa", "bb", "cc"))
    texts = [text(rng, lang, 4) + " " + text(rng, other, 3) for lang in SOUNDS for other in SOUNDS]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    names, top, _ = langid.labelled(texts, model)
    want = by_plain_loops(rows, texts)
    assert names == [lang for lang, _ in want] and top == pytest.approx([score for _, score in want], rel=1e-3)


def test_a_language_of_empty_texts(spark):
    rows = [*corpus(random.Random(5), 20, ("aa", "bb")), (90, "", "cc"), (91, "", "aa"), (92, None, "dd"), (93, "12", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, F.lit(False)).collect()}
    assert got[90] == got[91] == got[92] == got[93] == "und"
    assert all(got[i] == lang for i, _, lang in rows[:20])
    only = docs.where("doc_id = 90")
    assert [r.lang_pred for r in langid.identify(only, F.lit(False)).collect()] == ["und"]


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 0)
    with pytest.raises(ValueError, match="languages"):
        langid.train(spark.createDataFrame([(1, "ab", "x")], "doc_id long, text string, lang string"))
