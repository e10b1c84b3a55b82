"""The pipeline against plain Python over the same stages' rules."""

import random
from collections import Counter

import pytest
from tests.llm.test_neardup import brute as brute_groups
from tests.llm.test_repetition import brute as brute_repetition
from tokenizers import Tokenizer

import corpus_pipeline
from rowkin.llm import langid
from rowkin.llm.registry import vocabulary
from rowkin.llm.tables import remainder

SOUNDS = {"en": ("the", "and", "ing"), "fr": ("eau", "oie", "que"), "de": ("str", "ung", "ich")}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(2)
    path, docs = tmp_path_factory.mktemp("corpus"), []
    for i in range(120):
        lang = rng.choice(list(SOUNDS))
        words = ["".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(5, 160))]
        if i % 10 == 3 and docs:
            words = docs[rng.randrange(len(docs))][1].split() + ["extra"]
        docs.append((i, " ".join(words * (4 if i % 17 == 5 else 1)), lang, f"src{i % 3}", 0))
    docs += [(200, None, None, None, None), (201, "12 34", "en", "src0", 5), (202, "", "en", None, 0), (7, docs[7][1], "en", "src1", 0)]
    labels = [(i, int(i % 4 > 0), int(i % 9 == 0)) for i in range(0, 120, 2)]
    spark.createDataFrame(docs, SCHEMA).coalesce(2).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(path / "labels.parquet"))
    return str(path), docs


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_stages_equal_plain_python(spark, folder, tmp_path):
    path, docs = folder
    steps = dict(corpus_pipeline.STAGES)
    frame = spark.read.parquet(f"{path}/documents.parquet")

    model = langid.train(frame.where(remainder("doc_id", 4) != 2))
    known = [d for d in docs if langid.labelled([d[1]], model)[0][0] != "und" and not langid.labelled([d[1]], model)[2][0]]
    kept = steps["language"](spark, frame, path)
    assert rows(kept) == sorted(known, key=repr) and kept.columns == frame.columns
    assert not {200, 201, 202} & {d[0] for d in known}

    clean = [d for d in known if brute_repetition(d[1])[6]]
    kept = steps["quality"](spark, spark.createDataFrame(known, SCHEMA), path)
    assert rows(kept) == sorted(clean, key=repr) and len(clean) < len(known)

    groups = brute_groups([(n, d[1]) for n, d in enumerate(clean)])
    first = {}
    for n, _, group, _ in groups:
        first.setdefault(group, []).append(clean[n])
    kept = rows(steps["near_duplicates"](spark, spark.createDataFrame(clean, SCHEMA), path))
    assert len(kept) == len(first) < len(clean)
    assert sorted(r[0] for r in kept) == sorted(min(d[0] for d in g) for g in first.values())

    unique = spark.createDataFrame(kept, SCHEMA)
    mixed = steps["mix"](spark, unique, path)
    assert mixed.columns == frame.columns and set(rows(mixed)) <= set(kept) and mixed.count() > 0

    tokenizer = Tokenizer.from_file(vocabulary())
    encoded = steps["encode"](spark, unique, path)
    assert {r.doc_id: list(r.ids) for r in encoded.collect()} == {d[0]: tokenizer.encode(d[1], add_special_tokens=False).ids for d in kept}


def test_run_is_the_chain_of_stages(spark, folder):
    path, _ = folder
    first, second = corpus_pipeline.run(spark, path).collect(), corpus_pipeline.run(spark, path).collect()
    assert Counter(r.doc_id for r in first) == Counter(r.doc_id for r in second) and len(first) > 0


def test_empty_documents(spark, tmp_path, folder):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder[0]}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
