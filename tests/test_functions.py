"""Hand cases of the column expressions."""

import hashlib
import random
import uuid

import pytest
from pyspark.sql import functions as F

from rowkin.functions import contact, keys, text
from rowkin.functions.similarity import _lcs_batch, _lcs_long, agreement, with_token_set_similarity
from rowkin.operators.scoring import record_text, valid_score


def values(spark, cases, expression):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, x string")
    return [r[0] for r in rows.orderBy("i").select(expression).collect()]


def test_email(spark):
    cases = {"L.o.u+News@Gmail.Com": "lou@gmail.com", "l.o.u+news@correo.example": "l.o.u@correo.example",
             "   ": None, "nobody": None, "+x@a.com": None, " A@B.com\t": "a@b.com", "a@b@c": "a@b@c", "x@": "x@",
             "..@gmail.com": None, "q+1+2@gmail.com": "q@gmail.com"}
    assert values(spark, cases, contact.norm_email(F.col("x"))) == list(cases.values())


def test_phone(spark):
    cases = {"(0223) 15-688-0417": "+5492236880417", "+54 9 223 688-0417": "+5492236880417", "77": None, " - ": None,
             "0351 15 555-1234": "+5493515551234", "011 4555-1234": "+541145551234", "02966 15-42-1234": "+5492966421234",
             "+1 650 253 0000": "+16502530000", "0054 9 351 555 1234": "+5493515551234", "abc": None,
             "11 4555-1234 int. 12": "+541145551234"}
    assert values(spark, cases, contact.norm_phone(F.col("x"))) == list(cases.values())


def test_date(spark):
    cases = {"27/11/2003": "2003-11-27", "1988-3-4": "1988-03-04", "31/02/2000": None, "": None, "1988/03/14": None,
             " 2001-01-02 ": "2001-01-02", "88-03-14": None}
    assert values(spark, cases, contact.norm_date(F.col("x")).cast("string")) == list(cases.values())


def test_address(spark):
    rows = spark.createDataFrame([("Av. Los Ceibos 77 piso 12",), ("Avenida Los Ceibos 77",), ("Calle Ñandú 5",), ("--",), ("Piso 3 Av. Sur",)], "x string")
    normed = rows.withColumn("n", text.norm_text("x")).select(contact.norm_address(F.col("n")))
    assert [r[0] for r in normed.collect()] == ["avenida los ceibos 77", "avenida los ceibos 77", "nandu 5", None, "avenida sur"]


def test_norm_text(spark):
    cases = {"  José  Ñandú-Pérez ": "jose nandu perez", "Straße ŒUVRE Łódź": "strasse oeuvre lodz", "": None, "¡!": None,
             "José": "jose", "İzmir ǆ ﬁn": "izmir dz fin", "a\tb c": "a b c", "№7 Ж": "7", "2º piso": "2o piso"}
    assert values(spark, cases, text.norm_text("x")) == list(cases.values())


def test_display_name(spark):
    cases = {" maría   JOSÉ ": "María José", "o'neill-díaz": "O'Neill-Díaz", "3rd mc2x": "3Rd Mc2X", "": None, "\t": None}
    assert values(spark, cases, text.display_name(F.col("x"))) == list(cases.values())


def test_split_full_name(spark):
    cases = {"Quiroga Vila, Tomás": ("Tomás", "Quiroga Vila"), "Tomás Quiroga": ("Tomás", "Quiroga"), "Tomás": ("Tomás", ""),
             " Tomás  de la Vila ": ("Tomás", "de la Vila"), "A, B, C": ("B, C", "A"), ",X": ("X", ""), "": ("", "")}
    got = zip(values(spark, cases, text.given_of(F.col("x"))), values(spark, cases, text.family_of(F.col("x"))))
    assert list(got) == list(cases.values())


def test_soundex(spark):
    cases = {"perez": "P620", "ashcraft": "A261", "tymczak": "T522", "pfister": "P236", "gonzalez lopez": "G524"}
    assert values(spark, cases, keys.family_key(F.col("x"))) == list(cases.values())


def test_keys(spark):
    names = ["crm:C1", "billing:B77", "ñandú"]
    namespace = uuid.UUID(keys.CLUSTER_NAMESPACE)
    assert values(spark, names, keys.cluster_id(F.col("x"))) == [str(uuid.uuid5(namespace, n)) for n in names]
    people = [f"P{i:05d}" for i in range(500)]
    want = ["dev" if int(hashlib.md5(p.encode()).hexdigest(), 16) % 10 < 6 else "test" for p in people]
    assert values(spark, people, keys.holdout_split(F.col("x"))) == want
    assert values(spark, ["b"], keys.pair_id(F.lit("a"), F.col("x"))) == [hashlib.sha1(b"a|b").hexdigest()[:16]]


def test_agreement(spark):
    values_of = (None, "", "p", "q")
    cases = [(i * 4 + j, a, b) for i, a in enumerate(values_of) for j, b in enumerate(values_of)]
    rows = spark.createDataFrame(cases, "i int, a string, b string").orderBy("i")
    want = [0 if a is None or b is None else 1 if a == b else -1 for _, a, b in cases]
    assert [r[0] for r in rows.select(agreement(F.col("a"), F.col("b"))).collect()] == want


def test_valid_score(spark):
    cases = {"0.25": 0.25, "1.0000001": None, "nan": None, "[]": None, None: None, "0": 0.0, "1": 1.0, "-1e-9": None, "Infinity": None, "x": None}
    assert values(spark, cases, valid_score(F.col("x"))) == list(cases.values())


def test_record_text_has_no_ids(spark):
    row = spark.createDataFrame([("billing:B9", "tomas vila", None, "+5492231", None, None, None)],
                                "left_entity_key string, left_full_name_norm string, left_email string, left_phone_e164 string, "
                                "left_birth_date date, left_city string, left_address string")
    got = row.select(record_text("left")).first()[0]
    assert "B9" not in got and got.split("; ") == ["name=tomas vila", "email=", "phone=+5492231", "birth=", "city=", "address="]


def lcs_by_table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return row[-1]


def similarity_by_definition(a, b):
    if a is None or b is None or not a.split() or not b.split():
        return 0.0
    sa, sb = set(a.split()), set(b.split())
    shared, ra, rb = " ".join(sa & sb), " ".join(sorted(sa - sb)), " ".join(sorted(sb - sa))
    if shared and (not ra or not rb):
        return 1.0

    def ratio(distance, total):
        return (100 - 100 * distance / total) / 100

    n, gap = len(shared), 1 if shared else 0
    options = [ratio(len(ra) + len(rb) - 2 * lcs_by_table(ra, rb), 2 * (n + gap) + len(ra) + len(rb))]
    if shared:
        options += [ratio(gap + len(r), 2 * n + gap + len(r)) for r in (ra, rb)]
    return max(options)


def test_similarity(spark):
    rng = random.Random(7)
    words = ["ana", "maria", "perez", "peres", "gonzalez", "lopez", "a", "bb", "garcia", "x" * 40, "yz" * 50]
    def pick():
        return None if rng.random() < 0.03 else " ".join(rng.choice(words) for _ in range(rng.randrange(0, 6)))
    cases = [(pick(), pick()) for _ in range(1500)] + [("ab " * 3, "ab"), ("", "a"), ("é" * 70, "e" * 70 + "é" * 3)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "i int, a string, b string")
    got = with_token_set_similarity(rows, "s", F.col("a"), F.col("b")).orderBy("i").select("s").collect()
    assert [r[0] for r in got] == pytest.approx([similarity_by_definition(a, b) for a, b in cases], abs=1e-12)


def test_lcs_helpers():
    rng = random.Random(3)
    pairs = [("".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 65))),
              "".join(rng.choice("abce ") for _ in range(rng.randrange(1, 65)))) for _ in range(400)]
    want = [lcs_by_table(a, b) for a, b in pairs]
    assert _lcs_batch([a for a, _ in pairs], [b for _, b in pairs]).tolist() == want
    assert [_lcs_long(a, b) for a, b in pairs] == want
