from pyspark.sql import functions as F

from rowkin.llm import fixity

SCHEMA = "archive string, offset bigint, length bigint, record_id bigint, digest string"


def records(spark, n=400, archives=2):
    return [(f"a{i % archives}", 9000 * i, 9000, i, f"d{i}") for i in range(n)]


def run(spark, left, right):
    got = fixity.audit(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)).collect()
    return sorted((r.archive, r.verdict, r.offset, r.record_id) for r in got), got


def brute(left, right):
    a, b = {(r[0], r[1]): r for r in left}, {(r[0], r[1]): r for r in right}
    out = [(k[0], "missing" if k not in b else "extra" if k not in a else "altered", k[1], (a.get(k) or b[k])[3])
           for k in {*a, *b} if a.get(k, [0] * 5)[4] != b.get(k, [0] * 5)[4]]
    hit = {r[0] for r in out}
    return out, [(x, "intact", None, None) for x in sorted({r[0] for r in left} - hit)]


def test_damage_is_located(spark):
    left = records(spark)
    right = [(*r[:4], "bad") if r[3] in (3, 399) else r for r in left if r[3] not in (10, 200)] + [("a0", 10**9, 5, 999, "x")]
    got, rows = run(spark, left, right)
    odd, intact = brute(left, right)
    assert got == sorted(odd + intact, key=lambda r: r) and len(got) == 5
    assert all(r.left_root != r.right_root for r in rows)


def test_intact_archive_has_one_row(spark):
    left = records(spark)
    right = [(*r[:4], "bad") if r[3] == 3 else r for r in left]
    got, rows = run(spark, left, right)
    assert [r.verdict for r in sorted(rows, key=lambda r: r.archive)] == ["intact", "altered"]


def test_only_differing_branches_are_followed(spark):
    left = records(spark, 4000, 1)
    right = [(*r[:4], "bad") if r[3] == 7 else r for r in left]
    frames = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)
    levels = fixity.height(*frames)
    trees = [fixity.tree(f, levels) for f in frames]
    odd = None
    for level in range(levels, -1, -1):
        odd = fixity.differing(*trees, level, odd)
        assert odd.count() == 1


def test_empty_null_repeated_and_missing_archives(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert fixity.audit(empty, empty).count() == 0
    left = [("a", 0, 1, 1, "x"), ("a", 0, 1, 1, "x"), ("b", 0, 1, None, "y")]
    got, _ = run(spark, left, left[:1])
    assert got == [("a", "intact", None, None), ("b", "missing", 0, None)]


def test_page_records(spark):
    pages = spark.createDataFrame([(1, "http://x", "été"), (2, None, None), (None, "u", "v"), (1, "http://x", "été")],
                                  "page_id bigint, url string, html string").withColumn("digest", F.lit("clash"))
    got = fixity.page_records(pages.select("page_id", "url", "html")).orderBy("archive", "offset").collect()
    assert [r.archive for r in got] == ["0", "0", "0", "none"]
    assert [r.offset for r in got[:3]] == [0, got[0].length, got[0].length * 2]
    assert got[0].digest == got[1].digest != got[2].digest


def test_place_length_and_number_are_hashed(spark):
    left = [("a", 10, 10, 1, "x"), ("b", 10, 10, 1, "x"), ("c", 10, 10, 1, "x"), ("d", 10, 10, 1, "x")]
    right = [("a", 500, 10, 1, "x"), ("b", 10, 99, 1, "x"), ("c", 10, 10, 2, "x"), ("d", 10, 10, 1, "x")]
    got, _ = run(spark, left, right)
    assert got == [("a", "moved", 10, 1), ("b", "altered", 10, 1), ("c", "altered", 10, 1), ("d", "intact", None, None)]


def test_a_loss_moves_what_follows(spark):
    sizes = [500 + 37 * i for i in range(40)]

    def lay(skip, cut):
        rows, at = [], 0
        for i, size in enumerate(sizes):
            if i != skip:
                size -= 100 * (i == cut)
                rows.append(("a", at, size, i, f"d{i}" + "!" * (i == cut)))
                at += size
        return rows

    got, _ = run(spark, lay(None, None), lay(5, 9))
    verdicts = {r[3]: r[1] for r in got}
    assert verdicts == {5: "missing", 9: "altered", **{i: "moved" for i in range(6, 40) if i != 9}}


def test_nulls_clashing_columns_and_many_records_at_one_place(spark):
    wide = SCHEMA + ", side string, content string, node string"
    left = spark.createDataFrame([(None, None, None, None, None, "s", "c", "n")] + [("a", 0, 1, i, f"d{i}", "", "", "") for i in range(300)], wide)
    right = spark.createDataFrame([("none", 0, 0, None, "", "", "", "")] + [("a", 0, 1, i, f"d{i}", "", "", "") for i in range(1, 300)], wide)
    got = sorted((r.archive, r.verdict, r.record_id) for r in fixity.audit(left, right).collect())
    assert got == [("a", "missing", 0), ("none", "intact", None)]


def test_offsets_of_repeated_ids_and_equal_pages(spark):
    rows = [(1, f"http://x/{i % 90}", "y" * (i % 7)) for i in range(500)] + [(None, "u", f"{i % 50}") for i in range(300)] + [(2, "z", None)] * 40
    got = fixity.page_records(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert len(got) == len(rows)
    for archive in ("0", "none"):
        mine = sorted((r for r in got if r.archive == archive), key=lambda r: r.offset)
        assert [(r.record_id or 0, r.digest) for r in mine] == sorted((r.record_id or 0, r.digest) for r in mine)
        at = 0
        for r in mine:
            assert r.offset == at
            at += r.length
