import random

from lumengrid.operators.intervals import annotated, annotated_from, counts_before


def test_running_counts_equal_plain_counts(spark):
    rng = random.Random(0)
    points = [(rng.choice(["hot"] * 8 + ["a", None]), rng.randrange(-500, 500)) for _ in range(2000)] + [("a", None)]
    marks = [(i, rng.choice(["hot", "a", None, "none"]), rng.randrange(-600, 600)) for i in range(300)] + [(300, "hot", None), (301, "a", 10), (301, "a", 10)]
    p, m = spark.createDataFrame(points, "k string, t long").repartition(5), spark.createDataFrame(marks, "id int, k string, at long").repartition(3)
    want = sorted((i, sum(1 for q, t in points if q == k and t is not None and t < at) if at is not None else None) for i, k, at in marks)
    for width in (7, 100_000):
        assert sorted((r.id, r.before) for r in counts_before(p, m, "t", "at", width, ("k",)).collect()) == want
    whole = sorted((r.id, r.before) for r in counts_before(p.drop("k"), m.drop("k"), "t", "at", 50).collect() if r.before is not None)
    assert whole == sorted((i, sum(1 for _, t in points if t is not None and t < at)) for i, _, at in marks if at is not None)
    assert counts_before(p, m.filter("false"), "t", "at", 7, ("k",)).collect() == []
    assert {r.before for r in counts_before(p.filter("false"), m, "t", "at", 7, ("k",)).collect()} == {0, None}


def test_annotation_of_words_without_time_or_speaker(spark):
    words = spark.createDataFrame([(1, 10.0, 30.0, "x"), (2, None, 30.0, "x"), (3, 10.0, None, "y"), (4, 10.0, 30.0, None), (5, 40.0, 41.0, "y")], "id int, onset double, offset double, speaker string")
    out = {r.id: (r.word_dur, r.regress_pre_onset, r.regress_post_offset, r.regress_dur) for r in annotated(words, "speaker", "x", (1, 2), (3, 4)).collect()}
    assert out == {1: (20.0, 9.0, 32.0, 23.0), 2: (None, None, None, None), 3: (None, None, None, None), 4: (20.0, None, None, None), 5: (1.0, 37.0, 45.0, 8.0)}
    windows = spark.createDataFrame([("y", 2, 1.0, 9.0, 8.0)], "speaker string, i int, pre_onset double, post_offset double, duration double")
    out = {r.id: (r.word_dur, r.regress_dur) for r in annotated_from(words, windows, "speaker", ["onset", "id"]).collect()}
    assert out == {1: (20.0, None), 2: (None, None), 3: (None, None), 4: (20.0, None), 5: (1.0, 8.0)}
