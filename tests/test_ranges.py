"""Words in cells by range search; shares of cells by a suffix automaton; tables with null cells."""

import difflib
import random
import time

from lamina.operators import boxes, reports


def test_inside_matches_all_pairs(spark):
    rng = random.Random(8)
    intervals = [(k, i, lo, lo + rng.choice([0.0, 0.5, 3.0, 40.0])) for k in range(4) for i, lo in enumerate(rng.uniform(-50, 50) for _ in range(25))]
    intervals += [(7, 0, 5.0, 5.0), (7, 1, 9.0, 2.0), (8, 0, None, 3.0), (9, 0, -1e9, 1e9), (9, 1, 0.0, 1.0)]
    points = [(rng.choice([0, 1, 2, 3, 5, 7, 8, 9]), n, rng.choice([rng.uniform(-60, 60), 5.0, None])) for n in range(600)]
    points += [(k, 1000 + i, lo) for k, i, lo, _ in intervals[:30]]
    p = spark.createDataFrame(points, "table_id int, n int, at double")
    i = spark.createDataFrame(intervals, "table_id int, i int, low double, high double")
    got = sorted((r["n"], r["i"]) for r in boxes.inside(p, "at", i, "low", "high", "table_id").collect())
    want = sorted((n, j) for k, n, at in points for kk, j, lo, hi in intervals if k == kk and at is not None and lo is not None and lo <= at < hi)
    assert got == want and len(want) > 100


def test_words_meet_their_own_cells_only(spark):
    """Each word is one row of each join's output in a table of 40 x 30 cells."""
    cells = spark.range(1).selectExpr("id + 1 as table_id", "explode(sequence(1, 40)) as row_no").selectExpr("*", "explode(sequence(1, 30)) as col_no")
    cells = cells.selectExpr("*", "row_no * 10d as ymin", "row_no * 10d + 10 as ymax", "col_no * 20d as xmin", "col_no * 20d + 20 as xmax")
    words = spark.range(5000).selectExpr("id % 1 + 1 as table_id", "id as word_no", "20 + (id * 7 % 600) + 0d as x0", "10 + (id * 13 % 400) + 0d as y0", "concat('w', id) as text").selectExpr("*", "x0 as x1", "y0 as y1")
    rows, columns = cells.select("table_id", "row_no", "ymin", "ymax").distinct(), cells.select("table_id", "col_no", "xmin", "xmax").distinct()
    got = {(r["row_no"], r["col_no"]): r["text"] for r in boxes.grid_texts(rows, columns, words).collect()}
    want = {(r, c): [] for r in range(1, 41) for c in range(1, 31)}
    for n in range(5000):
        want[(10 + n * 13 % 400) // 10, (20 + n * 7 % 600) // 20].append(f"w{n}")
    assert got == {k: " ".join(v) for k, v in want.items()}
    assert got == {(r["row_no"], r["col_no"]): r["text"] for r in boxes.cell_texts(cells, words).collect()}
    met = boxes.inside(words.withColumn("cy", words["y0"]), "cy", rows, "ymin", "ymax", "table_id")
    plan = met._jdf.queryExecution().toString()
    assert met.count() == 5000 and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_null_cells_count_as_empty_ones(spark):
    truth = spark.createDataFrame([("all", None), ("all", None), ("some", None), ("some", "abc"), ("plain", "abc")], "table_id string, cell string")
    found = spark.createDataFrame([("all", 0, None), ("some", 0, "xyz"), ("plain", 0, "a b c"), ("plain", 1, None)], "table_id string, candidate int, text string")
    for ratios in (reports.containments, reports.exact_containments):
        best = {r["table_id"]: (r["recall"], r["candidate"]) for r in reports.best_candidates(truth, found, ratios).collect()}
        assert best == {"all": (1.0, 0), "some": (0.5, 0), "plain": (1.0, 0)}
    assert reports.best_candidates(truth.limit(0), found).collect() == []
    tables = spark.createDataFrame([("t", "p", 1, ["c"], [[None], [None]])], "table_id string, pdf string, page int, columns array<string>, rows array<array<string>>")
    pages = spark.createDataFrame([("p", 1, None)], "pdf string, page int, text string")
    timings = spark.createDataFrame([("p", 2.0)], "pdf string, seconds double")
    results = spark.createDataFrame([], "table_id string, seconds double, candidates array<struct<rows:array<array<string>>,detected_rows:int,detected_cols:int>>")
    assert reports.evaluation(tables, pages, timings, results).first()["layout_recall"] == 1.0


def plain_share(a, b):
    blocks = difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()
    return 1.0 if not a else sum(x.size for x in blocks) / len(a)


def test_shares_equal_the_standard_librarys(spark):
    rng = random.Random(11)
    for letters in ("ab", "abcd", "abcdefghijkl\u3000한é🙂"):
        for _ in range(60):
            cells = ["".join(rng.choices(letters, k=rng.randint(0, 14))) for _ in range(12)]
            text = "".join(rng.choice([rng.choice(letters), rng.choice(cells)]) for _ in range(rng.randint(0, 60)))
            got = reports.CellAutomaton(cells).shares(text)
            assert got == {c: plain_share(c, text) for c in cells}


def test_long_cells_and_texts_take_linear_time():
    rng = random.Random(12)
    cells = ["".join(rng.choices("abc", k=3000)), "a" * 3000, "ab" * 1500]
    seconds = []
    for n in (50_000, 400_000):
        text = "".join(rng.choices("abc", k=n // 2)) + "a" * (n // 2)
        began = time.perf_counter()
        most = reports.CellAutomaton(cells).longest_in(text)
        seconds.append(time.perf_counter() - began)
        assert max(most) == 3000
    assert seconds[1] < 24 * seconds[0]


def intervals_of(rng, n):
    """Boxes of several keys, one of them with most, some without a place or turned round."""
    rows = []
    for i in range(n):
        lo = rng.choice([None, 5.0, rng.uniform(0, 4 * n), rng.gauss(n, 3)] if rng.random() < 0.2 else [rng.uniform(0, 4 * n)])
        width = rng.choice([0.0, 1.0, 2.0, rng.expovariate(0.5), -1.0])
        rows.append((rng.choice([1, 1, 1, 1, 2, 3, None]), i, "row", rng.random(), lo, None if lo is None else lo + width, 0.0, 1.0))
    return rows


BOXES = "table_id int, object_id int, label string, score double, xmin double, xmax double, ymin double, ymax double"


def test_large_keys_merge_in_ranges_as_in_one_window(spark):
    rng = random.Random(21)
    frame = spark.createDataFrame(intervals_of(rng, 900), BOXES).cache()
    told = lambda df: sorted(map(repr, (r.asDict() for r in df.collect())))
    whole = boxes.merge_intervals(frame, "x")
    for rows in (7, 40, 5000):
        assert told(boxes.merge_intervals(frame, "x", rows=rows)) == told(whole)
    assert whole.where("table_id = 1").count() > 100
    placed = whole.where("table_id is not null")
    from pyspark.sql import functions as F

    filled = [boxes.fill_gaps(placed, "x", F.lit(-5.0), F.lit(9e9), large=large) for large in (False, True)]
    assert told(filled[0].select(*sorted(filled[0].columns))) == told(filled[1].select(*sorted(filled[1].columns)))
    assert boxes.merge_intervals(frame.limit(0), "x", rows=3).collect() == []


def test_ranges_of_a_hot_key_are_even(spark):
    from lamina.operators.ranges import ranged

    frame = spark.range(200_000).selectExpr("if(id % 10 = 0, id % 999, -1) as k", "pow(id % 9973, 3) as at")
    sizes = {(r["k"], r["__range"]): r["count"] for r in ranged(frame, ["k"], "at", 10_000).groupBy("k", "__range").count().collect()}
    hot = [n for (k, _), n in sizes.items() if k == -1]
    assert sum(sizes.values()) == 200_000 and 15 <= len(hot) <= 20 and max(hot) < 15_000 and {r for k, r in sizes if k != -1} == {0}


def test_rows_dealt_by_keys_without_nulls_stay(spark):
    from lamina.operators.ranges import running
    from pyspark.sql import functions as F

    frame = spark.range(50).select((F.col("id") % 3).alias("k"), F.col("id").alias("at"), F.col("id").alias("v"), F.floor(F.col("id") / 10).alias("__range"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        strict, loose = (running(frame, ["k"], ["at"], "v", nulls=n).select("k", "at", "v") for n in (False, True))
        few, many = (df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(") for df in (strict, loose))
        assert sorted(strict.collect()) == sorted(loose.collect()) and few < many
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
