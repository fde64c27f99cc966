"""Blocks to pages against plain Python, and grids of boxes."""

import random

import pytest
from lamina.operators import boxes as B
from lamina.operators import layout as L
from pyspark.sql import functions as F

SCHEMA = "doc_id string, page int, block_idx int, x0 double, y0 double, x1 double, y1 double, text string, block_type int, page_w double, page_h double"


def block(doc, page, idx, x0, y0, x1, y1, text, kind=0):
    return (doc, page, idx, float(x0), float(y0), float(x1), float(y1), text, kind, 600.0, 800.0)


def plain_rows(blocks):
    rows, current, reach = [], [], -1.0
    for b in sorted(blocks, key=lambda b: (b[4], b[2])):
        if reach < 0 or (b[4] + b[6]) / 2 > reach:
            current, reach = [], b[6]
            rows.append(current)
        else:
            reach = max(reach, b[6])
        current.append(b[2])
    return rows


def test_rows_against_plain_scan(spark):
    rng = random.Random(1)
    data = [block(f"d{k}", 1, i, 0, y := rng.choice([-20, 0, 5, 10, 30, 31]) + rng.randint(0, 9), 10, y + rng.randint(0, 30), "t") for k in range(80) for i in range(rng.randint(1, 9))]
    got = {}
    for r in L.group_rows(spark.createDataFrame(data, SCHEMA)).collect():
        got.setdefault(r.doc_id, {}).setdefault(r.row_no, set()).add(r.block_idx)
    for k in range(80):
        want = plain_rows([b for b in data if b[0] == f"d{k}"])
        assert [got[f"d{k}"][n] for n in sorted(got[f"d{k}"])] == [set(w) for w in want]


def test_row_formats(spark):
    data = [
        block("one", 1, 0, 10, 0, 20, 10, " a\nb "),
        block("label", 1, 0, 10, 0, 250, 10, "left\n side"), block("label", 1, 1, 300, 0, 500, 10, "right\nside"),
        block("wide", 1, 0, 10, 0, 290, 10, "left"), block("wide", 1, 1, 300, 0, 500, 10, "right\nside"),
        block("three", 1, 2, 400, 0, 500, 10, "c"), block("three", 1, 0, 10, 0, 50, 10, "a\nx"), block("three", 1, 1, 100, 0, 300, 10, "b"),
    ]
    rows = {r.doc_id: r.row_text for r in L.format_rows(L.group_rows(spark.createDataFrame(data, SCHEMA))).collect()}
    assert rows == {"one": "a\nb", "label": "left side\nright\nside", "wide": "left | right side", "three": "a x | b | c"}


def test_repeated_texts_and_page(spark):
    data = []
    for p in range(1, 11):
        data.append(block("d", p, 0, 0, 300, 50, 320, f"body {p} text"))
        if p <= 4:
            data.append(block("d", p, 1, 0, 10, 50, 20, "Head  line"))
        if p <= 3:
            data.append(block("d", p, 2, 0, 780, 50, 790, "Foot line"))
        data.append(block("d", p, 3, 0, 790, 50, 795, f"- {p} -"))
    data += [block("d", 7, 9, 0, 400, 50, 410, "Head\nline"), block("d", 8, 9, 0, 500, 50, 510, "img", 1), block("short", 1, 0, 0, 10, 50, 20, "only once")]
    frame = spark.createDataFrame(data, SCHEMA)
    assert {(r.doc_id, r.norm) for r in L.repeated_texts(frame).collect()} == {("d", "Head line"), ("short", "only once")}
    pages = {(r.doc_id, r.page): r.text for r in L.page_texts(frame).collect()}
    assert pages["d", 1] == "body 1 text\nFoot line" and pages["d", 7] == "body 7 text" and pages["d", 8] == "body 8 text" and pages["short", 1] == ""


def test_intervals_gaps_and_grid(spark):
    schema = "table_id long, object_id long, label string, score double, xmin double, ymin double, xmax double, ymax double"
    rows = [(1, 0, "table row", 0.9, 0, 0, 100, 10), (1, 1, "table row", 0.8, 5, 10, 90, 20), (1, 2, "table row", 0.7, 0, 30, 100, 40), (2, 3, "table row", 0.6, 0, 5, 9, 8)]
    frame = spark.createDataFrame([(*r[:4], *map(float, r[4:])) for r in rows], schema)
    merged = B.merge_intervals(frame, "y")
    got = sorted((r.table_id, r.group_no, r.score, r.ymin, r.ymax, r.xmin, r.xmax) for r in merged.collect())
    assert got == [(1, 1, 0.9, 0, 20, 0, 100), (1, 2, 0.7, 30, 40, 0, 100), (2, 1, 0.6, 5, 8, 0, 9)]
    filled = {(r.table_id, r.group_no): (r.ymin, r.ymax) for r in B.fill_gaps(merged, "y", F.lit(-1.0), F.lit(50.0)).collect()}
    assert filled == {(1, 1): (-1, 25), (1, 2): (25, 50), (2, 1): (-1, 50)}
    columns = spark.createDataFrame([(1, 9, "table column", 0.9, 0.0, 0.0, 40.0, 40.0), (1, 8, "table column", 0.9, 60.0, 0.0, 100.0, 40.0)], schema)
    tables = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 50.0)], "table_id long, t_xmin double, t_ymin double, t_xmax double, t_ymax double")
    cells = B.grid_cells(frame.where("table_id = 1"), columns, tables)
    assert cells.count() == 4
    words = spark.createDataFrame([(1, 0, 10.0, 5.0, 20.0, 8.0, "a"), (1, 1, 55.0, 30.0, 65.0, 40.0, "b  c")], "table_id long, word_no int, x0 double, y0 double, x1 double, y1 double, text string")
    texts = B.cell_texts(cells, words)
    assert {(r.row_no, r.col_no): r.text for r in texts.collect()} == {(1, 1): "a", (1, 2): "", (2, 1): "", (2, 2): "b c"}
    table = B.candidates(texts).collect()[0]
    assert table.rows == [["a", ""], ["", "b c"]] and (table.detected_rows, table.detected_cols) == (2, 2)


@pytest.mark.parametrize("size", [0, 3])
def test_empty(spark, size):
    frame = spark.createDataFrame([block("d", 1, i, 0, 100 * i, 5, 100 * i + 5, "x") for i in range(size)], SCHEMA)
    assert all(r.text == "" for r in L.page_texts(frame).collect())
