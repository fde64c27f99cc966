"""Files page by page, and tables of rendered pages, with JSON files and stand-ins for renderer and models."""

import json
import random
import sys

import pytest
from lamina.operators import page_tables as P
from lamina.sources import page_files as S
from pyspark import cloudpickle
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't know the folder of tests


def count(file):
    return len(json.load(file))


def page_of(file, page):
    file.seek(0)
    return json.load(file)[page - 1]


def decode(file, page):
    return [{"block_idx": i, "x0": 0.0, "y0": 300.0, "x1": 9.0, "y1": 310.0, "text": t, "block_type": 0, "page_w": 100.0, "page_h": 800.0} for i, t in enumerate(page_of(file, page)["texts"])]


def render(file, page, dpi):
    image = page_of(file, page)
    return image["width"], image["height"], json.dumps(image | {"dpi": dpi}).encode()


def detect(image):
    return [{"label": t["label"], "score": t["score"], **dict(zip(P.SIDES, t["box"], strict=True))} for t in json.loads(image)["tables"]]


def recognise(image, crop):
    left, top, right, low = crop
    (table,) = [t for t in json.loads(image)["tables"] if t["box"][0] >= left and t["box"][2] <= right and t["box"][1] >= top and t["box"][3] <= low]
    width, height = right - left, low - top
    whole = {"table row": ("ymin", "ymax"), "table column": ("xmin", "xmax")}
    made = []
    for label, (lo, hi) in whole.items():
        for a, b in table[label]:
            made.append({"label": label, "score": 0.9, "xmin": 0.0, "ymin": 0.0, "xmax": width, "ymax": height} | {lo: a, hi: b})
    return [*made, {"label": "table row", "score": 0.5, "xmin": 0.0, "ymin": 0.0, "xmax": width, "ymax": height}, {"label": "table", "score": 1.0, "xmin": 0.0, "ymin": 0.0, "xmax": width, "ymax": height}]


def words(file, page):
    return page_of(file, page)["words"]


def a_page(rng, n_tables):
    tables, y = [], 40.0
    for _ in range(n_tables):
        n, m = rng.randint(0, 4), rng.randint(0, 3)
        spans = lambda k, size: [[size * i / k + 1, size * (i + 1) / k - rng.choice([1, 4, -3])] for i in range(k)]
        tables.append({"label": rng.choice(["table", "table rotated"]), "score": rng.choice([0.71, 0.99]), "box": [5.0, y, 390.0, y + 160], "table row": spans(n, 170.0), "table column": spans(m, 390.0)})
        y += 200
    tables += [{"label": "table", "score": 0.7, "box": [0, 0, 9, 9]}, {"label": "figure", "score": 1.0, "box": [0, 0, 9, 9]}]
    rng.shuffle(tables)
    given = [{"x0": x, "y0": z, "x1": x + 4.0, "y1": z + 2.0, "text": f"w{i}"} for i, (x, z) in enumerate((rng.uniform(0, 150), rng.uniform(0, 280)) for _ in range(80))]
    return {"width": 400, "height": 800, "tables": tables, "words": given, "texts": []}


def united(spans, end):
    out = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(hi, out[-1][1])
        else:
            out.append([lo, hi])
    cuts = [0.0, *[(a[1] + b[0]) / 2 for a, b in zip(out, out[1:], strict=False)], end]
    return list(zip(cuts, cuts[1:], strict=False)) if out else []


def plain_candidates(page, dpi=200):
    out, scale = [], dpi / 72
    for t in page["tables"]:
        if t["label"] not in ("table", "table rotated") or t["score"] <= 0.7:
            continue
        x, y, right, low = max(0.0, t["box"][0] - 10), max(0.0, t["box"][1] - 10), min(400.0, t["box"][2] + 10), min(800.0, t["box"][3] + 10)
        rows, columns = united(t["table row"], low - y), united(t["table column"], right - x)
        inside = lambda at, span, corner: (span[0] + corner) / scale <= at < (span[1] + corner) / scale
        centres = [((w["x0"] + w["x1"]) / 2, (w["y0"] + w["y1"]) / 2, w["text"]) for w in page["words"]]
        cells = [[" ".join(text for cx, cy, text in centres if inside(cx, c, x) and inside(cy, r, y)) for c in columns] for r in rows]
        out.append((cells, t["score"], t["box"], len(rows), len(columns) if rows else 0))
    return out


def test_a_long_file_is_several_tasks_and_errors_stay_with_their_pages(spark, tmp_path):
    (tmp_path / "long.pdf").write_text(json.dumps([{"texts": [f"page {i}", "x"] if i != 500 else None} for i in range(1, 1001)]))
    (tmp_path / "none.pdf").write_text("[]")
    (tmp_path / "bad name.pdf").write_text("not json")
    counts = S.page_counts(spark, f"{tmp_path}/*.pdf", count)
    assert {(r.doc_id, r.n_pages, r.error is None) for r in counts.collect()} == {("long", 1000, True), ("none", 0, True), ("bad name", None, False)}
    ranges = S.page_ranges(counts, pages=100)
    assert ranges.rdd.getNumPartitions() == 11 and ranges.count() == 11
    assert ranges.withColumn("task", F.spark_partition_id()).where("first is not null").select("task").distinct().count() > 3
    blocks = S.page_blocks(ranges, decode)
    got = {(r.doc_id, r.page): r.error for r in blocks.collect()}
    assert {k for k, e in got.items() if e} == {("long", 500), ("bad name", None)} and len(got) == 1001
    assert blocks.where("error is null").count() == 2 * 999
    gone = S.page_blocks(S.pages_asked(spark.createDataFrame([("a", f"file:{tmp_path}/gone.pdf", 3)] * 2, "doc_id string, path string, page int")), decode).collect()
    assert [(r.doc_id, r.page, r.error is None) for r in gone] == [("a", 3, False)]
    with pytest.raises(FileNotFoundError):
        S.page_counts(spark, f"{tmp_path}/*.none", count)


def test_rendered_pages(spark, tmp_path):
    (tmp_path / "a.pdf").write_text(json.dumps([{"width": 3, "height": 4}, {"width": 5}]))
    images = {r.page: r for r in S.page_images(S.page_ranges(S.page_counts(spark, f"{tmp_path}/a.pdf", count), tasks=2), render).collect()}
    assert (images[1].width, images[1].height, json.loads(images[1].image)["dpi"], images[1].error) == (3, 4, 200, None)
    assert images[2].image is None and "height" in images[2].error


def test_tables_of_pages_against_plain_python(spark, tmp_path):
    rng = random.Random(5)
    pages = [a_page(rng, n) for n in (0, 1, 2, 3, 2, 3)] + [{"broken": 1}]
    (tmp_path / "doc.pdf").write_text(json.dumps(pages))
    ranges = S.page_ranges(S.page_counts(spark, f"{tmp_path}/doc.pdf", count), pages=2)
    done = P.extract_tables(ranges, str(tmp_path / "found"), render, detect, recognise, words)
    got = {r.page: r for r in done.collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6, 7] and got[7].error and got[7].candidates == [] and got[1].detected_tables == 0
    for n, page in enumerate(pages[:6], 1):
        want = plain_candidates(page)
        assert [(c.rows, c.table_score, c.table_box, c.detected_rows, c.detected_cols) for c in got[n].candidates] == want
        assert got[n].detected_tables == len(want) and got[n].elapsed_sec > 0 and got[n].error is None
    assert sum(any(any(c) for c in row) for page in pages[:6] for rows, *_ in plain_candidates(page) for row in rows) > 5
    assert P.page_candidates(spark.read.parquet(str(tmp_path / "found")).limit(0)).collect() == []
