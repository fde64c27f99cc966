"""The weak-label model on drawn votes, and accuracy against labels it never saw."""

import numpy as np
from lamina.llm import quality as Q
from lamina.llm.common import ready


def test_em_finds_accuracies():
    rng = np.random.default_rng(3)
    truth = rng.random(20_000) < 0.8
    right = [0.95, 0.9, 0.8, 0.7, 0.85]
    counts = {}
    for good in truth:
        pattern = "".join(Q.NONE if rng.random() < 0.2 else (Q.GOOD if good == (rng.random() < a) else Q.BAD) for a in right)
        counts.setdefault(pattern, [0, 0])[int(good)] += 1
    p = Q.posteriors({k: sum(v) for k, v in counts.items()})
    wrong = sum(v[0] if p[k] > 0.5 else v[1] for k, v in counts.items())
    assert wrong / len(truth) < 0.07
    share = sum(p[k] * sum(v) for k, v in counts.items()) / len(truth)
    assert abs(share - 0.8) < 0.03


def test_accuracy_on_documents(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (ready(spark).read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in Q.quality_report(docs).collect()}
    assert len(got) == docs.count()
    told = labels.collect()
    good = [got[r.doc_id].keep for r in told if r.quality]
    bad = [got[r.doc_id].keep for r in told if not r.quality]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.2
    kept = Q.kept_documents(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, r in got.items() if r.keep}


def plain_votes(text):
    """The labellers once more, word by word."""
    words = text.split()
    n, out = len(words), []
    if not n:
        return "-" * 10

    def say(bad, good):
        out.append("0" if bad else "1" if good else "-")

    symbols = [c for c in text if c in "|#$%&*^~<>{}[]=\\"]
    say(len(symbols) / n > 0.3, len(symbols) / n < 0.05)
    marked = [w for w in words if w.endswith(tuple("|#$%&*^~<>{}[]=\\"))]
    say(len(marked) / n > 0.2, len(marked) / n < 0.05)
    odd = [c for c in text if not (c.isalnum() or c.isspace() or c in "_.,;:!?'\"()-/")]
    say(len(odd) / n > 0.3, len(odd) / n < 0.05)
    same = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    say(same > 0.2, same < 0.03)
    capitals = len([w for w in words if w.isupper()]) / n
    say(capitals > 0.5, capitals < 0.2)
    distinct = len(set(words)) / n
    say(n >= 30 and distinct < 0.15 + 3 / n, n >= 30 and distinct > 0.35)
    function = len([w for w in words if w in Q.FUNCTION_WORDS]) / n
    say(n >= 20 and function < 0.03, function > 0.12)
    shout = len([c for c in text if c in "!?"]) / n
    say(shout > 0.3, shout < 0.05)
    stops = len([c for c in text if c in ".!?"]) / n
    say(n >= 30 and stops < 0.01, 0.02 < stops < 0.3)
    lines = text.split("\n")
    say(len(lines) > 5 and len(set(lines)) < 0.5 * len(lines), len(lines) > 3 and len(set(lines)) > 0.9 * len(lines))
    return "".join(out)


def plain_posteriors(patterns):
    """Expectation-maximisation once more, in loops over patterns, classes and labellers."""
    share = {}
    for p in patterns:
        bad = p.count("0")
        good = 1.0 if not bad else 0.9 if bad == 1 else 0.1
        share[p] = [good] + [(1 - good) / bad if v == "0" else 0.0 for v in p] if bad else [1.0] + [0.0] * len(p)
    for _ in range(Q.ROUNDS):
        classes = range(11)
        size = [sum(patterns[p] * share[p][c] for p in patterns) + 1e-3 for c in classes]
        tell = [[{v: sum(patterns[p] * share[p][c] for p in patterns if p[k] == v) + 0.1 for v in "01"} for k in range(10)] for c in classes]
        new = {}
        for p in patterns:
            like = [size[c] * np.prod([tell[c][k][v] / sum(tell[c][k].values()) for k, v in enumerate(p) if v != "-"]) for c in classes]
            new[p] = [x / sum(like) for x in like]
        change = max(abs(a - b) for p in patterns for a, b in zip(new[p], share[p], strict=True))
        if change < 1e-9:
            break
        share = new
    return {p: s[0] for p, s in share.items()}


def test_report_against_a_plain_version(spark):
    docs = ready(spark).read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in Q.quality_report(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    votes = {i: plain_votes(t) for i, t in texts.items()}
    assert {i: r.votes for i, r in got.items()} == votes
    counts = {p: list(votes.values()).count(p) for p in set(votes.values())}
    good = plain_posteriors(counts)
    found = Q.posteriors(counts)
    assert all(abs(good[p] - found[p]) < 1e-6 for p in counts)

    def shares(text):
        words, out = text.split(), [0.0] * Q.BUCKETS
        for at, w in enumerate(words):
            out[Q._bucket(w)] += 1
            out[0] += at > 0 and words[at - 1] == w
        return [(x / len(words)) ** 0.5 if words else 0.0 for x in out]

    ids = sorted(texts, key=lambda i: votes[i])
    x, y = np.array([shares(texts[i]) for i in ids]), np.array([good[votes[i]] for i in ids])
    w, b = np.zeros(Q.BUCKETS), 0.0
    squares, square = np.full(Q.BUCKETS, 1e-6), 1e-6
    for _ in range(Q.STEPS):  # gradient steps once more
        error = 1 / (1 + np.exp(-(x @ w + b))) - y
        slope, step = x.T @ error / len(x) + Q.SHRINK * w, error.mean() + Q.SHRINK * b
        squares, square = squares + slope**2, square + step**2
        w, b = w - Q.RATE * slope / np.sqrt(squares), b - Q.RATE * step / np.sqrt(square)
    for i, row in zip(ids, x, strict=True):
        assert abs(got[i].score - 1 / (1 + np.exp(-(row @ w + b)))) < 1e-3


def test_large_ids_beside_null_ones(spark):
    big = (1 << 60) + 1
    docs = ready(spark).createDataFrame([(big, "a b"), (None, "a b"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0) for r in Q.quality_report(docs).collect()) == [0, 0, big]


def test_defined_cases(spark):
    schema = "doc_id long, text string, keep string, pattern int"
    docs = ready(spark).createDataFrame([(1, None, "", 1), (2, "", "", 0), (None, " \n", "", 0), (2, "", "", 0), (3, "a " * 100_000, "", 0)], schema)
    assert len(Q.quality_report(docs).collect()) == 5
    assert Q.quality_report(docs.limit(0)).collect() == [] and Q.kept_documents(docs.limit(0)).collect() == []
