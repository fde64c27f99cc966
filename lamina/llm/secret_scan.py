"""Secret scans: fixed patterns, and character Markov models (DataFrame operations only).

Base patterns give the labelled samples: what they find are strings known to be
random, counted over all documents; shorter words outside them, of about
TRAIN_DOCS documents chosen by hash, are ordinary identifiers. Both classes get first-order Markov
models over characters, smoothed by the class's character frequencies. Every
further run of 16 or more key characters is then scored by the log-likelihood
ratio of the two models and is a span of kind `markov` if that reaches THRESHOLD
a character. Base spans stay.

Positions come from split() and regexp_extract_all() with the same pattern:
match i starts after i + 1 gaps and i matches. Running sums and maxima are taken
in groups of GROUP and of GROUP groups, candidates are held against base spans by
binary search, and texts are cut from pieces of PIECE characters, so a text with
many matches costs no square of their number or its length.

Defined cases: null text: empty. Texts without spans get zero counts, the digest
of the empty string and an empty list. Repeated rows each get their row. Without
labelled samples both models are uniform and nothing is added. Empty table:
empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, whole_text

# The base kinds in order, their patterns, the group that is measured and its least length.
KINDS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # maximal runs of 24 and more: the same as runs with shorter ones dropped
)
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}"
IDENTIFIER = r"(?<![A-Za-z0-9+/_-])[A-Za-z][A-Za-z0-9_-]{3,14}(?![A-Za-z0-9+/_-])"  # shorter than a candidate, so no unlabelled secret
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-.="
#: Documents whose words are the ordinary sample; least log-likelihood ratio per character (nats).
TRAIN_DOCS, THRESHOLD = 2000, 0.5
#: Weight of a class's own character frequencies (plus one each) in the distribution after any character.
BACKOFF = 20

GROUP, PIECE = 64, 256


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, combine: Callable[[Column, Column], Column], levels: int = 2) -> Column:
    """Running sums, or what combine does (0 changes nothing), of an array of ints that are not negative; in groups, and groups of groups."""
    fold = lambda part: F.aggregate(part, F.lit(0), combine)
    at = lambda i: F.floor(i / GROUP).cast("int")

    def of(x: Column) -> Column:
        inside = lambda i: fold(F.slice(x, at(i) * GROUP + 1, i - at(i) * GROUP + 1))
        groups = F.transform(F.sequence(F.lit(0), at(F.size(x) - 1)), lambda g: fold(F.slice(x, g * GROUP + 1, F.lit(GROUP))))

        def with_totals(totals: Column) -> Column:
            before = lambda i: F.when(at(i) > 0, F.get(totals, at(i) - 1)).otherwise(F.lit(0))
            return F.transform(F.sequence(F.lit(0), F.size(x) - 1), lambda i: combine(before(i), inside(i)))

        small = F.transform(x, lambda _, i: fold(F.slice(x, F.lit(1), i + 1)))
        whole = running(groups, combine, levels - 1) if levels else bound(groups, lambda g: F.transform(g, lambda _, i: fold(F.slice(g, F.lit(1), i + 1))))
        return F.when(F.size(x) <= GROUP, small).otherwise(bound(whole, with_totals))

    return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(bound(values, of))


def prefix_sums(lengths: Column) -> Column:
    return running(lengths, lambda a, b: a + b)


def pieces_of(text: Column) -> Column:
    """Array of the text's pieces of PIECE characters."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut(pieces: Column, start: Column, end: Column) -> Column:
    """Characters from start to end of the text in pieces."""
    first, last = F.floor(start / PIECE).cast("int"), F.floor(end / PIECE).cast("int")
    piece = lambda i: F.coalesce(F.get(pieces, i), F.lit(""))
    one = F.substring(piece(first), start - first * PIECE + 1, end - start)
    whole = F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    more = F.concat(F.substring(piece(first), start - first * PIECE + 1, F.lit(PIECE)), whole, F.substring(piece(last), F.lit(1), end - last * PIECE))
    return F.when(end <= start, F.lit("")).when(first == last, one).otherwise(more)


def below(values: Column, x: Column) -> Column:
    """How many of ascending ints are below x, by binary search."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(31))])
    used = F.filter(steps, lambda s: s <= F.size(values))
    return F.aggregate(used, F.lit(0), lambda n, s: F.when((n + s <= F.size(values)) & (F.get(values, n + s - 1) < x), n + s).otherwise(n))


def spans_of(text: Column, kind: str, order: int, pattern: str, group: int, least: int) -> Column:
    """Sorted array<struct<start, order, end, kind, value>> of the leftmost non-overlapping matches whose measured group is long enough."""
    empty = F.array().cast("array<struct<start:int,order:int,end:int,kind:string,value:string>>")
    parts = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("values"),
        F.split(text, pattern, -1).alias("gaps"),
    )

    def of(p: Column) -> Column:
        steps = F.transform(
            p["matches"],
            lambda _, i: F.length(F.get(p["gaps"], i)) + F.when(i == 0, F.lit(0)).otherwise(F.length(F.get(p["matches"], F.greatest(i - 1, F.lit(0))))),
        )
        spans = lambda starts: F.transform(
            starts,
            lambda s, i: F.struct(
                s.alias("start"), F.lit(order).alias("order"), (s + F.length(F.get(p["matches"], i))).alias("end"),
                F.lit(kind).alias("kind"), F.get(p["values"], i).alias("value"),
            ),
        )
        return F.filter(bound(prefix_sums(steps), spans), lambda s: F.length(s["value"]) >= least)

    return F.when(text.rlike(pattern), bound(parts, of)).otherwise(empty)


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text, base for each row."""
    found = [spans_of(F.col("text"), kind, n, *rest) for n, (kind, *rest) in enumerate(KINDS)]
    return docs.select("doc_id", whole_text().alias("text")).withColumn("base", F.array_sort(F.concat(*found)))


def _codes(token: Column) -> Column:
    """Index in ALPHABET of each character."""
    where = [max(0, ALPHABET.find(chr(c))) for c in range(128)]
    lookup = F.split(F.lit(",".join(map(str, where))), ",").cast("array<int>")
    return F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.get(lookup, F.ascii(c)))


def without_values(text: Column, spans: Column) -> Column:
    """text with a space in place of each span's value, which ends where the span does; other occurrences of a value stay."""

    def of(x: Column) -> Column:
        until = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(x["reach"], F.greatest(i - 1, F.lit(0))))
        gaps = F.transform(spans, lambda s, i: cut(x["pieces"], until(i), s["end"] - F.length(s["value"])))
        rest = cut(x["pieces"], F.get(x["reach"], F.size(x["reach"]) - 1), F.length(text))
        return F.concat(F.array_join(gaps, " "), F.lit(" "), rest)

    sides = F.struct(pieces_of(text).alias("pieces"), reach_of(spans).alias("reach"))
    return F.when(F.size(spans) == 0, text).otherwise(bound(sides, of))


def train(scanned: DataFrame) -> list[float]:
    """Log-likelihood ratio (random : ordinary) of each pair of neighbouring characters, row by row of the first."""
    random = scanned.where(F.size("base") > 0).select(F.explode("base.value").alias("token"), F.lit(1).alias("random"))
    sample = hash_sample(scanned.select("doc_id", "text", "base"), ["doc_id", "text"], TRAIN_DOCS)
    words = F.explode(F.regexp_extract_all(without_values(F.col("text"), F.col("base")), F.lit(IDENTIFIER), F.lit(0))).alias("token")
    ordinary = sample.select(words, F.lit(0).alias("random"))
    codes = random.unionByName(ordinary).select("random", _codes(F.col("token")).alias("c"))
    pairs = codes.where(F.size("c") > 1).select(
        "random", F.explode(F.zip_with(F.slice("c", F.lit(1), F.size("c") - 1), F.slice("c", F.lit(2), F.size("c") - 1), lambda a, b: a * len(ALPHABET) + b)).alias("pair")
    )
    k = len(ALPHABET)
    counts = [[0] * (k * k) for _ in range(2)]
    for r in pairs.groupBy("random", "pair").count().collect():  # two alphabets squared at most
        counts[r["random"]][r["pair"]] = r["count"]
    if not sum(counts[1]):  # no labelled secret
        return [0.0] * (k * k)

    def log_probabilities(c: list[int]) -> list[float]:
        single = [1 + sum(c[b::k]) for b in range(k)]
        share = [x / sum(single) for x in single]
        rows = [sum(c[a * k : a * k + k]) for a in range(k)]
        return [math.log((c[i] + BACKOFF * share[i % k]) / (rows[i // k] + BACKOFF)) for i in range(k * k)]

    ordinary_log, random_log = map(log_probabilities, counts)
    return [y - x for x, y in zip(ordinary_log, random_log, strict=True)]


def markov_spans(text: Column, base: Column, ratios: list[float]) -> Column:
    """Candidates clear of base spans whose ratio reaches the threshold."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")

    def ratio(token: Column) -> Column:
        def of(c: Column) -> Column:
            pairs = F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: F.get(table, a * len(ALPHABET) + b))
            return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / (F.size(c) - 1)

        return bound(_codes(token), of)

    candidates = spans_of(text, "markov", len(KINDS), CANDIDATE, 0, 16)

    def clear_of(b: Column) -> Column:
        """Of the base spans that start before a candidate's end, the greatest end tells."""
        before = lambda s: below(b["starts"], s["end"])
        clear = lambda s: bound(before(s), lambda n: F.when(n == 0, F.lit(True)).otherwise(F.get(b["ends"], n - 1) <= s["start"]))
        return F.filter(candidates, lambda s: clear(s) & (ratio(s["value"]) >= THRESHOLD))

    free = F.filter(candidates, lambda s: ratio(s["value"]) >= THRESHOLD)
    sides = F.struct(F.transform(base, lambda b: b["start"]).alias("starts"), reach_of(base).alias("ends"))
    return F.when(F.size(base) == 0, free).otherwise(bound(sides, clear_of))


def reach_of(spans: Column) -> Column:
    """The greatest end of each span and those before it."""
    return running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, text, base, spans (base and markov, by start, then kind) for each row."""
    scanned = base_spans(docs)
    ratios = train(scanned)
    return scanned.withColumn("spans", F.array_sort(F.concat(F.col("base"), markov_spans(F.col("text"), F.col("base"), ratios))))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """Counts by base kind, digest of base spans, and all spans of each row."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(docs).select(
        "doc_id", *[count(kind) for kind, *_ in KINDS], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span replaced by the mark; overlapping spans get one. Null texts stay null."""
    row = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id"), F.col("text"))
    scanned = row.select("doc", "doc_id", whole_text().alias("text")).withColumn(
        "base", F.array_sort(F.concat(*[spans_of(F.col("text"), kind, n, *rest) for n, (kind, *rest) in enumerate(KINDS)]))
    )
    ratios = train(scanned)
    spans = F.array_sort(F.concat(F.col("base"), markov_spans(F.col("text"), F.col("base"), ratios)))

    def clean_of(x: Column) -> Column:
        """What stands before each span that no earlier one reaches, then the mark; at last the rest."""
        until = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(x["reach"], F.greatest(i - 1, F.lit(0))))
        part = lambda s, i: F.when((i > 0) & (s["start"] < until(i)), F.lit("")).otherwise(F.concat(cut(x["pieces"], until(i), s["start"]), F.lit(mark)))
        rest = cut(x["pieces"], F.get(x["reach"], F.size(x["reach"]) - 1), F.length("text"))
        return F.concat(F.array_join(F.transform("spans", part), ""), rest)

    clean = bound(F.struct(pieces_of(F.col("text")).alias("pieces"), reach_of(F.col("spans")).alias("reach")), clean_of)
    done = scanned.withColumn("spans", spans).withColumn("clean", F.when(F.size("spans") > 0, clean))
    changed = {"text": F.col("clean"), "n_chars": F.length("clean")}
    return done.select(
        *[
            F.when(F.size("spans") > 0, changed[c].cast(docs.schema[c].dataType)).otherwise(F.col("doc")[c]).alias(c) if c in changed else F.col("doc")[c].alias(c)
            for c in docs.columns
        ]
    )
