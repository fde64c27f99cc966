"""Fingerprints and classes against brute force."""

import random

import numpy as np
import xxhash
from lamina.llm import simhash_dedup as S
from lamina.llm.common import ready

DOCS = "doc_id long, text string, fp string, component_id int, key string"


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute_classes(prints):
    """prints: {doc_id: fp}"""
    ids, root = sorted(prints), {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def corpus(rng):
    words = [f"w{i}é" for i in range(40)] + ["The", "THE", "a"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(60)]
    for t in texts[:15]:
        parts = t.split(" ")
        texts += [t, t + "  \n", " ".join([*parts[:-1], "edited"])]
    return [*texts, None, "", " \t\n", "one", "One", "one two", "x" * 200_000, "hot copy " * 5000]


def test_matches_brute_force_with_clashing_columns(spark):
    rows = [(i * 7 + 3, t, "x", 1, "k") for i, t in enumerate(corpus(random.Random(5)))]
    got = {r.doc_id: r for r in S.near_duplicates(ready(spark).createDataFrame(rows, DOCS)).collect()}
    prints = {i: brute_fingerprint(t) for i, t, *_ in rows}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == prints
    assert all(len(r.fingerprint) == 16 for r in got.values())
    assert {i: r.component_id for i, r in got.items()} == brute_classes(prints)


def test_spanning_links_join_all_that_links_join():
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([s ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) for s in seeds]))
    fps = fps[np.lexsort((fps, np.bitwise_count(fps)))]
    want = brute_classes(dict(enumerate(map(int, fps))))
    half = len(fps) // 3
    for parts in ([(fps, None, 0)], [(fps[:half], None, 0), (fps[half:], None, half), (fps[:half], fps[half:], 0)]):
        edges = [(a + s, b + s) for x, y, s in parts for a, b in S.spanning_links(S.Block(x), None if y is None else S.Block(y), 3)]
        root = list(range(len(fps)))

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            x, y = sorted((find(a), find(b)))
            root[y] = x
        assert {i: find(i) for i in range(len(fps))} == want
        assert all((int(fps[a]) ^ int(fps[b])).bit_count() <= 3 for a, b in edges)


def test_blocks_and_components(spark, monkeypatch):
    monkeypatch.setattr(S, "PACK_ROWS", 8)
    monkeypatch.setattr(S, "TILE", 8)
    rng = random.Random(9)
    prints = {}
    for n in range(60):
        fp = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 9])):
            prints[len(prints)] = fp
            fp ^= 1 << rng.randrange(64)
    first = {}
    for i, fp in prints.items():
        first.setdefault(fp, i)
    fps = ready(spark).createDataFrame([(signed(fp), i) for fp, i in first.items()], "fp long, rep long")
    roots = {r.node: r.root for r in S.components(S.links(fps)).collect()}
    want = brute_classes({i: fp for fp, i in first.items()})
    assert {i: roots.get(i, i) for i in want} == want


def test_long_chain_of_links(spark):
    chain = spark.createDataFrame([(i + 1, i) for i in range(200)], "a long, b long")
    assert {(r.node, r.root) for r in S.components(chain).collect()} == {(i, 0) for i in range(1, 201)}


def test_empty_null_and_repeated_rows(spark):
    ready(spark)
    empty = spark.createDataFrame([], DOCS)
    assert S.near_duplicates(empty).collect() == [] and S.one_of_similar(empty).collect() == []
    rows = spark.createDataFrame([(5, "a b c d", "", 1, ""), (5, "a b c d", "", 1, ""), (None, "a b c d", "", 1, ""), (2, None, "", 1, "")], DOCS)
    got = sorted((r.doc_id or -1, r.component_id) for r in S.near_duplicates(rows).collect())
    assert got == [(-1, 5), (2, 2), (5, 5), (5, 5)]
    assert sorted(r.doc_id for r in S.one_of_similar(rows).collect()) == [2, 5]
    assert S.one_of_similar(rows).columns == rows.columns


def test_large_ids_beside_null_ones_and_unlike_texts_of_one_id(spark):
    big, text = (1 << 60) + 1, " ".join(f"x{i}" for i in range(40))
    other = " ".join(f"y{i}" for i in range(40))
    rows = [(big, text), (None, text), (big + 2, other), (3, text.upper()), (3, other), (None, "alone")]
    got = S.near_duplicates(ready(spark).createDataFrame(rows, "doc_id long, text string")).collect()
    name = {brute_fingerprint(t): t.lower() for _, t in rows}
    found = sorted((name[int(r.fingerprint, 16)], r.doc_id or 0, r.component_id) for r in got)
    assert found == sorted([(text, big, 3), (text, 0, 3), (text, 3, 3), (other, big + 2, 3), (other, 3, 3), ("alone", 0, None)])


def gram_sets(texts, size=5):
    split = [(t or "").lower().split() for t in texts]
    return [{tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set() for w in split]


def similar_classes(texts):
    """The smallest index of each text's class, by exact Jaccard similarity of 0.8."""
    sets, root = gram_sets(texts), list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(texts))]


def edited(words, n, rng):
    """Words with n of them, apart from each other, replaced."""
    copy = list(words)
    for at in range(n):
        copy[at * len(copy) // n + 3] = f"new{rng.random()}"
    return copy


def similar_rows(spark, texts):
    df = ready(spark).createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r.doc_id for r in S.one_of_similar(df).collect()}


def wide(texts):
    return [int.from_bytes(S.votes_of(S.gram_hashes(t, 5)).tobytes(), "big") for t in texts]


def test_wide_fingerprints_and_bitmaps_against_brute_force():
    rng = random.Random(11)
    for n in (0, 1, 4, 5, 6, 30, 500):
        text = " ".join(rng.choices(["a", "B", "c", "dé"], k=n))
        grams = S.gram_hashes(text, 5)
        assert len(grams) == len(gram_sets([text])[0]) and (np.sort(grams) == grams).all()
        votes = np.zeros((S.WORDS, 64), dtype=int)
        for k in range(S.WORDS):
            for h in S.mixed(grams ^ S._KEYS[k]):
                votes[k] += np.unpackbits(np.frombuffer(np.uint64(h).tobytes(), dtype=np.uint8))
        assert (np.packbits(2 * votes > len(grams)) == S.votes_of(grams).view(np.uint8)).all()
        assert int(np.bitwise_count(S.bitmap_of(grams).view(np.uint64)).sum()) == len({int(g) % 64 + 64 * (int(g) // 64 % S.WORDS) for g in grams})
    alike = [(S.gram_hashes(t, 5), S.gram_hashes(t + " more", 5)) for t in ("a b c d e f g h i", "a b c d e f g h i j k l m n")]
    assert all(len(np.intersect1d(x, y)) == len(x) == len(y) - 1 for x, y in alike)


def test_sizes_bound_how_far_similar_sets_lie_apart():
    for p in range(1, S.MOST_SHORT + 1):
        for q in range(1, S.MOST_SHORT + 1):
            found = [p + q - 2 * c for c in range(min(p, q) + 1) if 5 * c >= 4 * (p + q - c)]
            assert not found or max(found) <= S.APART[p + q]
    assert all(S.may_reach(S.SHORT - 1, n) == (n <= S.MOST_SHORT) for n in range(S.SHORT, 60))


def test_only_similar_texts_are_one_class(spark, monkeypatch):
    monkeypatch.setattr(S, "PACK_ROWS", 16)
    monkeypatch.setattr(S, "PACK_GRAMS", 2000)
    monkeypatch.setattr(S, "COLUMNS", 50)
    monkeypatch.setattr(S, "TILE", 16)
    rng = random.Random(3)
    texts = []
    for _ in range(30):  # 300 words: five edits are a similarity of 0.84, eight one of 0.76, which many fingerprints link
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        texts += [" ".join(edited(words, n, rng)) for n in (1, 1, 5, 8, 8, 10)]
    rng.shuffle(texts)
    want = set(similar_classes(texts))
    prints = wide(texts)
    sets = gram_sets(texts)
    false = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= S.RADIUS and 5 * len(sets[i] & sets[j]) < 4 * len(sets[i] | sets[j])]
    assert len(false) > 10
    assert similar_rows(spark, texts) == want


def test_sets_of_one_size_in_one_chain_fill_several_packs(spark, monkeypatch):
    packs, saved = [], S.saved

    def counting(df, what):
        table = saved(df, what)
        if what == "packs":
            sizes = [len(r.rep) // 8 for r in table.select("rep").collect()]
            packs.append((len(sizes), max(sizes, default=0)))
        return table

    monkeypatch.setattr(S, "saved", counting)
    monkeypatch.setattr(S, "PACK_GRAMS", 2000)
    rng = random.Random(17)
    words = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    texts = [" ".join(edited(words, 2, rng)) for _ in range(300)] + [" ".join(f"u{rng.randrange(10**6)}" for _ in range(100))]
    assert len({len(s) for s in gram_sets(texts)}) == 1
    assert similar_rows(spark, texts) == {0, 300}
    n, most = packs[-2]  # the sets' comparison by fingerprints; the last is that of small sets
    assert n >= 8 and most <= 100


def test_repeated_lines_neither_link_nor_part_texts(spark):
    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    line, texts = fresh(12), []
    for _ in range(20):  # different texts that share a line, ten times
        texts.append(" ".join(fresh(100) + line * 10))
    for _ in range(20):  # a text, and with its last words ten times
        words = fresh(300)
        texts += [" ".join(words), " ".join(words + words[-12:] * 10)]
    want = similar_classes(texts)
    assert len(set(want)) == 40
    assert similar_rows(spark, texts) == set(want)
    prints = wide(texts)
    assert all((prints[i] ^ prints[j]).bit_count() > S.RADIUS for i in range(20) for j in range(i))


def test_rows_without_own_doc_id_keep_one_of_each_class(spark):
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(8)]
    ids = [None, None, None, 7, 7, 1, None, 7]
    rows = [(i, t, {"k": n}) for n, (i, t) in enumerate(zip([*ids, None, 3, None], [*texts, texts[0], texts[1], ""], strict=True))]
    docs = ready(spark).createDataFrame(rows, "doc_id long, text string, more map<string,int>")
    want = sorted([(-1, texts[0]), (3, texts[1]), (-1, texts[2]), (7, texts[3]), (7, texts[4]), (1, texts[5]), (-1, texts[6]), (7, texts[7]), (-1, "")])
    one = S.one_of_similar(docs)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in one.collect()) == want and one.columns == docs.columns
    again = S.one_of_similar(docs.unionByName(docs))  # each row twice
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in again.collect()) == want


def test_short_texts_by_their_exact_sets(spark):
    rng = random.Random(13)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    line, texts = fresh(9), ["", "", None]
    texts += [" ".join(fresh(rng.choice((1, 4, 5, 6, 6, 6, 7)))) for _ in range(500)]
    for n in (8, 9, 12, 17, 23):
        for _ in range(40):
            words = fresh(n)
            texts += [" ".join(x) for x in (words, [*words, "more"], [*words, *fresh(n // 6 + 1)])]
    texts += [" ".join([*line, *fresh(k % 4)]) for k in range(300)]  # a common line
    rng.shuffle(texts)
    want = similar_classes(texts)
    assert similar_rows(spark, texts) == set(want) and len(set(want)) < len(texts) - 240


def test_rows_without_doc_id_link_others(spark):
    prints = {"a": 0, "b": 0b111, "c": 0b111111, "far": (1 << 64) - 1, "farther": (1 << 64) - 2}
    rows = [(4, prints["a"]), (None, prints["b"]), (2, prints["c"]), (None, prints["far"]), (None, prints["farther"])]
    docs = ready(spark).createDataFrame([(i, signed(p)) for i, p in rows], "doc_id long, fp long")
    got = sorted((r.fp, r.component_id) for r in S.named(docs, 3).collect())
    assert got == [(-2, None), (-1, None), (0, 2), (7, 2), (63, 2)]
