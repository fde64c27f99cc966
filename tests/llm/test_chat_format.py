"""Chat formatting: round trips, and paths against brute force."""

import random
import tracemalloc

from hypothesis import given
from hypothesis import strategies as st
from lamina.llm import chat_format as C
from lamina.llm.common import ready

PIECES = st.lists(st.sampled_from(["\\", "###", "#", "</turn>", "</", "turn>", "\n", ": ", "a", "é", "😀", "### Assistant: "]), max_size=12).map("".join)


@given(st.lists(st.tuples(st.one_of(st.just("assistant"), PIECES), PIECES), max_size=6))
def test_round_trip(turns):
    text, spans = C.format_turns(turns)
    assert C.parse_turns(text) == turns
    under = [C._BACK.sub(r"\1", text[a:b]) for a, b in spans]
    assert under == [t for r, t in turns if r == "assistant"]


def test_paths_and_ranks_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for conv in range(12):
        for m in range(1, rng.randint(2, 40)):
            rows.append((conv, m, rng.choice([None, m - 1, m - 1, rng.randint(1, m)]), "user", f"t{m}", rng.choice([None, 0.5, 1.0, 2.0])))
    messages = ready(spark).createDataFrame(rows, "conv_id long, msg long, parent long, role string, text string, score double")
    want = {}
    for conv in range(12):
        mine = {m: (p if p is not None and p < m and p >= 1 else None, s or 0.0) for c, m, p, _, _, s in rows if c == conv}
        leaves = set(mine) - {p for p, _ in mine.values()}
        paths = []
        for leaf in leaves:
            path, at = [], leaf
            while at is not None:
                path.append(at)
                at = mine[at][0]
            paths.append((-sum(mine[m][1] for m in path), leaf, path))
        for rank, (_, leaf, path) in enumerate(sorted(paths)[:3], 1):
            want[conv, leaf] = (rank, path)
    got = {}
    for r in C.chosen_paths(messages, top=3).collect():
        got.setdefault((r.conv_id, r.leaf), (r["rank"], {}))[1][r.place] = r.msg
    assert {k: (rank, [p[i] for i in range(len(p))]) for k, (rank, p) in got.items()} == want


def test_defined_cases(spark):
    schema = "conv_id long, turn long, role string, text string, msg string, score string"
    rows = [(1, 0, "user", None, "x", "y"), (1, 1, None, "b", "x", "y"), (1, 1, "assistant", "a" * 100_000, "x", "y"), (None, 0, "user", "n", "", "")]
    told = ready(spark).createDataFrame(rows, schema)
    got = {r.conv_id: r for r in C.read_back(C.formatted(C.reply_tree(told))).collect()}
    big = (1 << 60) + 1
    beside = C.read_back(C.formatted(C.reply_tree(told.unionByName(ready(spark).createDataFrame([(big, 0, "user", "x", "", "")], schema))))).collect()
    assert {r.conv_id for r in beside} == {1, None, big}
    assert got[1].n_turns == 3 and got[1].loss_chars == 100_000 and got[None].n_turns == 1
    assert C.read_back(C.formatted(C.reply_tree(told.limit(0)))).collect() == []


def test_long_texts_are_read_back_in_little_memory():
    """A state for each character would take a hundred times the text."""
    turns = [("user", "a<b \\\\ é " * 400_000), ("assistant", "plain " * 400_000)]
    text, _ = C.format_turns(turns)
    tracemalloc.start()
    found = C.parse_turns(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == turns and peak < 20 * len(text)
