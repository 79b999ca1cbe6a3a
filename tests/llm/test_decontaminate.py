"""Decontamination against brute force: every substring's edit distance by the full dynamic programme."""

import random

import numpy as np
import pyarrow as pa

from ferrule.llm import decontaminate as D


def letters(text: str) -> list[int]:
    return next(D.letters(pa.array([text])))[1].tolist() if text else []


def fewest(item, text) -> int:
    """Edits between item and the part of text nearest to it."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def cases(seed: int, n: int = 60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(["th", "en", "er", "on", "ti", "é"]) for _ in range(rnd.randint(1, 4)))
    items = [(i, " ".join(word() for _ in range(rnd.randint(6, 30)))) for i in range(5)]
    docs = []
    for d in range(n):
        text = [word() for _ in range(rnd.randint(0, 60))]
        if d % 2:
            chars = list(rnd.choice(items)[1])
            for _ in range(rnd.randint(0, max(1, len(chars) // 8))):
                k = rnd.randrange(len(chars))
                chars[k : k + rnd.randint(0, 1)] = rnd.choice("abe ")
            k = rnd.randint(0, len(text))
            text[k:k] = ["".join(chars).upper() if d % 3 == 0 else "".join(chars)]
        docs.append((d, " ".join(text)))
    return items, docs


def test_finds_what_brute_force_finds(spark):
    for seed in range(3):
        items, docs = cases(seed)
        index = D.Index([(i, np.array(letters(t))) for i, t in items], D.Q, D.RATE)
        want = {(d, i) for d, t in docs for k, (i, x) in enumerate(items) if fewest(letters(x), letters(t)) <= index.budget[k]}
        got = D.passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and want
        for r in got:
            part = letters(dict(docs)[r.doc_id])[r.start : r.end]
            assert fewest(letters(dict(items)[r.item_id]), part) == r.edits
        kept = D.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
        assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_slices_give_what_one_pass_gives(spark):
    items, docs = cases(9)
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(D.passages(a, b, pass_letters=100).collect()) == sorted(D.passages(a, b).collect())


def test_edges(spark):
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over it"), (2, None), (3, ""), (4, "tiny"), (None, "the quick brown fox")], "item_id long, text string")
    docs = spark.createDataFrame([(1, None, "x"), (None, "A: The quick, brown fox jumps over it!", "y"), (2, "", "z"), (3, "tiny", "w"), (3, "tiny", "w"), (4, "the quick brown fox jumps over it. " * 3000, "v")], "doc_id long, text string, item_id string")
    rows = D.passages(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(None, 1), (4, 1)}
    assert sum(r.doc_id == 4 for r in rows) == 3000
    kept = D.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(kept.collect(), key=str) == sorted([(1, None, "x"), (2, "", "z"), (3, "tiny", "w"), (3, "tiny", "w")], key=str)
    empty = docs.where("false")
    assert D.passages(empty, bench).count() == 0 and D.decontaminate(empty, bench).count() == 0
    assert D.passages(docs, bench.where("false")).count() == 0 and D.decontaminate(docs, bench.where("false")).count() == docs.count()


def test_piece_that_begins_with_the_end_of_the_longest_item():
    rng = np.random.default_rng(0)
    short, long, rest = (rng.integers(97, 123, n).astype(np.uint8) for n in (60, 300, 500))
    for items in ([(1, short), (2, long)], [(2, long), (1, short)]):
        index = D.Index(items, D.Q, D.RATE)
        for n in range(8, 60):
            data = np.concatenate([long[-n:], rest[: 500 - n], short])
            found = D.find(data, np.array([0, 500, len(data)]), index)
            assert [(row, index.items[k][0], *x) for row, k, *x in found] == [(1, 1, 0, 60, 0)]


def test_very_long_texts():
    """Items far beyond 2**24 letters are found where they stand, without an edit; so are words beyond 2**24."""
    item = np.frombuffer(b"thequickbrownfoxjumps", np.uint8)
    places = (16_777_116, (1 << 24) + 316, 3 * (1 << 24) + 5)
    data = np.random.default_rng(0).integers(48, 58, places[-1] + 1000).astype(np.uint8)
    for at in places:
        data[at : at + len(item)] = item
    found = D.find(data, np.array([0, len(data)]), D.Index([(7, item)], D.Q, D.RATE))
    assert found == [(0, 0, at, at + len(item), 0) for at in places]
    words = data.astype(np.uint64)
    for at in places:
        first = np.array([at - 5])
        edits, start, end = D.align(item.astype(np.uint64), words, first, 10, np.array([0]), np.array([len(words)]))
        assert (edits[0], start[0], end[0]) == (0, at, at + len(item))


def test_quotes_spaces_and_forms_dont_hide_an_item(spark):
    item = "Don't the café's owners' naïve friends count 1/2 of it?"
    forms = [item, item.replace("'", "’"), item.replace(" ", " "), item.replace("é", "é").replace("ï", "ï"), "“" + item.upper() + "”", item.replace("count", "ｃount")]
    docs = spark.createDataFrame([(i, f"Before — {t} after.") for i, t in enumerate(forms)], "doc_id long, text string")
    rows = D.passages(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {(r.doc_id, r.edits) for r in rows} == {(i, 0) for i in range(len(forms))}


def test_scripts_without_spaces(spark):
    """An edit is a character, whatever the bytes it takes."""
    rnd = random.Random(1)
    han = lambda n: "".join(chr(rnd.randrange(0x4E00, 0x9FA5)) for _ in range(n))
    item = han(60)
    budget = int(D.Index([(0, np.array(list(map(ord, item))))], D.Q, D.RATE).budget[0])
    docs, want = [], set()
    for d, edits in enumerate([0, 1, budget, budget + 3]):
        chars = list(item)
        for k in rnd.sample(range(60), edits):
            chars[k] = han(1)
        docs.append((d, han(100) + "。" + "".join(chars) + han(50)))
        if fewest(item, docs[-1][1].replace("。", "")) <= budget:
            want.add(d)
    got = D.passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert {r.doc_id for r in got} == want == {0, 1, 2}
