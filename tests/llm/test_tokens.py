import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ferrule.llm import token_counts as C
from ferrule.llm import token_packing as P


def enc():
    with open(C.VOCABULARY, "rb") as f:
        return C.encoding(f.read())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab Zé9 '\n\t_-中s!²Ⅷ"), max_size=80), st.integers(1, 12))
def test_parts_add_up(text, long):
    cut = list(C.parts(text, long))
    assert "".join(cut) == text
    assert sum(len(enc().encode_ordinary(p)) for p in cut) == len(enc().encode_ordinary(text))


def test_batches_are_balanced():
    rnd = random.Random(1)
    texts = ["word " * rnd.choice([0, 1, 50, 3000]) for _ in range(200)] + [None]
    sizes = [sum(len(p) for _, p in b) for b in C.batches(texts, 5000, 1000)]
    assert all(5000 <= s < 5000 + 1100 for s in sizes[:-1])


def test_a_batch_is_encoded_as_its_parts():
    rnd = random.Random(3)
    texts = ["", C.MARK, f"a{C.MARK}b", C.MARK[1:], "<|endoftext|>", *(" ".join(rnd.choice(["tion", "über", "x\n", "中文", "  "]) for _ in range(rnd.randint(0, 30))) for _ in range(200))]
    ids, first, end = C.encode(enc(), texts)
    assert [ids[a:z].tolist() for a, z in zip(first, end)] == [enc().encode_ordinary(t) for t in texts]
    for size, long in ((1, 1), (50, 7), (10**6, 10**6)):
        assert C.count([*texts, None], enc(), size, long) == [*(len(enc().encode_ordinary(t)) for t in texts), None]


def test_counts(spark):
    rows = [(1, "Hello world's", 0), (1, "Hello world's", 0), (None, "é" * 10, 0), (2, None, 0), (3, "", 0), (4, "long text " * 30000, 0), (5, "x" * 200000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tokens int")
    got = sorted(((r.doc_id, r.tokens) for r in C.token_counts(df).collect()), key=str)
    assert got == sorted(((i, None if t is None else len(enc().encode_ordinary(t))) for i, t, _ in rows), key=str)
    assert C.token_counts(df.where("false")).count() == 0


def slow_best_fit(sizes, length):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= s]
        if fits:
            i = min(fits, key=lambda i: rooms[i])
            rooms[i] -= s
        else:
            rooms.append(length - s)
    return sorted(rooms)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 37), max_size=60))
def test_segment_tree_is_best_fit(sizes):
    packed = P.best_fit(sizes, 37)
    assert sorted(i for row in packed for i in row) == list(range(len(sizes)))
    assert sorted(37 - sum(sizes[i] for i in row) for row in packed) == slow_best_fit(sizes, 37)


def unpack(rows, length):
    texts = {}
    for r in rows:
        ids, places = np.frombuffer(r["input_ids"], "<u2"), np.frombuffer(r["position_ids"], "<u2")
        cu = r["cu_seqlens"]
        assert len(ids) == len(places) == length and cu[0] == 0 and cu[-1] == r["tokens"] and (ids[cu[-1] :] == 50256).all()
        assert len(r["doc_ids"]) == len(r["doc_starts"]) == len(cu) - 1
        for a, z, doc, start in zip(cu, cu[1:], r["doc_ids"], r["doc_starts"]):
            assert (places[a:z] == np.arange(z - a)).all()
            texts.setdefault(doc, []).append((start, ids[a:z].tolist()))
    return {d: [x for _, part in sorted(p) for x in part] for d, p in texts.items()}


def test_round_trip(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choice(["tion", "über", "x", "hello"]) for _ in range(rnd.choice([0, 3, 40, 700]))), i) for i in range(150)] + [(900, None, 1), (901, "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tokens int").repartition(3)
    packed = P.pack_tokens(df, length=64, pool=5000)
    got = packed.collect()
    assert len({r.pack_id for r in got}) == len(got)
    assert unpack([r.asDict() for r in got], 64) == {i: enc().encode_ordinary(t) for i, t, _ in rows if t}
    full = sum(r.tokens for r in got) / (64 * len(got))
    assert full > 0.95
    files = P.write_binary(packed, str(tmp_path)).collect()
    assert sum(f["rows"] for f in files) == len(got)
    again = []
    for f in files:
        read = lambda k, t: np.fromfile(tmp_path / f"{f['file']}.{k}", t)  # noqa: B023, E731
        ids, cu, n = read("ids", "<u2").reshape(-1, 64), read("cu", "<i4"), read("segments", "<i4")
        assert len(ids) == len(n) == f["rows"] and read("positions", "<u2").shape == (ids.size,)
        again += [(i.tobytes(), c.tolist()) for i, c in zip(ids, np.split(cu, np.cumsum(n)[:-1]))]
    assert sorted(again) == sorted((bytes(r.input_ids), r.cu_seqlens) for r in got)


def test_packing_edges(spark):
    df = spark.createDataFrame([(None, "some text"), (1, "same"), (1, "same"), (2, "word " * 9000)], "doc_id long, text string")
    got = P.pack_tokens(df).collect()
    docs = [d for r in got for d in r.doc_ids]
    assert docs.count(None) == 1 and docs.count(1) == 2 and sum(r.tokens for r in got if r) > 9000
    assert P.pack_tokens(df.where("false")).count() == 0
