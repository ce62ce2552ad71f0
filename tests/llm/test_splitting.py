import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxloom.llm import splitting

ENDS = {"sentence": [13], "line": [198], "turn": [50]}


def forced(n, cuts, limit):
    at = [0, *sorted(cuts), n]
    return any(b - a > limit for a, b in zip(at, at[1:], strict=False))


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 400), st.lists(st.sets(st.integers(1, 399)), min_size=1, max_size=3), st.integers(2, 60), st.integers(0, 59))
def test_pieces(n, levels, limit, overlap):
    overlap = min(overlap, limit - 1)
    cuts = [np.array(sorted(x for x in s if x < n), np.int64) for s in levels]
    natural = {int(x) for c in cuts for x in c}
    was_forced, pieces = splitting.cut_item(n, cuts, limit, overlap)
    assert was_forced == forced(n, natural, limit)
    assert pieces[0][0] == 0 and pieces[-1][1] == n and pieces[0][2] == 0
    for (_, b, _), (c, d, o) in zip(pieces, pieces[1:], strict=False):
        assert c + o == b and d > b and 0 <= o <= overlap
        # short of the overlap only before a stretch that no natural boundary divides and that would not fit beside it
        assert o == overlap or o == b or any(y - x > limit - overlap and x == b for x, y in zip([0, *sorted(natural)], [*sorted(natural), n], strict=True))
        if b not in natural:
            assert was_forced
    assert all(b - a <= limit for a, b, _ in pieces)


def test_packed_samples(spark):
    speech = [100 + (i % 4) * 10 for i in range(40)]  # whole frames
    rows = [
        ("at", [1] * 16, None),
        ("long", [1] * 10 + [13] + [1] * 9, None),
        ("solid", [1] * 20, None),
        ("frames", speech, [1] * 40),
        ("padded", [1] * 20, [1] * 16 + [0] * 4),
        ("null", None, None),
        ("empty", [], []),
    ]
    df = spark.createDataFrame([*rows, rows[1]], "sample_id string, input_ids array<int>, attention_mask array<int>").selectExpr("sample_id", "input_ids", "cast(attention_mask as array<tinyint>) attention_mask", "1 as size", "2 as cut")
    got = {r["item_id"]: r for r in splitting.split_packed(df, 16, 4, ENDS, 100, 10, 4, with_ids=True).collect()}
    assert {k: r["cut"] for k, r in got.items()} == {"long": "natural", "solid": "forced", "frames": "natural"}
    assert [(p["start"], p["stop"], p["overlap"], p["boundary"]) for p in got["long"]["pieces"]] == [(0, 11, 0, "sentence"), (7, 20, 4, "end")]
    assert all((p["stop"] - p["start"]) <= 16 and (p["stop"] % 4 == 0) for p in got["frames"]["pieces"])
    with pytest.raises(ValueError):
        splitting.split_packed(df, 16, 16, ENDS, 100, 10, 4)
    assert splitting.split_packed(df.limit(0), 16, 4, ENDS, 100, 10, 4).count() == 0


def test_passages(spark):
    index = spark.createDataFrame([(f"1_1_{i}", 30, None) for i in range(11)] + [("1_2_0", 200, None), ("1_3_0", None, 8.0)], "stem string, num_frames int, duration_sec double")
    spoken = spark.createDataFrame(
        [("a", [f"1_1_{i}.wav" for i in (10, 0, 2, 1, 3, 4, 5, 6, 7, 8, 9)]), ("b", ["1_1_0.wav", "1_2_0.wav"]), ("c", ["1_3_0.wav", "x_y.wav"]), ("d", []), ("e", None), ("a", [f"1_1_{i}.wav" for i in (10, 0, 2, 1, 3, 4, 5, 6, 7, 8, 9)])],
        "id string, audio_files array<string>",
    )
    got = {r["item_id"]: r for r in splitting.split_passages(spoken, index, 100, 10).collect()}
    assert {k: (r["size"], r["cut"]) for k, r in got.items()} == {"a": (330, "natural"), "b": (230, "forced")}
    assert [r["stem"] for r in got["a"]["recordings"]] == [f"1_1_{i}" for i in range(11)]
    assert all(p["stop"] % 30 == 0 for p in got["a"]["pieces"])
    assert [r["size"] for r in splitting.passages(spoken, index).filter("id = 'c'").collect()] == [100]
