from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st

from radweave.operators import packed

NAMES = packed._known(["Pneumonia / Consolidation", "Lung Mass / Nodule", "Cardiomegaly"])


@pytest.mark.parametrize(
    ("field", "values"),
    [
        (None, []), ("", []), (" \t ", []), (",;,", []), ("a", ["a"]), (" a , b ;c|d/e+f\ng\th ", list("abcdefgh")), ("a,,b;", ["a", "b"]), ("a\r\nb", ["a", "b"]),
        ("lung mass / nodule / Cardiomegaly", ["lung mass / nodule", "Cardiomegaly"]), ("Cardiomegaly/Pneumonia / Consolidation", ["Cardiomegaly", "Pneumonia / Consolidation"]),
        ("Lung Mass / Nodules", ["Lung Mass", "Nodules"]), ('"a, b";c', ["a, b", "c"]), ('"a ""b"""', ['a "b"']), ("['x, y', \"z\"]", ["x, y", "z"]), ("[]", []), ('["a"]', ["a"]),
        ('"open, x', ["open, x"]), ("it's, b", ["it's", "b"]), ("a (b, c), d", ["a (b, c)", "d"]), ("a (b, c", ["a (b", "c"]), (r'"a\"b", c', ['a"b', "c"]), ('""', []), ('"", a', ["a"]), ("{a; b}", ["a", "b"]),
        ('Foo (bar, "a, b"', ["Foo (bar", "a, b"]), ('(a, "b)c", d), e', ['(a, "b)c", d)', "e"]), ("pneumonia/consolidation, TB", ["pneumonia/consolidation", "TB"]), ("lung  mass/ nodule", ["lung  mass/ nodule"]),
        ("(it's, b), c", ["(it's, b)", "c"]), ("a) b, c", ["a) b", "c"]), ("x (y [z, w), q", ["x (y [z, w)", "q"]), ("a ('b, c), d", ["a ('b, c)", "d"]),
    ],
)
def test_cases(field, values):
    assert packed.split_packed(field, NAMES) == values


@given(st.lists(st.text(st.characters(codec="utf-8", exclude_categories=["Cc", "Cs"]), min_size=1).map(str.strip).filter(lambda v: v and "\\" not in v), min_size=1, max_size=6), st.sampled_from([", ", ";", " | ", "/", "\n"]))
def test_quoted_values_round_trip(values, delimiter):
    field = delimiter.join('"' + v.replace('"', '""') + '"' for v in values)
    assert packed.split_packed(field) == values


def test_table(spark):
    df = spark.createDataFrame([(1, "a,b", None, 7), (1, "a,b", "c", 7), (2, None, '"d;e";f', 8)], "rec_id long, x string, y string, val int")
    names = spark.createDataFrame([("p / q",), (None,)], "label string")
    got = sorted(map(tuple, packed.unpack(df, "rec_id", ["x", "y"], names).collect()))
    assert got == sorted([(1, "x", 1, "a"), (1, "x", 2, "b"), (1, "x", 1, "a"), (1, "x", 2, "b"), (1, "y", 1, "c"), (2, "y", 1, "d;e"), (2, "y", 2, "f")])
    assert {r.field_name for r in packed.unpack(df, "rec_id", ["x", "y"], names, 2).collect()} == {"x", "y"}
    assert packed.unpack(df.limit(0), "rec_id", ["x", "y"]).count() == 0


def test_very_long_field():
    values = [f"v{i}" for i in range(50_000)]
    assert packed.split_packed(", ".join(values)) == values
