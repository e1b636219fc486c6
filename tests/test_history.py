import itertools

from spanforge.functions import lookalike
from spanforge.operators.history import entity_history


def versions(states):
    """Brute force over {position: values}."""
    out, run = [], None
    for p in range(1, max(states) + 2):
        v = states.get(p)
        if run and (v is None or v != run[1]):
            out.append((*run[1], run[0], p))
            run = None
        if v is not None and run is None:
            run = (p, v)
    return out


def test_history_against_brute_force(spark):
    values = [None, ("a", "x"), ("a", None), ("b", "x")]
    rows, want = [], []
    for n, choice in enumerate(itertools.product(values, repeat=4)):
        states = {p: v for p, v in enumerate(choice, 1) if v is not None}
        rows += [(f"e{n}", p, *v) for p, v in states.items()]
        if states:
            want += [(f"e{n}", *v) for v in versions(states)]
    df = spark.createDataFrame(rows, "e string, at int, one string, two string")
    got = [(r["e"], r["one"], r["two"], r["from_position"], r["to_position"]) for r in entity_history(df, ["e"], "at", ["one", "two"]).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_empty(spark):
    df = spark.createDataFrame([], "e string, at int, one string")
    assert entity_history(df, ["e"], "at", ["one"]).count() == 0


def test_units_of_laws(spark):
    from spanforge.plans.history import unit_versions

    editions = spark.createDataFrame(
        [("L", "2020-01-01", "01.02.2020", None), ("L", "2020-01-01", "01.02.2020", None), ("L", "2021-01-01", None, None), ("L", "2022-01-01", "2022-03-01", None)],
        "law_id string, edition_id string, effective_from string, downloaded_at timestamp",
    )
    unit = "norm_id string, edition_id string, title string, text string, is_repealed boolean, loaded_at timestamp, extra string"
    norms = spark.createDataFrame(
        [
            ("L:2020-01-01:art.1", "2020-01-01", None, "текст один", False, None, "z"),
            ("L:2021-01-01:art.1", "2021-01-01", None, "тeкст oдин", False, None, None),
            ("L:2022-01-01:art.1", "2022-01-01", None, "текст два", False, None, None),
            ("L:2020-01-01:art.2", "2020-01-01", "t", None, None, None, None),
            ("L:2022-01-01:art.2", "2022-01-01", "t", None, None, None, None),
        ],
        unit,
    )
    got = {tuple(r) for r in unit_versions(editions, norms).select("unit_key", "valid_from", "valid_to").collect()}
    assert got == {
        ("L:art.1", "2020-02-01", "2022-03-01"), ("L:art.1", "2022-03-01", "9999-12-31"),
        ("L:art.2", "2020-02-01", "2021-01-01"), ("L:art.2", "2022-03-01", "9999-12-31"),
    }


def test_full_width_letters_have_the_shape_of_their_twins():
    wide, plain = "заявл" + chr(0xFF45) + "нию", "заявлению"
    assert lookalike.skeleton_text(wide) == lookalike.skeleton_text(plain) == plain
