from datetime import datetime

from statuta.operators.history import append_snapshot, attribute_history, stored_history

SCHEMA = "law string, snap string, date string, status string, loaded timestamp, id long, __key string, text string"
T = lambda d: datetime(2024, 1, d)


def history(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    out = attribute_history(df, "law", "snap", ["date", "status"], ["loaded", "id"])
    return sorted(tuple(r) for r in out.select("law", "date", "status", "valid_from", "valid_to").collect())


def row(law, snap, date, status, day=1, i=0):
    return (law, snap, date, status, T(day), i, "clash", None)


def test_versions_fold_return_and_skip(spark):
    rows = [
        row("a", "2024-01", "d1", "x"),
        row("a", "2024-02", "d1", "x"),
        row("a", "2024-04", "d2", "x"),  # March is missing and ends nothing
        row("a", "2024-05", "d1", "x"),  # a version that returns
        row("b", "2024-02", "d1", "y"),
    ]
    assert history(spark, rows) == [
        ("a", "d1", "x", "2024-01", "2024-04"),
        ("a", "d1", "x", "2024-05", "9999-12-31"),
        ("a", "d2", "x", "2024-04", "2024-05"),
        ("b", "d1", "y", "2024-02", "9999-12-31"),
    ]


def test_latest_row_holds_and_ties_go_by_id(spark):
    rows = [row("a", "1", "old", "x", 1, 1), row("a", "1", "new", "x", 2, 0), row("b", "1", "p", "x", 1, 5), row("b", "1", "q", "x", 1, 6), row("b", "1", "q", "x", 1, 6)]
    assert history(spark, rows) == [("a", "new", "x", "1", "9999-12-31"), ("b", "q", "x", "1", "9999-12-31")]


def test_nulls_tell_nothing(spark):
    rows = [row(None, "1", "d", "x"), row("a", None, "d", "x"), row("a", "1", None, "x"), row("a", "2", "d", None), row("a", "3", "d", "x")]
    assert history(spark, rows) == [("a", "d", "x", "3", "9999-12-31")]


def test_empty(spark):
    assert history(spark, []) == []


def test_many_keys_against_plain_fold(spark):
    import random

    random.seed(4)
    rows = [row(f"k{k}", f"{s:02d}", random.choice("ab"), random.choice("xy"), 1, 0) for k in range(60) for s in range(12) if random.random() < 0.7]
    want = []
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append((r[1], r[2], r[3]))
    for k, v in by.items():
        v.sort()
        kept = [x for i, x in enumerate(v) if i == 0 or x[1:] != v[i - 1][1:]]
        want += [(k, d, s, a, kept[i + 1][0] if i + 1 < len(kept) else "9999-12-31") for i, (a, d, s) in enumerate(kept)]
    assert history(spark, rows) == sorted(want)


def test_snapshots_appended_one_by_one(spark, tmp_path):
    import random

    r = random.Random(2)
    rows, row_id = [], 0
    state = {f"law{i}": (f"2020-01-{i % 28 + 1:02d}", "有效") for i in range(40)}
    for month in range(1, 8):
        for law in r.sample(sorted(state), 3 if month > 1 else 0):
            state[law] = (f"2021-{month:02d}-01", r.choice(["有效", "已修订"]))
        for law, (day, status) in state.items():
            if month != 4 or law != "law7":
                row_id += 1
                rows.append((law, f"2022-{month:02d}-28", day, status, row_id))
    df = spark.createDataFrame([*rows, (None, "2022-01-28", "x", "y", 0)], "law string, at string, day string, status string, row_id long")
    want = sorted(tuple(x) for x in attribute_history(df, "law", "at", ["day", "status"], ["row_id"]).collect())
    folder = str(tmp_path / "history")
    changed = [append_snapshot(folder, df.where(df.at == at), "law", at, ["day", "status"], ["row_id"]) for at in sorted({x[1] for x in rows})]
    got = sorted((x.law, x.day, x.status, x.valid_from, x.valid_to) for x in stored_history(spark, folder, "law").collect())
    assert got == want
    # later snapshots look into few leaves: three changed laws, and one that was missing and came back
    assert changed[0] >= 35 and all(c <= 5 for c in changed[1:])
    try:
        append_snapshot(folder, df, "law", "2022-01-28", ["day", "status"], ["row_id"])
        raise AssertionError("out of order")
    except ValueError:
        pass
