import random
from datetime import datetime, timedelta

from statuta.operators.orphans import orphan_references

REFS, PARENTS = "key string, at timestamp, ref_id long, __t string", "key string, loaded_at timestamp, deleted_at timestamp, at string"
T0 = datetime(2024, 1, 1)


def day(n):
    return T0 + timedelta(days=n)


def orphans(spark, refs, parents, **kw):
    r = spark.createDataFrame([(*x, "clash") for x in refs], REFS)
    p = spark.createDataFrame([(*x, "clash") for x in parents], PARENTS)
    return sorted((x.ref_id, x.period, x.orphan_kind) for x in orphan_references(r, p, ["ref_id"], **kw).collect())


def test_kinds_and_edges_of_time(spark):
    parents = [("here", day(0), None), ("gone", day(0), day(10)), ("late", day(20), None), ("back", day(0), day(5)), ("back", day(8), None)]
    refs = [("here", day(0), 1), ("gone", day(9), 2), ("gone", day(10), 3), ("late", day(19), 4), ("late", day(20), 5), ("none", day(1), 6), ("back", day(6), 7), ("back", day(9), 8), (None, day(1), 9), ("here", None, 10)]
    assert orphans(spark, refs, parents) == [(3, "2024-01", "deleted"), (4, "2024-01", "late"), (6, "2024-01", "missing"), (7, "2024-01", "deleted")]


def test_empty_tables(spark):
    assert orphans(spark, [], [("a", day(0), None)]) == []
    assert orphans(spark, [("a", day(0), 1)], []) == [(1, "2024-01", "missing")]


def test_null_parents_and_repeats(spark):
    parents = [(None, day(0), None), ("a", None, None), ("b", day(0), day(1)), ("b", day(0), day(1))]
    refs = [("a", day(2), 1), ("b", day(2), 2), ("b", day(2), 2)]
    assert orphans(spark, refs, parents) == [(1, "2024-01", "missing"), (2, "2024-01", "deleted"), (2, "2024-01", "deleted")]


def test_random_against_definition(spark):
    random.seed(1)
    parents = []
    for _ in range(300):
        a = random.randrange(200)
        parents.append((f"k{random.randrange(40)}", day(a), day(a + random.randrange(-2, 60)) if random.random() < 0.6 else None))
    refs = [(f"k{random.randrange(50)}", day(random.randrange(220)), i) for i in range(400)]
    want = []
    for k, t, i in refs:
        own = [p for p in parents if p[0] == k]
        loaded = [p for p in own if p[1] <= t]
        kind = "missing" if not own else "late" if not loaded else "deleted" if all(p[2] is not None and p[2] <= t for p in loaded) else None
        if kind:
            want.append((i, t.strftime("%Y-%m"), kind))
    assert orphans(spark, refs, parents, ranges=3) == sorted(want)
