"""Maps, bytes and long lists: learnt in long form, drawn for any number of rows."""

import collections

import pytest
from pyspark.sql import functions as F

from facsimile import Synthesizer, fit, flatten, infer_plan, sample, unflatten
from facsimile.functions.draws import PowerDraws
from facsimile.operators.synthesize import ROW


def test_bytes(spark):
    rows = [(i, None if i % 4 == 0 else bytes([i % 3, 255]) * (i % 7)) for i in range(1, 2001)]
    df = spark.createDataFrame(rows, "order_key long, raw binary")
    model = fit(df)
    got = [r.raw for r in sample(model, 4000, seed=3).collect()]
    filled = [bytes(r) for r in got if r is not None]
    assert abs(len(filled) / len(got) - 0.75) < 0.03
    assert set().union(*filled) == {0, 1, 2, 255}
    assert {len(r) for r in filled} == {2 * k for k in range(7)}
    assert abs(b"".join(filled).count(255) / sum(map(len, filled)) - 0.5) < 0.02


def test_empty_bytes_only(spark):
    df = spark.createDataFrame([(b"",), (None,), (b"",)] * 50, "raw binary")
    got = collections.Counter(r.raw if r.raw is None else bytes(r.raw) for r in sample(fit(df), 600, seed=1).collect())
    assert set(got) == {None, b""} and abs(got[None] / 600 - 1 / 3) < 0.07


@pytest.fixture(scope="module")
def attributes(spark):
    """Every map has ``size``; half have ``colour``; a few have one of many rare keys."""
    rows = []
    for i in range(3000):
        numbers = {"size": i % 10 + 0.5}
        if i % 2:
            numbers["weight"] = 100.0 + i % 5
        if i % 10 == 1:
            numbers[f"rare{i % 700}"] = None if i % 20 == 1 else -1.0
        words = {"colour": ("red", "blue")[i % 2]} if i % 3 else {}
        rows.append((i, None if i % 5 == 0 else numbers, (words, i)))
    schema = "id long, numbers map<string,double>, head struct<words:map<string,string>,n:int>"
    return spark.createDataFrame(rows, schema)


def test_maps(spark, attributes, tmp_path):
    maker = Synthesizer(exact=True).fit(attributes, path=str(tmp_path))
    made = maker.sample(3000, seed=5)
    assert made.schema.simpleString() == attributes.schema.simpleString()
    got = made.collect()

    def counts(rows, pick):
        found = collections.Counter(k for r in rows for k in pick(r) or {})
        return found, sum(pick(r) is None for r in rows)

    for pick in (lambda r: r.numbers, lambda r: r.head.words):
        (new, no_map), (old, no_old) = counts(got, pick), counts(attributes.collect(), pick)
        assert abs(no_map - no_old) < 90 and set(new) <= set(old)
        assert all(abs(new[k] - old[k]) < 120 for k in ("size", "weight", "colour"))
        rare = [sum(n for k, n in c.items() if k.startswith("rare")) for c in (new, old)]
        assert abs(rare[0] - rare[1]) < 80
    values = collections.defaultdict(set)
    for r in got:
        for k, v in (r.numbers or {}).items():
            values["rare" if k.startswith("rare") else k].add(v)
        for k, v in r.head.words.items():
            values[k].add(v)
    assert values["size"] == {n + 0.5 for n in range(10) if n % 5} and values["weight"] == {101.0, 102.0, 103.0, 104.0}
    assert values["rare"] == {None, -1.0} and values["colour"] == {"red", "blue"}
    assert any(r.head.words == {} for r in got)
    again = Synthesizer.load(spark, str(tmp_path)).sample(3000, seed=5).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_map_draws_do_not_depend_on_joins(spark, attributes, monkeypatch):
    """The same maps whether the tables of keys and texts are broadcast or shuffled."""
    maker = Synthesizer().fit(attributes)
    before = sorted(map(str, maker.sample(500, seed=2).collect()))
    for module in ("frequencies", "lookup", "sample"):
        monkeypatch.setattr(f"facsimile.operators.{module}.fits_broadcast", lambda t: False)
    assert sorted(map(str, maker.sample(500, seed=2).collect())) == before


def test_time_and_integer_values(spark):
    df = spark.range(400).selectExpr("map(id % 7, date_add(date'2024-01-01', int(id % 3))) AS days", "map('a', id % 4, 'b', 9L) AS n")
    made = Synthesizer(exact=True).fit(df).sample(400, seed=1)
    assert made.schema.simpleString() == df.schema.simpleString()
    rows = made.collect()
    assert {str(v) for r in rows for v in r.days.values()} == {"2024-01-01", "2024-01-02", "2024-01-03"}
    assert {k for r in rows for k in r.days} == set(range(7))
    assert {r.n["a"] for r in rows if "a" in r.n} == {0, 1, 2, 3} and {r.n["b"] for r in rows if "b" in r.n} == {9}


def test_what_has_no_model_is_told(spark):
    df = spark.range(20).selectExpr("id AS n", "map('a', array(id)) AS m")
    with pytest.warns(UserWarning, match="no values are made for m"):
        made = Synthesizer().fit(df).sample(5)
    assert all(r.m is None for r in made.collect())


def test_tails_of_flat_tables(spark):
    rows = [(1, [1, 2, 3, None, 5]), (2, None), (3, []), (4, [None] * 3), (5, [7, 8])]
    df = spark.createDataFrame(rows, "k int, v array<int>")
    for head in (1, 2, 4):
        plan = infer_plan(df, deep=True, head=head)
        flat = flatten(df, plan, lengths=True)
        assert [c for c in flat.columns if c.startswith("v__")] == [f"v__{i}" for i in range(head)] and "v._tail" in flat.columns
        assert sorted(map(tuple, unflatten(flat, plan, arrays="length").collect())) == rows
    wide = spark.range(3).selectExpr("id", "sequence(0L, 20000L) AS v")
    plan = infer_plan(wide, head=8)
    assert len(flatten(wide, plan, lengths=True).columns) == 11
    with pytest.raises(ValueError, match="head"):
        flatten(wide, infer_plan(wide))


def test_long_lists(spark, tmp_path):
    """Items far out are drawn by their place; lists within items and within structs have tails of their own."""
    rows = []
    for i in range(300):
        n = 700 if i == 77 else i % 12
        items = [{"at": p // 100, "tags": [f"t{p % 3}"] * (p % 9)} for p in range(n)]
        rows.append((i, items if i % 10 else None, {"codes": list(range(i % 30))}))
    df = spark.createDataFrame(rows, "id int, items array<struct<at:int,tags:array<string>>>, head struct<codes:array<int>>")
    maker = Synthesizer(list_columns=4, independent=True).fit(df, path=str(tmp_path))
    made = maker.sample(300, seed=4)
    assert made.schema.simpleString() == df.schema.simpleString()
    got = made.collect()
    lengths = collections.Counter(min(len(r["items"]), 13) for r in got if r["items"] is not None)
    assert set(lengths) >= set(range(4, 12)) and abs(sum(r["items"] is None for r in got) - 30) < 20
    for r in got:
        for place, item in enumerate(r["items"] or []):
            assert item.at <= 6 and set(item.tags) <= {"t0", "t1", "t2"} and len(item.tags) <= 8
            assert item.at == 0 or place >= 64  # the bands: 4 to 15, 16 to 63, 64 to 255, 256 to 1023
        assert all(place >= 4 or code == place for place, code in enumerate(r.head.codes))
    assert max(len(r.head.codes) for r in got) > 20
    again = Synthesizer.load(spark, str(tmp_path)).sample(300, seed=4).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    picked = maker.sample_rows(spark.createDataFrame([(7,), (250,)], "row long"), seed=4)
    assert sorted(str(r) for r in picked.drop(ROW).collect()) == sorted(str(got_row) for got_row in maker.sample_rows(spark.range(300).selectExpr("id AS row"), seed=4).filter(f"`{ROW}` IN (7, 250)").drop(ROW).collect())


def test_power_draws_of_large_rows(spark):
    """Items of long lists have numbers far beyond the prime; the draws do not overflow."""
    prime, rows = PowerDraws.PRIME, [1, 8_400_000_000, 18_000_000_000, 1_080_000_000_000]
    first = [pow((r * PowerDraws.ROW_FACTOR + 5) % prime, 5, prime) for r in rows]
    wanted = [(pow((x + 9 * PowerDraws.STREAM_FACTOR) % prime, 5, prime) + 0.5) / prime for x in first]
    table = spark.createDataFrame([(r,) for r in rows], "row long").coalesce(1)
    assert [r.u for r in table.selectExpr(f"{PowerDraws(5).uniform_sql('row', 9)} AS u").collect()] == wanted
