"""Ranks, kinds, marginals and the fidelity of samples."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from facsimile import Model, Synthesizer, detect_kinds, fit, sample, synthesize
from facsimile.functions.draws import PowerDraws
from facsimile.functions.text import fill_shape_sql
from facsimile.functions import normal
from facsimile.operators import model as M
from facsimile.operators.lookup import SALT, fits_broadcast, hot_keys, lookup_join
from facsimile.operators.ranks import running_totals
from facsimile.operators import sample as S
from facsimile.operators.sample import sample_rows
from facsimile.session import settle
from workloads import sampling
from workloads.common import order_nested, read


def test_normal_functions(spark):
    xs = [-9.0, -7.2, -3.1, -0.4, 0.0, 1.7, 5.5]
    us = [1e-12, 1e-4, 0.03, 0.5, 0.77, 0.9999]
    dist = statistics.NormalDist()
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(normal.normal_cdf("x")).collect()]
    assert got == pytest.approx([0.5 * math.erfc(-x / math.sqrt(2)) for x in xs], abs=1e-15)
    assert normal.cdf_array(np.array(xs)) == pytest.approx(got, abs=1e-12)
    got = [r[0] for r in spark.createDataFrame([(u,) for u in us], "u double").select(normal.normal_quantile("u")).collect()]
    assert got == pytest.approx([dist.inv_cdf(u) for u in us], abs=1e-12)


@pytest.mark.parametrize("slot_rows", [10**9, 40, 7])
def test_running_totals(spark, slot_rows):
    data = [("ab"[i % 2], f"v{i * 7919 % 1000:03d}'\\", i % 5 + 1) for i in range(300)]
    got = running_totals(spark.createDataFrame(data, "g string, v string, w int"), ["g"], ["v"], "w", slot_rows=slot_rows)
    want, total = set(), {}
    for g, v, w in sorted(data):
        total[g] = total.get(g, 0) + w
        want.add((g, v, w, total[g], total[g] - w))
    assert {tuple(r) for r in got.select("g", "v", "w", "hi", "lo").collect()} == want


def test_lookup_join_salted(spark, monkeypatch):
    facts = spark.createDataFrame([(i, 1 if i % 3 else i) for i in range(300)], "id int, k int")
    table = spark.createDataFrame([(k, f"n{k}") for k in range(150)], "k int, name string")
    assert fits_broadcast(table) and not fits_broadcast(table, rows=100) and not fits_broadcast(table, size=10)
    plain = lookup_join(facts, table, "k", ["id"])
    monkeypatch.setattr("facsimile.operators.lookup.fits_broadcast", lambda t: False)
    monkeypatch.setattr("facsimile.operators.lookup.HOT_ROWS", 50)
    assert [r.k for r in hot_keys(facts, "k").collect()] == [1]
    salted = lookup_join(facts, table, "k", ["id"])
    assert SALT > 1
    text = salted._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN hot" in text or "if (hot" in text  # other keys are neither copied nor salted
    assert sorted(map(tuple, plain.select("id", "k", "name").collect()), key=str) == sorted(
        map(tuple, salted.select("id", "k", "name").collect()), key=str
    )


def test_kind_rules(spark):
    data = [
        (i, float(i % 7), i % 2 == 0, f"key{i:04d}", f"some words {i}", "abc"[i % 3], None, "2024-01-01", 5 - i % 2)
        for i in range(200)
    ]
    df = spark.createDataFrame(
        data, "row_id bigint, x double, flag boolean, code string, note string, cat string, nothing string, day string, n_key int"
    ).withColumn("day", F.col("day").cast("date")).withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    for exact in (True, False):
        kinds = {r["column"]: r["kind"] for r in detect_kinds(df, exact=exact).collect()}
        assert kinds == {
            "row_id": "id", "x": "numeric", "flag": "boolean", "code": "id", "note": "text", "cat": "categorical",
            "nothing": "carried", "day": "datetime", "n_key": "numeric", "m": "carried",
        }
    assert {r["column"]: r["kind"] for r in detect_kinds(df, {"x": "carried"}).collect()}["x"] == "carried"
    with pytest.raises(ValueError):
        detect_kinds(df, {"x": "strange"})


def test_sketched_grid_is_close(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem")
    views = {"l_extendedprice": "l_extendedprice"}
    close = M.quantile_grid(df, views, 101).first()["knots"]
    exact = M.quantile_grid(df, views, 101, exact=True).first()["knots"]
    assert len(close) == len(exact) == 101
    spread = exact[-1] - exact[0]
    assert max(abs(a - b) for a, b in zip(close, exact)) < 0.002 * spread


def test_correlation_agrees(spark):
    rng = np.random.default_rng(3)
    z = rng.normal(size=(500, 6)) @ rng.normal(size=(6, 6))
    data = [[float(v) if (i + j) % 7 else None for j, v in enumerate(r)] for i, r in enumerate(z)]
    df = spark.createDataFrame(data, ", ".join(f"z{i} double" for i in range(6))).repartition(5)
    plain = df.agg(*[F.corr(f"z{i}", f"z{j}").alias(f"r{i}_{j}") for i in range(6) for j in range(i)]).first()
    names = [f"z{i}" for i in range(6)]
    found = M.correlation(df, names)
    assert len(found) == 15
    for (a, b), r in found.items():
        assert r == pytest.approx(plain[f"r{a[1]}_{b[1]}"], abs=1e-12)


def test_wide_correlation_by_blocks(spark, monkeypatch, tmp_path):
    """Pairs of column blocks: the same correlations, and no task holds more than a pair."""
    names = [f"c{i}" for i in range(11)]
    df = spark.range(400).select(*[F.when(F.col("id") % (i + 2) != 0, F.sin(F.col("id") * (i // 3 + 1)) + F.rand(i)).alias(f"z{i}") for i in range(11)])
    df = M.settle(df, "wide")
    whole = M.correlation(df, names)
    monkeypatch.setattr(M, "SUM_COLUMNS", 4)
    monkeypatch.setattr(M, "SUM_ROWS", 3)
    parts = M.correlation(df, names)
    assert len(parts) == len(whole) == 55 and all(parts[k] == pytest.approx(r, abs=1e-12) for k, r in whole.items())
    sizes = {len(r["sums"]) for r in M.pair_sums(df, 11).collect()}
    assert max(sizes) == 6 * 3 * 4 * 8
    parts.table(spark).write.parquet(str(tmp_path / "r"))
    again = M.Correlation.of_table(spark.read.parquet(str(tmp_path / "r")))
    assert dict(again) == dict(parts) and again.names == names
    assert np.allclose(M.cholesky(names, parts), M.cholesky(names, dict(parts)))
    assert M.cholesky(["c3", "new", "c1"], parts)[2, 0] == pytest.approx(parts["c3", "c1"])


def test_pairs_without_a_correlation(spark):
    """Constant where the other is set, never set together, one row, no rows: no entry and no error."""
    rows = [(1.0, 5.0, None, 1.0), (2.0, 5.0, None, None), (3.0, 5.0, 1.0, None), (None, 7.0, 2.0, None)]
    df = spark.createDataFrame(rows, "z0 double, z1 double, z2 double, z3 double")
    assert set(M.correlation(df, ["a", "b", "c", "d"])) == {("c", "b")}
    assert M.correlation(df.limit(0), ["a", "b", "c", "d"]) == {}


def test_nullable_struct_beside_a_number(spark):
    from facsimile import synthesize

    rows = [(float(i), None if i % 3 == 0 else (i % 7,), None if i % 4 == 0 else [i % 5]) for i in range(300)]
    df = spark.createDataFrame(rows, "x double, s struct<a:int>, v array<int>")
    for marginal in ("ecdf", "norm"):
        made = synthesize(df, 200, seed=3, marginal=marginal)
        assert made.schema.simpleString() == df.schema.simpleString()
        assert 30 < made.filter("s IS NULL").count() < 110


@pytest.mark.parametrize("marginal", ["ecdf", "norm"])
def test_infinities_keep_their_shares(spark, marginal):
    inf = float("inf")
    rows = [(inf if i % 10 == 0 else -inf if i % 10 == 1 else None if i % 10 == 2 else float(i % 50), float(i % 17), inf) for i in range(2000)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = M.fit(df, marginal=marginal)
    made = S.sample(got, 4000, seed=2)
    shares = made.agg(
        F.avg((F.col("a") == inf).cast("int")), F.avg((F.col("a") == -inf).cast("int")), F.avg(F.col("a").isNull().cast("int")),
        F.max(F.when(F.abs("a") < inf, F.col("a"))), F.min("c"),
    ).first()
    assert [round(x, 1) for x in shares[:2]] == [0.1, 0.1] and 0.07 < shares[2] < 0.13
    assert shares[3] <= 49.0 and shares[4] == inf


def test_shapes_of_text_ids(spark):
    shapes = [f"aa-{i:02d}" for i in range(0, 50)] + [f"{i}/A" for i in range(10)] + [f"{i:02d}/A" for i in range(10, 50)]
    df = spark.createDataFrame([(s.replace("/A", "/" + "BCDEFGHIJK"[n % 10]) + str(n),) for n, s in enumerate(shapes)], "code string")
    got = M.fit(df, overrides={"code": "id"})
    made = S.sample(got, 400, seed=1).select("code")
    assert made.distinct().count() == 400
    assert made.filter("code LIKE 'a%' OR code RLIKE '^[a-z]{2}-'").count() not in (0, 400)


def test_buckets_hold_about_as_many_entries(spark):
    """One value in most rows and a long tail of single ones: no bucket grows."""
    rows = [("hot",)] * 60_000 + [(f"v{i}",) for i in range(20_000)] + [(f"w{i % 500}",) for i in range(5000)]
    df = spark.createDataFrame(rows, "c string")
    got = M.fit(df, overrides={"c": "categorical"})
    spec = got.columns[0]
    mine = got.categories.select("lo", "hi")
    starts, widths = S._buckets(mine, spec["entries"])
    segment, bucket = S._bucket_sql("lo", starts, widths)
    sizes = mine.selectExpr(f"{segment} AS s", f"{bucket} AS b").groupBy("s", "b").count().agg(F.max("count")).first()[0]
    assert sizes <= 2 * S.BUCKET_ROWS
    made = S.sample(got, 4000, seed=1)
    assert made.filter("c IS NULL").count() == 0 and 0.66 < made.filter("c = 'hot'").count() / 4000 < 0.75
    assert made.filter("c LIKE 'v%'").distinct().count() > 700


def test_every_word_length(spark, monkeypatch):
    """Over a thousand different word lengths: each has its own interval, and the words are those of the literal."""
    texts = [(" ".join("x" * (3 * i + k + 1) for k in range(3)) + " tail of words",) for i in range(500)]
    got = M.fit(spark.createDataFrame(texts, "t string"), overrides={"t": "text"})
    spec = got.columns[0]
    assert spec["entries"] >= 1500 and not got.literals
    made = [r.t for r in S.sample(got, 20, seed=1).collect()]
    known = {int(r.value) for r in got.categories.collect()}
    assert len(made) == 20 and {len(w) for t in made for w in t.split(" ")} <= known
    monkeypatch.setattr(M, "LITERAL_LIMIT", 10_000)
    got.literals = M.literal_entries(got.categories, got.columns)
    assert sorted(r.t for r in S.sample(got, 20, seed=1).collect()) == sorted(made)


def test_cholesky_repairs():
    names = ["a", "b", "c"]
    pairs = {("b", "a"): 0.99, ("c", "a"): 0.99, ("c", "b"): -0.99}
    factor = M.cholesky(names, pairs)
    assert np.allclose(np.diag(factor @ factor.T), 1.0, atol=1e-6)


@pytest.fixture(scope="module")
def lines(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_quantity", "l_extendedprice", "l_tax", "l_returnflag", "l_shipdate",
        F.when(F.col("l_linenumber") > 2, F.col("l_discount")).alias("gap"),
        (F.col("l_quantity") * 3 + F.col("l_tax") * 100).alias("linked"),
        F.when(F.col("l_quantity") > 25, "big").otherwise("small").alias("size"),
    )
    return df.cache()


def ks_distance(a, b):
    a, b = np.sort(a), np.sort(b)
    grid = np.concatenate([a, b])
    return np.max(np.abs(np.searchsorted(a, grid, "right") / len(a) - np.searchsorted(b, grid, "right") / len(b)))


def test_sample_fidelity(spark, lines):
    out = sample(fit(lines), 20_000, seed=5)
    assert out.schema.simpleString() == lines.schema.simpleString()
    real, fake = lines.toPandas(), out.toPandas()
    for c in ("l_quantity", "l_extendedprice", "l_tax", "linked"):
        assert ks_distance(real[c], fake[c]) < 0.02
        assert fake[c].min() >= real[c].min() and fake[c].max() <= real[c].max()
    assert ks_distance(real["l_shipdate"].astype("int64"), fake["l_shipdate"].astype("int64")) < 0.02
    assert abs(real["gap"].isna().mean() - fake["gap"].isna().mean()) < 0.02
    for c in ("l_returnflag", "size"):
        assert (real[c].value_counts(normalize=True) - fake[c].value_counts(normalize=True)).abs().max() < 0.02
    assert abs(real["linked"].corr(real["l_quantity"]) - fake["linked"].corr(fake["l_quantity"])) < 0.05
    assert fake.groupby("size")["l_quantity"].mean()["big"] > fake.groupby("size")["l_quantity"].mean()["small"] + 10


def test_normal_marginal(spark, lines):
    out = sample(fit(lines.select("l_extendedprice", "linked"), marginal="norm"), 20_000).toPandas()
    real = lines.select("l_extendedprice", "linked").toPandas()
    assert out["linked"].mean() == pytest.approx(real["linked"].mean(), rel=0.05)
    assert out["linked"].max() <= real["linked"].max()


def test_sample_does_not_depend_on_partitions(spark, lines):
    model = fit(lines)
    base = spark.range(0, 500).select(F.col("id").alias("row"))
    one = sample_rows(model, base.coalesce(1), seed=9, keep_row=True)
    many = sample_rows(model, base.repartition(7), seed=9, keep_row=True)
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))
    other = sample_rows(model, base, seed=10, keep_row=True)
    assert sorted(map(str, one.collect())) != sorted(map(str, other.collect()))


def test_many_categories_in_copula(spark):
    """More categories than fit a literal take part in the dependence through a join."""
    n = 6000
    df = spark.range(n).select(
        F.format_string("c%04d", (F.col("id") * F.col("id") / n / 4).cast("int")).alias("cat"), (F.col("id") * 1.0).alias("x")
    )
    model = fit(df, overrides={"cat": "categorical", "x": "numeric"})
    spec = model.columns[0]
    assert spec["entries"] > 1000 and "cat" not in model.literals
    assert abs(model.correlation[("x", "cat")]) > 0.5
    out = sample(model, 3000)
    assert out.count() == 3000 and out.where("cat is null").count() == 0
    assert out.join(df.select("cat").distinct(), "cat", "left_anti").count() == 0


def test_ids_and_texts(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    model = fit(docs.withColumn("code", F.concat(F.lit("Doc-"), F.format_string("%06d", "doc_id"))))
    assert {s["column"]: s["kind"] for s in model.columns}["code"] == "id"
    out = sample(model, 400, seed=1)
    assert out.select("code").distinct().count() == 400 and out.select("doc_id").distinct().count() == 400
    assert out.where(~F.col("code").rlike(r"^[A-Z][a-z]{2}-\d{6}$")).count() == 0
    assert out.join(docs, "text", "left_semi").count() == 0
    real, fake = (d.agg(F.avg(F.size(F.split("text", r"\s+")))).first()[0] for d in (docs, out))
    assert fake == pytest.approx(real, rel=0.35)


def test_save_and_load(spark, lines, tmp_path):
    path = str(tmp_path / "model")
    model = fit(lines, path=path)
    again = Model.load(spark, path)
    a, b = sample(model, 200, seed=2), sample(again, 200, seed=2)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_stored_synthesizer(spark, sf_dir, tmp_path):
    df = order_nested(spark, sf_dir).select("o_orderkey", "items")
    maker = Synthesizer(independent=True).fit(df, path=str(tmp_path / "m"))
    again = Synthesizer.load(spark, str(tmp_path / "m"))
    assert sorted(map(str, maker.sample(100, seed=4).collect())) == sorted(map(str, again.sample(100, seed=4).collect()))


def test_nested_end_to_end(spark, sf_dir):
    df = order_nested(spark, sf_dir)
    out = synthesize(df, 2000, seed=3)
    assert out.schema.simpleString() == df.schema.simpleString() and out.count() == 2000
    shares = [
        d.agg(F.avg(F.col("items").isNull().cast("int")), F.avg(F.size("items")), F.max(F.size("items")),
              F.avg(F.size("head.tags"))).first()
        for d in (df, out)
    ]
    assert shares[1][0] == pytest.approx(shares[0][0], abs=0.03)
    assert shares[1][1] == pytest.approx(shares[0][1], rel=0.1)
    assert shares[1][2] <= shares[0][2]
    assert shares[1][3] == pytest.approx(shares[0][3], rel=0.1)


def test_guards(spark, lines):
    maker = Synthesizer()
    with pytest.raises(RuntimeError):
        maker.model
    with pytest.raises(RuntimeError):
        maker.plan
    with pytest.raises(RuntimeError):
        maker.sample(5)
    with pytest.raises(RuntimeError):
        sample(None, 5)
    with pytest.raises(ValueError):
        sample(fit(lines.select("l_tax"), independent=True), 0)
    with pytest.raises(ValueError):
        synthesize(lines, -1)
    with pytest.raises(ValueError, match="no rows"):
        fit(lines.limit(0))
    with pytest.raises(ValueError):
        fit(lines, marginal="beta")


def test_constant_and_empty_columns(spark):
    df = spark.range(50).select(
        F.lit(3.5).alias("same"), F.lit(None).cast("double").alias("none"), F.lit("x").alias("one"),
        F.when(F.col("id") % 2 == 0, float("nan")).otherwise(F.col("id") * 1.0).alias("nans"), (F.col("id") * 2).alias("v"),
    )
    out = synthesize(df, 300).toPandas()
    assert (out["same"] == 3.5).all() and out["none"].isna().all() and (out["one"] == "x").all()
    assert 0.35 < out["nans"].isna().mean() < 0.65


def test_null_patterns(spark, tmp_path):
    """Twenty columns in two blocks; those of equal shares are null together, and infinities are no nulls."""
    rows = spark.range(4000)
    pairs = [F.when(F.col("id") % (i // 2 + 3) != 0, F.col("id") % 10).alias(f"c{i}") for i in range(20)]
    odd = F.when(F.col("id") % 3 != 0, F.when(F.col("id") % 2 == 0, float("inf")).otherwise(1.5)).alias("odd")
    model = fit(rows.select(*pairs, odd), independent=True, path=str(tmp_path))
    assert [len(p["members"]) for p in model.patterns] == [16, 5]
    got = sample(model, 4000, seed=2)
    together = got.agg(*[F.count_if(F.col(f"c{i}").isNull() != F.col(f"c{i + 1}").isNull()).alias(f"d{i}") for i in range(0, 20, 2)]).first()
    assert all(n == 0 for n in together)
    shares = got.agg(*[F.avg(F.col(f"c{i}").isNull().cast("int")) for i in range(20)], F.avg(F.col("odd").isNull().cast("int"))).first()
    assert all(abs(s - 1 / (i // 2 + 3)) < 0.04 for i, s in enumerate(shares[:20])) and abs(shares[20] - 1 / 3) < 0.04
    assert sorted(map(str, sample(Model.load(spark, str(tmp_path)), 4000, seed=2).collect())) == sorted(map(str, got.collect()))
    alone = sample(fit(rows.select(*pairs[:2]), independent=True, missing="independent"), 4000, seed=2)
    assert alone.filter("(c0 IS NULL) <> (c1 IS NULL)").count() > 1000


def test_many_null_patterns(spark, monkeypatch):
    """More patterns than a literal holds: drawn by the interval join."""
    rows = spark.range(3000).select(*[F.when(F.xxhash64("id", F.lit(i)) % 2 == 0, F.lit(i)).alias(f"c{i}") for i in range(12)])
    model = fit(rows, independent=True)
    assert model.patterns[0]["entries"] > 1000 and not model.literals.get("._nulls0")
    seen = {tuple(v is None for v in r) for r in rows.collect()}
    got = sample(model, 2000, seed=1).collect()
    assert len(got) == 2000 and {tuple(v is None for v in r) for r in got} <= seen


def test_interval_join_searches_once_per_row(spark):
    """No filter for nulls below the join repeats the search with the draw inlined in each of its steps."""
    model = fit(spark.range(3000).selectExpr("concat('P', id % 1500) AS part"), exact=True, overrides={"part": "categorical"})
    joined = S.sample(model, 50, seed=3, rng="power")
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert "aggregate(" in plan and not [f for f in filters if "aggregate(" in f or "2147483647" in f]
    assert joined.count() == 50


def test_draws_of_places_share_the_part_of_their_row(spark):
    """The words, bytes and letters of a row do not each make the row's part of their draws again."""
    texts = [(" ".join("x" * (k % 9 + 1) for k in range(20 + i)),) for i in range(30)]
    model = fit(spark.createDataFrame(texts, "t string"), exact=True, overrides={"t": "text"})
    draws = PowerDraws(3)
    made = S._invented_text_sql(model.columns[0], model, model.literals["t"], draws)
    for sql in (made, fill_shape_sql("shape", "row", draws, 2)):
        assert str(PowerDraws.ROW_FACTOR) in sql and str(PowerDraws.ROW_FACTOR) not in sql[sql.index("key -> ") :]


def test_facts_are_told_of_one_drawing(spark, sf_dir, monkeypatch):
    """The synthetic orders are drawn and stored once, not once for each fact."""
    stored = []
    monkeypatch.setattr(sampling, "settle", lambda df, purpose: stored.append(purpose) or settle(df, purpose))
    assert all(r.holds for r in sampling.synthesize_facts(spark, sf_dir).collect()) and stored == ["made"]
