"""Split sizes, membership properties and the rank primitive under skew."""

import pytest
from pyspark.sql import functions as F

from dhvani.operators import rank as R
from dhvani.operators.split import parallel_split, random_split, sample_n, stratified_split
from dhvani.plans.q_manifest import _combine_inputs
from dhvani.plans.combine_split import combine_filter_split


@pytest.mark.parametrize("n,expected", [(50, (0, 50, 0)), (150, (0, 100, 50)), (250, (50, 100, 100)),
                                        (2000, (1600, 200, 200))])
def test_parallel_split_sizes(spark, n, expected):
    df = spark.range(n).select(F.col("id").cast("string").alias("basename"))
    c = {r.split: r["count"] for r in parallel_split(df).groupBy("split").count().collect()}
    assert (c.get("train", 0), c.get("val", 0), c.get("test", 0)) == expected


def test_stratified_split_fixture_sizes(spark):
    out = combine_filter_split(_combine_inputs(spark, "/root/testdata/sf0.01"))
    c = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert c == {"train": 639, "val": 35, "test": 36}


def test_split_repeatable_and_partition_independent(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("wav_path"),
                                  (F.col("id") % 97 / 5.0 + 0.5).alias("duration_sec"))
    a = {r.wav_path: r.split for r in stratified_split(df).collect()}
    b = {r.wav_path: r.split for r in stratified_split(df.repartition(7).orderBy(F.rand(3))).collect()}
    assert a == b and len(a) == 3000
    r = random_split(df.drop("duration_sec"))
    c = {x.split: x["count"] for x in r.groupBy("split").count().collect()}
    assert c == {"train": 2700, "val": 150, "test": 150}


def test_rank_dense_under_hot_copies(spark, monkeypatch):
    monkeypatch.setattr(R, "CHUNK", 64)
    hot = spark.range(1000).select(F.lit("same").alias("k"))
    rest = spark.range(2000).select(F.col("id").cast("string").alias("k"))
    df = hot.unionByName(rest)
    ranked = R.seeded_rank(df, ["k"], prefix_len=2)
    ranks = sorted(r.rank for r in ranked.collect())
    assert ranks == list(range(1, 3001))
    hot_ranks = sorted(r.rank for r in ranked.filter(F.col("k") == "same").collect())
    assert hot_ranks == list(range(hot_ranks[0], hot_ranks[0] + 1000))


def test_rank_within_groups(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), F.col("id").cast("string").alias("k"))
    ranked = R.seeded_rank(df, ["k"], by=["g"], copies="unique")
    for g, cnt in ((0, 167), (1, 167), (2, 166)):
        assert sorted(r.rank for r in ranked.filter(F.col("g") == g).collect()) == list(range(1, cnt + 1))


def test_sample_n_paths_agree(spark, monkeypatch):
    df = spark.range(400).select(F.col("id").cast("string").alias("k"))
    small = {r.k for r in sample_n(df, 37, key_cols=["k"]).collect()}
    import dhvani.operators.split as SP
    monkeypatch.setattr(SP, "TOPK_LIMIT", 0)
    large = {r.k for r in SP.sample_n(df, 37, key_cols=["k"]).collect()}
    assert small == large and len(small) == 37


def test_rank_within_hot_group(spark, monkeypatch):
    monkeypatch.setattr(R, "CHUNK", 64)
    hot = spark.range(3000).select(F.lit("h").alias("g"), F.col("id").cast("string").alias("k"))
    copies = spark.range(500).select(F.lit("h").alias("g"), F.lit("same").alias("k"))
    other = spark.range(1000).select((F.col("id") % 10).cast("string").alias("g"), F.col("id").cast("string").alias("k"))
    ranked = R.rank_within(hot.unionByName(copies).unionByName(other), ["g"], ["k"], sub_len=1)
    got = sorted(r.rank for r in ranked.filter(F.col("g") == "h").collect())
    assert got == list(range(1, 3501))
    for g in ("0", "7"):
        assert sorted(r.rank for r in ranked.filter(F.col("g") == g).collect()) == list(range(1, 101))


def test_basename_join_pairs_duplicates_by_occurrence(spark):
    from dhvani.operators.align import basename_join
    hi = spark.createDataFrame([("a", "h1"), ("a", "h2"), ("a", "h3"), ("b", "hb"), (None, "hn")],
                               "basename string, hi_text string")
    en = spark.createDataFrame([("a", "e1"), ("a", "e2"), ("b", "eb"), ("c", "ec"), (None, "en")],
                               "basename string, en_text string")
    out = basename_join(hi, en).collect()
    assert sorted(r.basename for r in out) == ["a", "a", "b"]
    a_hi = [r.hi_text for r in out if r.basename == "a"]
    a_en = [r.en_text for r in out if r.basename == "a"]
    assert len(set(a_hi)) == 2 and sorted(a_en) == ["e1", "e2"]


def test_exact_quantiles_match_numpy(spark):
    import numpy as np
    from dhvani.operators.quantile import exact_quantiles
    rng = np.random.default_rng(5)
    vals = np.concatenate([rng.normal(5, 2, 3000), np.full(1500, 3.25), rng.uniform(0, 1e6, 10)])
    df = spark.createDataFrame([(float(x), int(i % 3)) for i, x in enumerate(vals)], "v double, g int")
    qs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = exact_quantiles(df, "v", qs).first().quantiles
    assert got == pytest.approx(list(np.quantile(vals, qs)), rel=1e-12, abs=1e-9)
    by = {r.g: r.quantiles for r in exact_quantiles(df, "v", [0.5], by=["g"]).collect()}
    for g in range(3):
        assert by[g][0] == pytest.approx(float(np.quantile(vals[g::3], 0.5)), rel=1e-12)


def test_edges_are_percentiles(spark):
    from dhvani.operators.split import QUANTILES, duration_edges
    df = spark.range(5000).select(((F.col("id") * 7919) % 20011 / 1000.0).alias("duration_sec"))
    want = df.select(F.array_distinct(F.percentile(F.greatest("duration_sec", F.lit(0.5)), F.array(*[F.lit(q) for q in QUANTILES])))).first()[0]
    assert duration_edges(df).first().edges == pytest.approx(want, rel=1e-12)


def test_quantiles_of_any_distribution(spark):
    """An outlier, a crowded range, both signs, zeros, infinity, ties, nulls and NaN; groups with a null key."""
    import numpy as np

    from dhvani.operators.quantile import exact_quantiles
    r = np.random.default_rng(3)
    groups = {"outlier": [*r.normal(size=300), 1e300], "crowd": [*(1 + 1e-13 * r.integers(0, 50, 400)), 5e-324, -1e9], "ties": [2.5] * 90 + [-0.0, 0.0] * 7,
              "inf": [float("inf"), 1.0, 2.0, 3.0], "one": [7.25], None: [*r.exponential(size=99)]}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("ties", None), ("one", float("nan")), ("empty", None)]
    qs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    got = {x.g: x.quantiles for x in exact_quantiles(spark.createDataFrame(rows, "g string, v double").repartition(5), "v", qs, by=["g"]).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        if g != "inf":
            assert got[g] == pytest.approx(list(np.quantile(vs, qs)), rel=1e-12, abs=1e-15), g
    assert got["inf"][0] == 1.0 and got["inf"][-1] == float("inf")


def test_quantiles_windows_stay_small(spark):
    """A million different values: no window sees more than the 65,536 buckets of a prefix."""
    import numpy as np

    from dhvani.operators import quantile as Q
    df = spark.range(1_000_000).select((F.sin("id") * F.exp(F.col("id") % 40)).alias("v"))
    got = Q.exact_quantiles(df, "v", [0.01, 0.5, 0.99]).first().quantiles
    i = np.arange(1_000_000)
    assert got == pytest.approx(list(np.quantile(np.sin(i) * np.exp(i % 40), [0.01, 0.5, 0.99])), rel=1e-9)
    keys = df.select(Q.order_key("v").alias("k"))
    buckets = keys.groupBy(F.shiftright("k", 32).alias("b")).count().groupBy(F.shiftright("b", 16).alias("p")).count()
    assert buckets.agg(F.max("count")).first()[0] <= 65_536 and buckets.count() <= 65_536


def test_pairs_and_rest_lose_no_row(spark):
    from dhvani.operators.align import basename_pairs
    hi = spark.createDataFrame([("a", "h1"), ("a", "h2"), ("a", "h2"), ("b", "hb"), ("d", "hd"), (None, "hn")], "basename string, hi_text string")
    en = spark.createDataFrame([("a", "e1"), ("b", "eb"), ("b", "eb2"), ("c", "ec"), (None, "en")], "basename string, en_text string")
    pairs, rest = basename_pairs(hi, en)
    p, r = pairs.collect(), rest.collect()
    assert sorted([x.hi_text for x in p] + [x.text for x in r if x.side == "hi"]) == ["h1", "h2", "h2", "hb"]
    assert sorted([x.en_text for x in p] + [x.text for x in r if x.side == "en"]) == ["e1", "eb", "eb2"]


def test_cutoff_labels_equal_rank_labels(spark):
    import dhvani.operators.split as SP
    df = spark.range(4000).select(F.concat(F.lit("/c/"), F.col("id").cast("string")).alias("wav_path"),
                                  (F.lit(0.5) + (F.col("id") * 37 % 1900) / 100.0).alias("duration_sec"))
    a = {r.wav_path: r.split for r in SP.stratified_split(df, unique_key=True).collect()}
    b = {r.wav_path: r.split for r in SP.stratified_split(df, unique_key=False).collect()}
    assert a == b
    slim = df.select("wav_path")
    a = {r.wav_path: r.split for r in SP.random_split(slim, unique_key=True).collect()}
    b = {r.wav_path: r.split for r in SP.random_split(slim, unique_key=False).collect()}
    assert a == b


def test_prefix_sums_with_hashed_row_ids(spark):
    from dhvani.operators.prefix import prefix_sums
    df = spark.range(2000).select(F.xxhash64("id").alias("k"), (F.col("id") % 7).alias("n"), F.lit("text").alias("t"))
    rows = sorted(df.collect(), key=lambda r: r.k)
    total, want = 0, {}
    for r in rows:
        want[r.k] = total
        total += r.n
    out = prefix_sums(df, "k", ["n"], ["before"])
    assert {r.k: r.before for r in out.collect()} == want
    assert out.columns == ["k", "n", "t", "before"]
