"""One-account forms, selections and edge cases of the serving and dashboard frames."""

import pytest
from pyspark.sql import functions as F

from tidemark.plans import dashboard, serving
from tidemark.plans.snapshots import clients_clean
from tidemark.sources.panel import AS_OF, panel


@pytest.fixture(scope="module")
def clean(spark):
    return clients_clean(panel(spark, "/root/testdata/sf0.001"))


@pytest.mark.parametrize("load", [
    serving.load_monthly_usage, serving.load_health_scores, serving.load_latest_health_summary,
    lambda c, team=None: serving.load_risk_flag(c, AS_OF, team)])
def test_one_account(clean, load):
    everyone = load(clean).where("team_id = 5").collect()
    assert everyone and load(clean, 5).collect() == everyone
    assert load(clean, -1).count() == 0


def test_usage_is_in_order_of_time(clean):
    months = [r["snapshot_month"] for r in serving.load_monthly_usage(clean, 5).collect()]
    assert months == sorted(months) and len(months) > 50
    dated = dashboard.prepare_time_series(serving.load_monthly_usage(clean, 5)
                                          .drop("team_id")).collect()
    assert [r["snapshot_month"].isoformat() for r in dated] == months


def test_selections(clean):
    companies = serving.load_companies(clean)
    assert dashboard.keep_selected(companies, {"region": []}).count() == 0
    assert dashboard.keep_selected(companies, {}).count() == companies.count()
    one = companies.first()
    found = dashboard.client_lookup(companies, one["company_name"]).first()
    assert found["team_id"] == one["team_id"]


def test_latest_month_of_one_account(clean):
    usage = serving.load_monthly_usage(clean)
    assert dashboard.latest_month(usage, team_id=1).first()[0] == "2001-10-01"
    assert dashboard.latest_month(usage, team_id=-1).first()[0] is None


def test_counts_of_nothing(clean):
    nobody = serving.load_companies(clean).where("team_id < 0")
    assert dashboard.growth_opportunity_pct(nobody).first()[0] is None
    assert dashboard.onboarding_count(nobody).first()[0] == 0


@pytest.mark.parametrize("above,of,expected", [
    (43, 2000, 2.1), (3, 2000, 0.1), (7, 80, 8.8), (41, 400, 10.2), (0, 3, 0.0), (3, 3, 100.0)])
def test_growth_share_rounds_the_stored_value(spark, above, of, expected):
    assert expected == round(above / of * 100, 1)
    rows = spark.range(of).selectExpr(f"if(id < {above}, 71, 70) as overall_health_score")
    assert dashboard.growth_opportunity_pct(rows).first()[0] == expected


def in_order(rows, *keys, nulls_first=True):
    """Values of the keys come in order, with nulls at one end."""
    found = [tuple(((r[k] is None) != nulls_first, r[k] if r[k] is not None else 0) for k in keys) for r in rows]
    return len(found) > 1 and found == sorted(found)


@pytest.fixture(scope="module")
def uneven(spark, clean):
    """The clean rows with ties and names and sizes that are missing."""
    from pyspark.sql import functions as F
    name = F.when(F.col("team_id") % 4 > 0, F.concat(F.lit("n"), (F.col("team_id") % 3).cast("string")))
    return clean.withColumns({"company_name": name, "active_users": F.when(F.col("team_id") % 5 > 0, F.col("active_users"))})


def test_orders(uneven):
    from tidemark.plans.accounts import at_risk_next_actions
    from tidemark.plans.trends import clicks_per_user_trend
    actions = at_risk_next_actions(uneven, AS_OF)
    assert in_order(actions.collect(), "overall_health_score", "company_size")
    assert in_order(clicks_per_user_trend(uneven).collect(), "company_name", "snapshot_month")
    assert in_order(serving.load_companies(uneven).collect(), "company_name")
    review = serving.load_clients_to_review(uneven, AS_OF)
    assert in_order(review.collect(), "overall_health_score", "company_size")
    assert in_order(dashboard.review_table(review).collect(), "overall_health_score", nulls_first=False)
    assert in_order(dashboard.at_risk_sorted(review).collect(), "overall_health_score", "company_size", nulls_first=False)
    one = dashboard.prepare_time_series(serving.load_monthly_usage(uneven).drop("team_id"))
    assert in_order(one.collect(), "snapshot_month")


def test_sorts_split_equal_scores(spark):
    """A million accounts of score 100 have distinct last keys, so no range of a sort takes them all."""
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(20_000).selectExpr(
            "concat('company ', id % 9000) as company_name", "if(id % 50 = 0, 40, 100) as overall_health_score", "'medium' as company_size",
            "cast(null as string) as salesperson", "cast(id as double) as monthly_fee")
        for frame in (dashboard.at_risk_sorted(rows), dashboard._in_order(rows, "overall_health_score")):
            sizes = [r["count"] for r in frame.groupBy(F.spark_partition_id()).count().collect()]
            assert len(sizes) == 8 and max(sizes) < 2 * sum(sizes) / 8
            scores = [r["overall_health_score"] for r in frame.collect()]
            assert scores == sorted(scores)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
