"""Answer checking (M8): the DataFrame questions against gold answers written as plain
Spark SQL over the published tables' shapes."""

from conftest import SF001

from qualityframe.operators.compare import check_answer
from qualityframe.plans import questions
from qualityframe.plans.catalog import _items, _metrics, _products, _scans, _t
from qualityframe.plans.jobs import with_product

GOLD = {
    "defect_rate_by_category": """
        SELECT product_category, COUNT(*) AS total_inspections,
               COUNT_IF(result = 'fail') AS failures,
               CAST(ROUND(CAST(100.0D * COUNT_IF(result = 'fail') / COUNT(*) AS DECIMAL(38,8)), 1) AS DOUBLE)
                 AS defect_rate_pct
        FROM inspection_events GROUP BY product_category""",
    "best_version": """
        SELECT model_version, CAST(ROUND(CAST(AVG(f1_score_pct) AS DECIMAL(38,8)), 1) AS DOUBLE) AS avg_f1
        FROM model_performance WHERE model_name = 'damage_detector' GROUP BY model_version""",
    "top_critical_items": """
        SELECT item_sku, product_name, COUNT(*) AS critical_defects
        FROM inspection_events WHERE severity = 'critical'
        GROUP BY item_sku, product_name ORDER BY critical_defects DESC, item_sku""",
}


def test_questions_match_gold_sql(spark):
    t = _t(spark, SF001)
    with_product(_items(t), t.part).createOrReplaceTempView("inspection_events")
    _metrics(t).createOrReplaceTempView("model_performance")
    answers = {
        "defect_rate_by_category": (questions.defect_rate_by_category(_items(t), _products(t)), ["product_category"]),
        "best_version": (questions.best_version(_metrics(t)), ["model_version"]),
        "top_critical_items": (questions.top_critical_items(_items(t), _products(t)), None),
    }
    for name, (actual, keys) in answers.items():
        report = check_answer(actual, spark.sql(GOLD[name]), keys)
        assert report["passed"], (name, report)


def test_check_answer_reports_differences(spark):
    t = _t(spark, SF001)
    good = questions.carrier_ranking(_scans(t))
    bad = good.limit(4)
    report = check_answer(bad, good, ["carrier_name"])
    assert not report["passed"] and report["only_right"] == 1 and report["schema_match"]
    wrong_schema = check_answer(good.drop("damage_rank"), good, ["carrier_name"])
    assert wrong_schema["missing_columns"] == ["damage_rank"] and not wrong_schema["passed"]
