"""qualityframe: quality-control analytics as Spark DataFrame plans.

Layout
------
sources/    reading the input tables, inline dimensions, publishing tables
functions/  Column-level building blocks (measures, hashing, rules, text)
operators/  DataFrame -> DataFrame operators (sampling, spines, ids, ranking, compare)
plans/      the three table jobs, the metric registry, the question set, deploy/teardown
streaming/  the row-local operators on a stream (daily trend with a watermark)

Typical use::

    from qualityframe import Tables, deploy, jobs, questions
    t = Tables(spark, "/data/tpch")
    items = jobs.item_facts(t.lineitem)
    questions.defect_rate_by_category(items, jobs.product_dim(t.part)).show()
    deploy(spark, t, schema="qc_tables")
"""

from qualityframe.plans import jobs, questions
from qualityframe.plans.deploy import deploy, teardown
from qualityframe.plans.registry import REGISTRY, evaluate
from qualityframe.session import checkpoint_dir, get_session
from qualityframe.sources.tables import Tables

__all__ = [
    "REGISTRY",
    "Tables",
    "checkpoint_dir",
    "deploy",
    "evaluate",
    "get_session",
    "jobs",
    "questions",
    "teardown",
]
__version__ = "0.1.0"
