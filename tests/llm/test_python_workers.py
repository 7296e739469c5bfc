"""Python steps of the pipeline: a task holds one Python worker, however small the tables that are joined between two steps."""

import corpus_pipeline
import pytest

PYTHON = ("MapInArrow", "ArrowEvalPython", "BatchEvalPython")


def _python_steps(plan, here=0):
    """The most Python steps in a stage of a plan."""
    if plan.nodeName().startswith("AdaptiveSparkPlan"):
        return _python_steps(plan.executedPlan(), here)
    here = 0 if plan.nodeName().endswith("Exchange") else here + (plan.nodeName() in PYTHON)
    kids = plan.children()
    return max([here, *(_python_steps(kids.apply(i), here) for i in range(kids.size()))])


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_one_python_worker_in_a_task(spark, make_docs, corpus, tmp_path, monkeypatch, name):
    spark.createDataFrame([(i, int("ugly" in (t or "")), 1) for i, t in corpus], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("a", corpus[70][1])], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame, most = type(spark.range(1)), []

    def told(self, *a, f=frame.mapInArrow, **k):
        out = f(self, *a, **k)
        most.append(_python_steps(out._jdf.queryExecution().executedPlan()))
        return out

    monkeypatch.setattr(frame, "mapInArrow", told)
    docs = make_docs([(i, f"{t} ugly words" if i % 2 else t) for i, t in corpus])
    result = dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path))
    assert max([*most, _python_steps(result._jdf.queryExecution().executedPlan())]) <= 1
