"""Rollups of links: no string is a key of the links' own aggregates, and repeated rows count once."""

import shutil

import pytest

from covara import registry
from covara.plans import cases, course
from covara.sources import views as v

from .oracle import connect, differences

NAMES = ["map_nested", "lens_top_topics", "lens_distribution", "scope_distribution", "learning_spiral", "most_covered"]


@pytest.mark.parametrize("name", NAMES)
def test_links_are_made_distinct_before_they_are_spread(spark, sf, monkeypatch, name):
    asked, made = [], v.distinct_facts
    monkeypatch.setattr(v, "distinct_facts", lambda s, d, *keys, **more: asked.append(keys) or made(s, d, *keys, **more))
    plan = registry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert asked and "explode(array(all" not in plan.split("document_id")[-1]
    assert not {"framework", "guide_kind", "module"} & {k for keys in asked for k in keys}


def test_repeated_rows_count_once(spark, sf, tmp_path):
    for t in ("lineitem", "orders", "part", "nation", "region", "customer"):
        df = spark.read.parquet(f"{sf}/{t}.parquet")
        if t in ("lineitem", "orders"):
            df.unionByName(df.filter(f"{df.columns[0]} % 3 = 0")).write.parquet(str(tmp_path / f"{t}.parquet"))
        else:
            shutil.copy(f"{sf}/{t}.parquet", tmp_path)
    for f in (course.scope_distribution, course.most_covered, cases.lens_distribution, cases.lens_top_topics):
        assert {tuple(r) for r in f(spark, str(tmp_path)).collect()} == {tuple(r) for r in f(spark, sf).collect()}
