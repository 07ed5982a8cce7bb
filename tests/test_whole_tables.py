from docspan.plans import catalogue
from docspan.plans import views as V


def test_merge_overlaps_covers_every_box(spark, sf_dir):
    merged = catalogue.queries()["merge_overlaps"](spark, sf_dir)
    assert sum(r.n for r in merged.collect()) == V.boxes(spark, sf_dir).count()


def test_alignment_uses_the_whole_benchmark(spark, sf_dir):
    for name in ("align_dp", "claims_pipeline"):
        assert any((r.question or 0) >= 10 for r in catalogue.queries()[name](spark, sf_dir).collect()), name
