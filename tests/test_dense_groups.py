"""Groups of pages whose fingerprints lie densely."""

from tests.test_linkage import dense, near
from tests.test_similarity import signed, union

from leafsieve.operators import similarity
from leafsieve.operators.groups import build_groups
from leafsieve.options import GroupingOptions
from leafsieve.plans.scan import PAGES
from leafsieve.sources.adapters import archives_of


def test_groups_are_built_without_pairs(spark, monkeypatch):
    monkeypatch.setattr(similarity, "_pairs", None)
    h = [int(x) for x in dense(9, 300)]
    pages = spark.createDataFrame([(f"b{k % 5}", f"p{k}.jpg", k // 5, 10, 5, 5, str(x), signed(x), False, None, None) for k, x in enumerate(h)], PAGES)
    made = build_groups(pages, archives_of(pages), GroupingOptions(threshold=6, min_pages=2, min_archives=1, skip_first_page=False))
    root = union(near(dense(9, 300), 6), h)
    sizes = {}
    for r in root.values():
        sizes[f"{r:016x}"] = sizes.get(f"{r:016x}", 0) + 1
    assert {r.gid: r.page_count for r in made.groups.collect()} == {gid: n for gid, n in sizes.items() if n > 1}
