import glob
import os
import random

from annotara.operators import hierarchy as H
from annotara.session import checkpoint_dir, release


def test_a_round_keeps_no_rows_that_walk_on(spark):
    """Walking rows of past rounds took disk and, in unions, the driver's memory."""
    rng = random.Random(5)
    rows = [(f"A:{i:05d}", f"A:{max(0, i - rng.randrange(1, 3)):05d}") for i in range(1, 3000)] + [("C:1", "C:2"), ("C:2", "C:3"), ("C:3", "C:1"), ("C:4", "C:1")]
    release(spark)
    base = checkpoint_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{base}/rdd-*"))
    out = H.solve(H.links(spark.createDataFrame(rows, "node string, up string"), "node", {"up": "up"}), split=16)
    walking = {os.path.dirname(p) for p in glob.glob(f"{base}/annotara-*/round=*/done=0/*.parquet")}
    assert len(walking) <= 2 and set(glob.glob(f"{base}/rdd-*")) == before
    got = {r.node: (r.root, r.depth) for r in out.collect()}
    up, depth = dict(rows), {"A:00000": 0}
    for node, parent in rows[:2999]:
        depth[node] = depth[parent] + 1
    assert all(got[n] == ("A:00000", d) for n, d in depth.items())
    assert {got[c] for c in ("C:1", "C:2", "C:3", "C:4")} == {("C:1", -1)} and len(got) == len({*up, *up.values()})
    release(spark)
