import posixpath

from pyspark.sql import functions as F

from mnemolith.functions import paths


def test_clean_path_walks_only_where_it_must(spark):
    own = ["", "a", "a/b.md", "a//b", "/a", "a/", ".", "./a", "a/./b", "a/..", "a/../b", "..", "../a", "a/../../b", "...", "a/.../b", ".a/b..", "a\n/..", "a\n", "..\n", None]
    rows = {r["p"]: r for r in spark.createDataFrame([(x,) for x in own], "p string").select("p", paths.clean_path(F.col("p")).alias("c"), (~F.col("p").rlike(paths.UNCLEAN)).alias("quick")).collect()}
    for x in own:
        want = None if x is None else posixpath.normpath("/" * 0 + (x.lstrip("/") or "."))
        want = None if want is None or want == ".." or want.startswith("../") else "" if want == "." else want
        assert rows[x]["c"] == want, repr(x)
    assert rows["a/b.md"]["quick"] and rows["a/.../b"]["quick"] and not rows["a/../b"]["quick"]
