from tidemark.sources import shards


def test_walk_goes_below_fifty_levels(spark):
    edges = spark.createDataFrame([(str(i), str(i + 1)) for i in range(54)] + [("54", "0")], "parent string, child string").coalesce(1)
    assert dict(shards.walk_edges(edges, "0").collect()) == {str(i): i for i in range(55)}
