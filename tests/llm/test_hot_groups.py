"""Hot sources, repeated rows, hubs and inputs whose row order is not fixed."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from pricelens.llm import mixing, sharding
from pricelens.llm.graph import connected_components


def test_mixture_selection_equals_one_sort_a_source(spark):
    r = random.Random(6)
    rows = [(i, " ".join("w" * r.randrange(0, 30)), r.choice(["hot", "hot", "hot", "a", "b", None])) for i in range(900)]
    rows += [(5000, "one row again and again", "hot")] * 400
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    quality = F.when(F.col("doc_id") % 3 == 0, 1.0).otherwise(0.0)  # most keys lie beyond nearly all of the unit exponential
    seen = []
    for range_rows in (40, 1 << 20):
        got = mixing.mix(df, quality=quality, range_rows=range_rows).collect()
        by = defaultdict(list)
        for x in got:
            by[x["source"]].append(x)
        for xs in by.values():
            target, size = xs[0]["target"], xs[0]["source_size"]
            epochs = int(target // size)
            rest = round(target - epochs * size)
            xs.sort(key=lambda x: (x["key"], -x["taken"]))
            before = 0
            for x in xs:
                want = epochs * x["size"] + max(0, min(x["size"], rest - before))
                assert x["taken"] == want
                before += x["size"]
        seen.append(sorted((x["source"] or "", x["id"], x["taken"]) for x in got))
    assert seen[0] == seen[1] and len(seen[0]) == len(rows)


def test_buckets_do_not_depend_on_the_order_within_a_partition(spark):
    rows = [(i % 700, f"text {i % 700}", {"k": i}) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra map<string,int>").repartition(4, "doc_id")
    places = []
    for order in (F.col("doc_id").asc(), F.col("doc_id").desc()):
        d = sharding.external_shuffle(df.sortWithinPartitions(order).select("doc_id", "text"), bucket_bytes=4_000)
        places.append(sorted((x["bucket"], x["pos"], x["row"]["doc_id"]) for x in d.collect()))
    assert places[0] == places[1] and len({b for b, _, _ in places[0]}) > 3
    whole = sharding.shard(df, 4, bucket_bytes=8_000).collect()
    assert sorted(x["row"]["extra"]["k"] for x in whole) == list(range(1000))


def test_components_of_hubs(spark):
    r = random.Random(3)
    edges = [(0, i) for i in range(1, 400)] + [(5000, i) for i in range(4600, 5000)] + [(399, 4600)] + [(i, i + 1) for i in range(6000, 6030)]
    edges += [(r.randrange(7000, 7200), 7200) for _ in range(300)]
    r.shuffle(edges)
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    found = connected_components(spark.createDataFrame(edges, "a long, b long"))
    got = {(x["node"], x["root"]) for x in found.collect()}
    assert {(a, b) for a, b in got if a != b} == {(x, root(x)) for x in parent if x != root(x)}
