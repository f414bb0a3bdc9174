import random

from tapeline.llm.graph import components


def _expected(links):
    part = {x: x for ab in links for x in ab}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        part[max(x, y)] = min(x, y)
    return {x: find(x) for a, b in links if a != b for x in (a, b)}


def test_components_of_every_shape(spark):
    g = random.Random(1)
    path = g.sample(range(1000), 60)
    links = list(zip(path, path[1:], strict=False))
    links += [(2000 + k // 10 * 10, 2000 + k) for k in range(300)]  # stars
    links += [(3500, 3000 + k) for k in range(120)]  # a large centre of small nodes
    links += [(4004, 4004)]
    links += [(5000 + g.randrange(200), 5000 + g.randrange(200)) for _ in range(150)] * 2
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == _expected(links)
    assert len(got) == len({r["node"] for r in got})


def test_no_links(spark):
    assert components(spark.createDataFrame([(4, 4)], "a long, b long").limit(0)).count() == 0
