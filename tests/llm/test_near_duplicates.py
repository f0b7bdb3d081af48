import random

import pytest
from conftest import MID, SMALL
from oracle import assert_same, connect

from aula.llm import near_duplicates as nd
from aula.llm import near_duplicates_queries as q


def make(seed):
    rnd = random.Random(seed)
    vocab = [f"term{i}" * (1 + i % 3) for i in range(400)] + ["the", "of", "a"] * 3
    rows = []
    for i in range(60):
        base = rnd.sample(vocab, rnd.randrange(8, 40))
        rows.append((0, i * 10, base))
        for j in range(rnd.randrange(0, 4)):
            own = list(base)
            for _ in range(rnd.randrange(0, 9)):
                own[rnd.randrange(len(own))] = rnd.choice(vocab)
            rnd.shuffle(own)
            rows.append((rnd.choice([0, 0, 1]), i * 10 + j + 1, own))
    return rows


def brute(rows):
    sets = {(k, i): {x.lower() for x in t} for k, i, t in rows}
    sets = {k: v for k, v in sets.items() if len(v) >= 12}
    keys = sorted(sets)
    return {(a[0], a[1], b[1]) for n, a in enumerate(keys) for b in keys[n + 1 :] if a[0] == b[0] and len(sets[a] & sets[b]) * 10 >= len(sets[a] | sets[b]) * 7}, keys


@pytest.mark.parametrize("seed,matches,long_list", [(1, 1, 2000), (2, 2, 2000), (3, 4, 2000), (4, 2, 1), (5, 2, 2), (6, 3, 0)])
def test_random_sets_against_all_pairs(spark, seed, matches, long_list):
    rows = make(seed)
    want, keys = brute(rows)
    data = [(k, i, "\n".join(t), 1) for k, i, t in rows] + [(0, 9000, None, 1), (0, 9001, "", 1), (0, 9002, "a\nb", 1)]
    data += data[:20]
    df = spark.createDataFrame(data, "kind int, id bigint, text string, cls int").repartition(5)
    members, links = nd.near_duplicate_classes(df, matches=matches, coordinates=72 + 8 * (matches - 1), long_list=long_list)
    got = [tuple(r) for r in nd.expand(members, links).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    parent = {k: k for k in keys}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    degree = dict.fromkeys(keys, 0)
    for k, a, b in want:
        degree[k, a] += 1
        degree[k, b] += 1
        x, y = sorted((find((k, a)), find((k, b))))
        parent[y] = x
    rows = nd.groups(members, links).collect()
    assert {(r.kind, r.id): r.n_links for r in rows} == degree
    named = {}
    for r in rows:
        assert named.setdefault(r.group_class, find((r.kind, r.id))) == find((r.kind, r.id))
    assert len(set(named.values())) == len(named)


def test_many_copies_stay_one_class(spark):
    text = "\n".join(f"word{i}" for i in range(30))
    other = text.replace("word3\n", "wurd3\n")
    df = spark.createDataFrame([(0, i, text if i else other) for i in range(40)], "kind int, id bigint, text string").repartition(8)
    members, links = nd.near_duplicate_classes(df)
    assert members.select("cls").distinct().count() == 2 and links.count() == 1
    assert nd.expand(members, links).count() == 40 * 39 // 2


def test_collisions_are_counted(spark):
    """Records without skipped values and with them: what two skipped entries share is added."""
    terms = spark.createDataFrame([(c, 12, 0, 0, 0, 0, [f"x{i}" for i in range(12)]) for c in range(6)], "cls bigint, n int, s0 bigint, s1 bigint, s2 bigint, s3 bigint, terms array<string>")
    rows = [(1, 0, 20), (1, 1, 20), (2, 0, 20), (2, 1, 20), (3, 2, 40), (3, 3, 40), (9, 2, 41), (9, 3, 41), (4, 4, 60), (4, 5, 80), (8, 4, 61), (8, 5, 61)]
    posted = spark.createDataFrame(rows, "key bigint, cls bigint, t0 bigint")
    got = {(r.a, r.b) for r in nd.class_links(terms, posted, (7, 10), 0, 2).collect()}
    assert got == {(0, 1), (2, 3)}
    assert {(r.a, r.b) for r in nd.class_links(terms, posted, (7, 10), 0, 3).collect()} == {(0, 1)}


def lists_of(seed):
    """Lists of all sizes, posted by several tasks."""
    rnd = random.Random(seed)
    rows = [(key, cls, (rnd.randrange(3) << 1) | (rnd.random() < 0.3)) for key in range(40) for cls in rnd.sample(range(1000), rnd.choice([1, 2, 3, 9]))]
    return rows + [(100, cls, 0) for cls in range(12)] + [(101, cls, 0) for cls in range(35)] + [(102, 5, 0), (102, 6, 0)]


@pytest.mark.parametrize("batch", [1, 7, 1000])
def test_lists_over_batches(spark, batch):
    """Lists that end in another batch, copies across batches, and lists that turn out long while they are read."""
    rows = lists_of(batch)
    posted = spark.createDataFrame(rows + rows[::3], "key bigint, cls bigint, t0 bigint").repartition(3, "key")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = sorted(tuple(r) for r in nd.list_pairs(posted, 2, 11).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [(cls, key, nd.LONG, 0) for key, cls, _ in rows if key in (100, 101)]
    for key, a, x in rows:
        want += [(a, b, 1, int(x >> 1 == y >> 1)) for k, b, y in rows if k == key and a < b and key not in (100, 101) and not x & y & 1]
    assert got == sorted(want) and len(want) > 300


def test_nothing_that_grows_is_broadcast(spark):
    terms = spark.createDataFrame([(c, 12, 0, 0, 0, 0, [f"x{i}" for i in range(12)]) for c in range(6)], "cls bigint, n int, s0 bigint, s1 bigint, s2 bigint, s3 bigint, terms array<string>")
    posted = spark.createDataFrame([(1, 0, 20), (1, 1, 20)], "key bigint, cls bigint, t0 bigint")
    links = nd.class_links(terms, posted, (7, 10), 0, 2)
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") > 5
    members = spark.createDataFrame([(0, 1, 7)], "kind int, id bigint, cls bigint")
    assert "BroadcastHashJoin" not in nd.expand(members, links)._jdf.queryExecution().executedPlan().toString()


def test_terms_of_a_block_are_those_of_each_text():
    import pyarrow as pa

    texts = ["A.\nb\n\n•\n(a)\nC", None, "", "c\nC!\nd\nb", "•"]
    own, bounds, code, words, hashes, lengths = nd.Signer(72, 5, 2).terms(pa.array(texts, pa.string()), 1)
    got = {int(r): sorted(words[int(c)].as_py() for c in code[bounds[i] : bounds[i + 1]]) for i, r in enumerate(own)}
    assert got == {0: ["a", "b", "c"], 3: ["b", "c", "d"]} and lengths.tolist() == [1] * len(words) and len(hashes) == len(words)


def test_empty_table(spark):
    df = spark.createDataFrame([], "kind int, id bigint, text string")
    members, links = nd.near_duplicate_classes(df)
    assert nd.expand(members, links).count() == 0 and nd.groups(members, links).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 50)] + [(100, 90), (90, 95)], "a bigint, b bigint")
    got = {r.node: r.root for r in nd.components(edges).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 90, 90: 90, 95: 90}


@pytest.mark.parametrize("name", sorted(q.QUERIES))
@pytest.mark.parametrize("d", [SMALL, MID])
def test_against_sql(spark, name, d):
    assert_same(q.QUERIES[name](spark, d), connect(d), q.SQL[name])
