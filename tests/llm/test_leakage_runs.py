import random

from aula.llm.leakage import leaks


def test_long_runs_are_whole_either_way(spark):
    rnd = random.Random(3)
    line = lambda n, size: [f"w{rnd.randrange(size)}" for _ in range(n)]
    tests = [(i, " ".join(line(rnd.randrange(20, 90), 10**6 if i % 2 else 3)), None, " ".join(line(120, 10**6))) for i in range(8)]
    docs = []
    for i in range(60):
        t = (tests[i % 8][1 if i % 3 else 3]).split()
        a = rnd.randrange(0, 10)
        docs.append((i, " ".join(line(i % 7, 50) + t[a : a + rnd.randrange(5, 100)] + line(4, 50) + t[:15])))
    docs += docs[-3:]
    for i in range(3):  # one key, texts that differ, runs that would adjoin
        t = tests[i][3].split()
        docs += [(None, " ".join(t[:30])), (None, " ".join([*line(30, 50), *t[30:70]]))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    td = spark.createDataFrame(tests, "item_id bigint, question string, reference_answer string, passage string")
    for shared, k in ((12, 8), (6, 4), (7, 7), (5, 1)):
        resident, shuffled = (sorted(map(tuple, leaks(df, td, shared=shared, k=k, resident_words=n).collect()), key=repr) for n in (10**9, 0))
        assert resident == shuffled
        assert max(r[4] for r in resident) > 60
