import random
from collections import Counter

from lintmill.llm import layout_copies as C

SAME = [
    ("a.sql", "SELECT a.[x], b AS [Y] FROM dbo.T AS a;\r\nGO", "select b as y\n  , \"A\".x\nfrom [dbo].t as a\ngo"),
    ("a.sql", "CREATE TABLE t (a INT NOT NULL, b DECIMAL(9, 2));", "﻿create table T\n(\n  B decimal(9,2)\n, A int not null\n)"),
    ("a.sql", "SELECT (SELECT c, d FROM u) AS q, a FROM t", "SELECT a, (SELECT d, c FROM u) AS q FROM t;"),
    ("a.sql", "-- one two\n-- three\nSELECT 1", "/* One two,\n three */ select 1;"),
    ("a.json", '{"a": 1, "b": [1, {"c": "X", "d": null}]}', '{"B":[1,{"D":null,"c":"x"}],\n"a":1}'),
    ("a.xml", '<s a="1" b="x"><t/></s>', "<S  b='X' a='1'>\n<t></t> </S>"),
]
OTHER = [
    ("a.sql", "SELECT a FROM t WHERE b = 1", "SELECT a FROM t WHERE b = 2"),
    ("a.sql", "INSERT INTO t VALUES (1, 2)", "INSERT INTO t VALUES (2, 1)"),
    ("a.sql", "SELECT 1; SELECT 2", "SELECT 2; SELECT 1"),
    ("a.sql", "SELECT a FROM t WHERE b < 1", "SELECT a FROM t WHERE b > 1"),
    ("a.json", '{"a": [1, 2]}', '{"a": [2, 1]}'),
    ("a.json", '{"a": 1.0}', '{"a": 1}'),
    ("a.xml", '<a x="1"/>', '<a x="1" y="2"/>'),
]


def key(path, text):
    return C.radix_key(text, C.language_of(path))


def test_same_and_other():
    for path, a, b in SAME:
        assert C.canonical(a, C.language_of(path)) == C.canonical(b, C.language_of(path)), (a, b)
    for path, a, b in OTHER:
        assert key(path, a) != key(path, b), (a, b)


def test_trie_counts():
    rng = random.Random(1)
    keys = [bytes(rng.choice([0, 1]) for _ in range(6)) for _ in range(40)]
    want: dict = {}
    t = C.Trie()
    for i in range(2000):
        k = rng.choice(keys)
        assert t.add(k, [i]) == (k not in want)
        want.setdefault(k, []).append(i)
    assert {x[0]: x[1] for x in t.terminals()} == want


def test_operator_against_brute_force(spark):
    rng = random.Random(7)
    texts = [t for _, a, b in SAME + OTHER for t in (a, b)]
    rows = [(i, "a.sql", rng.choice(texts) if rng.random() < 0.5 else texts[0], "k") for i in range(600)]
    rows += [(601, "a.sql", None, "k"), (None, "a.sql", texts[0], "k"), (602, "a.sql", "", "k"), (603, "a.sql", " ﻿", "k"), (0, *rows[0][1:])]
    df = spark.createDataFrame(rows, "script_id long, file_path string, text string, key string")
    groups: dict = {}
    for i, p, t, _ in rows:
        if t is not None and i is not None:
            groups.setdefault(key(p, t), set()).add(i)
    want = sorted((min(g), i) for g in groups.values() for i in g if i != min(g))
    rows_of = Counter(key(p, t) for i, p, t, _ in rows if t is not None and i is not None)
    for bucket, hot in ((100_000, 1), (2, 10**6), (3, 20), (1, 1)):
        assert sorted(tuple(r) for r in C.layout_copies(df, bucket, hot, 1).collect()) == want
        assert sorted(tuple(r) for r in C.distinct_scripts(df, bucket, hot, 1).collect()) == sorted((min(g), rows_of[k]) for k, g in groups.items())
    assert C.layout_copies(df.limit(0)).count() == 0


def test_deep_and_long():
    deep = "SELECT " + "(SELECT " * 3000 + "1" + ")" * 3000
    assert key("a.sql", deep) == key("a.sql", deep.lower())
    assert key("a.json", "[" * 5000) == key("a.json", " " + "[" * 5000)


def test_only_oversized_buckets_are_split(spark):
    texts = [f"SELECT a FROM t WHERE b = {i}" for i in range(60)] + [f"UPDATE t SET a = {i}" for i in range(3)] + ["DELETE FROM t"] * 50
    df = spark.createDataFrame([(i, "a.sql", t) for i, t in enumerate(texts)], "script_id long, file_path string, text string")
    bucketed, split = C.split_buckets(C.local_counts(df), 64, 10)
    assert split[:3] == [1, 1, 1] and split[3] <= 6  # all, then those of SELECT alone
    buckets = {}
    for r in bucketed.collect():
        buckets.setdefault(bytes(r["bucket"]), set()).update(r["ids"])
    assert max(len(v) for v in buckets.values() if v & set(range(60))) <= 10
    assert {len(k) for k, v in buckets.items() if v & set(range(60, 113))} == {8}
    assert sorted(i for v in buckets.values() for i in v) == list(range(113))
