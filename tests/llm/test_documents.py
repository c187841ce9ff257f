import random

from lintmill.llm import containers as P
from lintmill.llm import eval_leaks as E
from lintmill.llm import stuffed_pages as S

# -- containers ------------------------------------------------------------------


def test_pack_is_valid_and_tight():
    rng = random.Random(1)
    for _ in range(50):
        caps = sorted(rng.sample([64, 100, 256, 512, 1000], rng.randint(1, 3)))
        sizes = sorted((rng.randint(0, caps[-1]) for _ in range(rng.randint(0, 200))), reverse=True)
        where, capacity = P.pack(sizes, caps)
        used = [0] * len(capacity)
        for n, w in zip(sizes, where):
            used[w] += n
        assert all(u <= c and c in caps for u, c in zip(used, capacity))
        assert all(c == min(x for x in caps if x >= u) for u, c in zip(used, capacity))
        for rule in (P.opening, P.greatest, P.least):
            assert sum(capacity) <= sum(P.best_fit(sizes, caps, rule)[1])


def test_capacities_are_chosen_by_cost():
    caps = [512, 2048, 8192]
    assert P.pack([2040] * 3, caps)[1] == [2048] * 3  # one of 8,192 would leave 2,072 unused
    assert P.pack([5000, 3190, 300, 210], caps) == ([0, 0, 1, 1], [8192, 512])
    rng = random.Random(4)
    mixed = gained = 0
    for _ in range(40):
        sizes = sorted((int(rng.lognormvariate(6.3, 0.9)) % 8000 + 1 for _ in range(300)), reverse=True)
        got, one = P.pack(sizes, caps)[1], P.best_fit(sizes, caps[-1:])[1]
        mixed += len(set(got)) > 1
        gained += sum(got) < sum(one)
        assert sum(got) <= sum(one)
    assert mixed > 20 and gained > 20


def test_fill(spark):
    d = spark.createDataFrame([(i, "word " * (i * 7), "x") for i in range(40)] + [(99, None, "x"), (98, "", "x"), (None, "a b", "x"), (5, "word " * 35, "x")], "doc_id long, text string, capacity string")
    sizes = spark.createDataFrame([(1, 32), (2, 64), (2, 64), (3, None), (4, 0)], "size_id int, capacity_tokens int")
    rows = P.fill(d, sizes, cell_items=16).collect()
    tokens = {r["doc_id"]: r["tokens"] for r in P.token_counts(d).where("doc_id is not null and doc_id <> 5").collect()}
    got: dict = {}
    boxes: dict = {}
    for r in rows:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["tokens"]
        boxes.setdefault((r["container"], r["capacity"]), []).append(r["tokens"])
    assert all(got[k] == v for k, v in tokens.items()) and len(boxes) == len({c for c, _ in boxes})
    assert all(sum(v) <= c for (_, c), v in boxes.items())
    assert all(len([r for r in rows if r["doc_id"] == k]) == max(1, -(-v // 64)) for k, v in tokens.items())
    assert P.fill(d.limit(0), sizes).count() == 0


# -- leaks ------------------------------------------------------------------------

RNG = random.Random(3)
VOCABULARY = [f"w{i}" for i in range(4000)]
ITEM = [RNG.choice(VOCABULARY) for _ in range(90)]
OTHER = [RNG.choice(VOCABULARY) for _ in range(80)]


def noise(n):
    return [RNG.choice(VOCABULARY) + "z" for _ in range(n)]


def test_leaks(spark):
    changed = ITEM[30:70]
    for i in (5, 15, 25, 35):
        changed = changed[:i] + ["changed"] + changed[i + 1 :]
    many = ITEM[30:70]
    for i in range(0, 40, 5):
        many = many[:i] + ["changed"] + many[i + 1 :]
    docs = [
        (1, " ".join(noise(50) + ITEM + noise(9))), (2, " ".join(noise(20) + ITEM[10:35] + noise(20))), (3, " ".join(noise(20) + ITEM[10:32] + noise(20))),
        (4, " ".join(noise(5) + changed)), (5, " ".join(noise(5) + many + noise(5))), (6, "<p>" + "</p>\n<p>".join(w.upper() + "," for w in ITEM[40:70]) + "</p>"),
        (7, None), (8, ""), (9, " ".join(ITEM[:40] + OTHER[:40])), (10, " ".join(ITEM[3:20] + noise(40) + ITEM[20:40])), (1, " ".join(ITEM)),
        (11, " ".join(noise(30000) + OTHER[20:50] + noise(30000))), (12, " ".join(ITEM[20:32] + ["in"] + ITEM[32:46])),
    ]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(100, "s", " ".join(ITEM)), (200, "s", " ".join(OTHER)), (300, "s", "too short"), (None, "s", "x"), (400, "s", None)], "item_id long, suite string, text string")
    want = [(1, 100), (2, 100), (4, 100), (6, 100), (9, 100), (9, 200), (11, 200), (12, 100)]
    for block in (E.BLOCK_CHARS, 300):
        assert sorted(tuple(r) for r in E.leaks(d, items, block).collect()) == want
    assert E.leaks(d, items.limit(0)).count() == 0 and E.leaks(d.limit(0), items).count() == 0
    assert {r["item_id"]: r["documents"] for r in E.leaked_items(d, items).where("item_id is not null").collect()} == {100: 6, 200: 2, 300: 0, 400: 0}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_pieces_guarantee():
    # wherever a stretch starts, it holds budget + 1 whole pieces
    for start in range(E.PIECE):
        whole = sum(1 for p in range(0, 200, E.PIECE) if p >= start and p + E.PIECE <= start + E.PASSAGE)
        assert whole >= E.BUDGET + 1


def test_passages_of_all_lengths():
    doc = noise(20) + ITEM[20:50] + noise(20)
    for i in (10, 15, 19):
        doc[20 + i] = "changed"
    state = E._automaton([(100, ITEM)])
    assert list(E._search(state, [1], [" ".join(doc)])) == [(1, 100)]
    doc[30 + 2] = "changed"  # 4 in 30
    assert list(E._search(state, [1], [" ".join(doc)])) == []
    for n, at in ((40, (16, 18, 20, 22)), (25, (0, 24)), (25, (0,)), (25, (24,)), (25, (1, 23)), (30, (0, 1, 29))):
        for start, lost in ((10, 0), (10, 1), (0, 0), (len(ITEM) - n, 0)):
            words = ITEM[start : start + n]
            for i in at:
                words[i] = "changed"
            if lost:  # one edit too many
                words[n // 2] = words[n // 2 - 3] = "changed"
            if lost and (len(at) < n // 10 or n == 30):
                continue
            got = list(E._search(state, [1], [" ".join(noise(20) + words + noise(20))]))
            assert got == ([] if lost else [(1, 100)]), (n, at, start, lost)
    for n in range(E.PASSAGE, 500):
        assert (n - E.PIECE + 1) // E.PIECE >= n // 10 + 1


def test_reach():
    rng = random.Random(9)
    for _ in range(400):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 9))]
        b = [rng.choice("abcd") for _ in range(rng.randint(0, 12))]
        for e, got in enumerate(E._reach(a, b, 3)):
            fits = [i for i in range(1, len(a) + 1) for j in range(1, len(b) + 1) if a[i - 1] == b[j - 1] and edit_distance(a[:i], b[:j]) <= e]
            assert got == max(fits, default=0)


# -- stuffed pages ------------------------------------------------------------------


def covered_by_brute_force(words, least):
    n = len(words)
    out = [False] * n
    for i in range(n):
        for j in range(i + 1, n + 1):
            part = words[i:j]
            if sum(map(len, part)) >= least and sum(words[k : k + j - i] == part for k in range(n)) > 1:
                out[i:j] = [True] * (j - i)
    return out


def test_automaton_coverage():
    rng = random.Random(2)
    for k in range(600):
        letters = ["a", "bb", "ccc", "d", "eeee", "f"][: rng.randint(1, 6)]
        words = [rng.choice(letters) for _ in range(rng.randint(0, 16))]
        for least in (1, 2, 4, 7):
            assert S.repeated(words, least) == covered_by_brute_force(words, least), (words, least)


GOOD = "The formatter keeps comments that sit between two tokens. A nightly run counts every script, because the grammar allows both forms. Nobody noticed for days."


def test_pages(spark):
    spam = "sql formatter | best sql editor | free sql tools | " * 30
    links = "\n".join(f"https://shop{i % 9}.example/sql-formatter/{i}" for i in range(60))
    tags = " ".join("#SqlFormatter #BestEditor" for _ in range(40))
    prices = "\n".join(f"Query Builder Pro v{i}.1 | $8{i}.99 | in stock | add to cart" for i in range(40))
    anchors = "<ul>" + "".join(f'<li><a href="https://x{i}.example/p{i}">Index Advisor</a></li>' for i in range(40)) + "</ul>"
    rows = [
        (1, GOOD * 9), (2, spam), (3, links), (4, tags), (5, prices), (6, anchors), (7, None), (8, ""), (9, " \n"), (10, GOOD * 40 + spam), (11, GOOD + "\n" + spam * 9),
        (12, "SELECT a\n, b\nFROM dbo.t AS a\nWHERE a.b = 1;\n" * 40), (13, "```sql\n" + "SELECT a FROM t\n" * 99 + "```\n" + GOOD), (2, spam), (14, spam * 500),
        (15, "この夜間処理は月が締まるまで実行してはいけません。" * 30), (16, "| rule | what |\n" + f"| [a-b](https://d.example/a-b) | {GOOD} |\n" * 9), (17, "<a " * 20000), (18, "[" * 20000),
        (20, "sql crack serial (57) 在线 sql 格式化 (816) schema compare tool (130) " * 20), (21, "格式化 sql 在线 gratis formatear sql 在线 格式化 sql " * 20), (22, "#在线Sql格式化 #LintPlugin2020 " * 30),
        (23, "sql 整形 無料, 在线 sql 格式化、sql 整形 無料, " * 30), (24, "error a.sql:3:4 (x-1)\n" * 40), (25, '{"a": [1, 2], "b": {"c": 1}}\n' * 40),
    ]
    d = spark.createDataFrame([(i, t, True) for i, t in rows], "doc_id long, text string, stuffed boolean")
    assert sorted(r[0] for r in S.stuffed_pages(d).collect() if r[0] not in (17, 18)) == [2, 3, 4, 5, 6, 11, 14, 20, 21, 22, 23]
    assert S.stuffed_pages(d.limit(0)).count() == 0
    got = {r["doc_id"]: r for r in S.page_measures(d).collect()}
    assert got[1]["repeated"] == 1 and got[1]["stuffing"] == 0  # each page goes through the automaton
