import random

from lintmill.llm import code_language as C

TEXTS = {
    "en": ["The nightly job must not run while the month is open. Every team has to look at this before the release."] * 3,
    "de": ["Der nächtliche Lauf darf nicht starten, solange der Monat offen ist. Jedes Team muss sich das vor der Freigabe ansehen."] * 3,
    "fr": ["Le traitement de nuit ne doit pas tourner tant que le mois est ouvert. Chaque équipe doit regarder cela avant la mise en service."] * 3,
    "ja": ["この夜間処理は月が締まるまで実行してはいけません。担当者は公開の前に確認してください。"] * 3,
    "ru": ["Ночное задание не должно работать, пока месяц ещё открыт. Каждая группа должна посмотреть это до выпуска."] * 3,
}


def docs(spark, extra=()):
    rows = [(i * 10 + k, t, lang) for i, (lang, ts) in enumerate(TEXTS.items()) for k, t in enumerate(ts)]
    return spark.createDataFrame([*rows, *extra], "doc_id long, text string, lang string")


SCRIPTS = [
    (1, "a.sql", "-- The job must not run while\n-- the month is still open here\nSELECT 1"),
    (2, "a.sql", "/* SELECT a, b, c, d, e, f FROM dbo.t WHERE a = 1 */\n-- ============ 12 ============\n-- Server=a;Password=b c d e f g h"),
    (3, "a.sql", "PRINT N'Der Lauf darf nicht starten, solange der Monat offen ist'; PRINT 'la mise en'"),
    (4, "a.json", '{"reason": "Chaque équipe doit regarder cela avant la mise", "x": 1}'),
    (5, "a.xml", "<a><!-- Каждая группа должна посмотреть это до выпуска --><b>The job must not run while the month is open</b></a>"),
    (6, None, "/* この夜間処理は月が締まるまで実行してはいけません"),
    (7, "a.sql", None), (8, "a.sql", ""), (1, "a.sql", "-- The job must not run while\n-- the month is still open here\nSELECT 1"),
]


def test_languages(spark):
    s = spark.createDataFrame(SCRIPTS, "script_id long, file_path string, text string").selectExpr("*", "'x' AS lang", "1.0 AS share")
    got = sorted(tuple(r) for r in C.languages_found(s, docs(spark, [(999, None, "en"), (None, "x", "de"), (998, "x", None)])).collect())
    assert got == [(1, "en"), (3, "de"), (4, "fr"), (5, "ru"), (6, "ja")]
    shares = {r["script_id"]: r["share"] for r in C.language_shares(s, docs(spark)).where("lang = 'fr'").collect()}
    assert 0 < shares[4] < 1


def test_empty(spark):
    s = spark.createDataFrame(SCRIPTS[:1], "script_id long, file_path string, text string")
    assert C.languages_found(s, docs(spark).limit(0)).count() == 0
    assert C.languages_found(s.limit(0), docs(spark)).count() == 0


def test_held_out_accuracy():
    train = [(k, t) for k, ts in TEXTS.items() for t in ts]
    m = C.train(train)
    held = {"en": "Look at the release before every month", "de": "Der Monat muss vor dem Lauf offen sein", "fr": "Le mois est ouvert avant chaque traitement", "ru": "Группа должна открыть месяц до задания"}
    assert all(m.classify(t)[0] == k for k, t in held.items())
    assert m.classify("xq7Zk2 Jw9 qqz pPx vvK zzT wXy")[0] == C.UNDETERMINED


WORDS = {
    "en": "the job must run while month is open every team has to look at this before release rows totals did not match",
    "de": "der lauf darf nicht starten solange monat offen ist jedes team muss sich das vor freigabe ansehen summen stimmten zeilen",
    "nl": "de taak mag niet draaien zolang maand nog open staat elk team moet dit voor de vrijgave bekijken regels totalen klopten",
    "pl": "zadanie nie może działać dopóki miesiąc jest otwarty każdy zespół musi to obejrzeć przed wydaniem wiersze sumy zgadzały",
}


def made(rng, lang):
    words = WORDS[lang].split()
    return " ".join(rng.choice(words) for _ in range(rng.randint(7, 12))) + "."


def labelled(seed, wrong=0.15):
    """Many English documents, few of the others, of which some bear a wrong label or mix languages."""
    rng = random.Random(seed)
    rows = []
    for label, n in (("en", 200), ("de", 20), ("nl", 20), ("pl", 20)):
        for _ in range(n):
            lang = label if rng.random() > wrong or label == "en" else rng.choice(["en", "de", "nl", "pl"])
            rows.append((label, " ".join(made(rng, lang if rng.random() > 0.1 else "en") for _ in range(8))))
    return rows


def test_wrong_labels_are_set_right():
    said = [(k, s) for k, text in labelled(1) for s in C.sentences(text)]
    truth = {s: k for k in WORDS for _, s in said if set(s[:-1].split()) <= set(WORDS[k].split())}
    assert all(truth[s] == k for (_, s), k in zip(said, C.relabel(said)) if s in truth)
    assert any(truth[s] != k for k, s in said)
    assert C.relabel([]) == []


def test_training_draws_agree():
    rng = random.Random(7)
    held = [(k, made(rng, k)) for k in WORDS for _ in range(50)]
    for seed in (11, 12, 13):
        m = C.train(labelled(seed))
        assert sum(m.classify(s)[0] == k for k, s in held) >= 0.99 * len(held)


def test_code_and_keys_fit_no_language():
    code = "```sql\n" + "SELECT LoadLabel, BaseTarget FROM dbo.Quote WHERE SiteTarget = 696\nUPDATE a SET a.Total = 1 FROM dbo.Lot AS a WHERE a.Kind = 3\n" * 20 + "```\n"
    m = C.train([*labelled(1), ("en", code)])
    assert m.classify("SELECT BaseTarget, SiteTarget, Total FROM dbo.Lot WHERE Kind = 5")[0] == C.UNDETERMINED
    assert m.classify("WG7G8t8Mf8yB39Ojm1tmoKzZlKEPxzweMvQtGclacpb8nNI5GryFR1/Ie3ahFDjb")[0] == C.UNDETERMINED


def test_pick():
    rng = random.Random(3)
    many = sorted((rng.getrandbits(64) - 2**63, i) for i in range(20_000))[:1000]
    few = [(rng.getrandbits(64) - 2**63, 50_000 + i) for i in range(900)]
    ids = C.pick({"en": many, "de": few}, 60, 1000)
    assert sum(k == "de" for k in ids.values()) == 60 and 900 < sum(k == "en" for k in ids.values()) < 1000
    assert {i for i, k in ids.items() if k == "de"} == {i for _, i in sorted(few)[:60]}
    assert C.pick({}, 60, 1000) == {} and C.pick({"en": many[:1]}, 60, 1000) == {many[0][1]: "en"}


def test_long_comment_is_linear():
    list(C.sentences("\n".join(["one two three"] * 50_000)))


def test_texts_with_their_place(spark):
    said = "L''équipe doit regarder cela avant la mise en service. The job must not run while the month is open"
    rows = [
        *SCRIPTS, (10, "a.sql", f"PRINT 1\r\nPRINT N'{said}'"), (11, "a.sql", "SELECT 1\n-- xq zk jw qqz ppx vvk zzt"),
        (12, "a.json", '{"a": "x",\n "b": "The \\"job\\" must not run while \\u0074he month is open"}'),
    ]
    s = spark.createDataFrame(rows, "script_id long, file_path string, text string")
    got = C.language_texts(s, docs(spark)).collect()
    texts = {i: t for i, _, t in rows}
    assert [(r["line_no"], r["lang"], r["text"]) for r in sorted(got, key=lambda r: r["start"]) if r["script_id"] == 10] == [
        (1, "fr", "L'équipe doit regarder cela avant la mise en service."), (1, "en", "The job must not run while the month is open"),
    ]
    place = {(r["script_id"], r["lang"]): texts[r["script_id"]][r["start"] : r["start"] + r["length"]] for r in got}
    assert place[10, "fr"] == said[:said.index(" The")] and place[10, "en"] == said[said.index("The") :]
    assert place[1, "en"] == "The job must not run while\n-- the month is still open here"
    assert place[12, "en"] == 'The \\"job\\" must not run while \\u0074he month is open'
    assert place[6, "ja"] == SCRIPTS[5][2][3:]
    assert (11, C.UNDETERMINED) in place and all(r["bits"] > 0 for r in got)
    for r in C.language_shares(s, docs(spark)).where("script_id <> 1").collect():
        own = [x for x in got if (x["script_id"], x["lang"]) == (r["script_id"], r["lang"])]
        assert len(own) == r["sentences"] and abs(sum(x["share"] for x in own) - r["share"]) < 1e-9


def test_json_values_of_least_length_and_without_end():
    said = "月が締まるまで実行しない"
    assert len(said) == C.LEAST_CJK
    assert [s for s, _ in C.markup_spans('{"a": "%s", "b": "x"}' % said, "json")] == [said]
    assert list(C.markup_spans('{"a": "The job must not', "json")) == [("The job must not", [(0, 7)])]
    assert [s for s, _ in C.markup_spans('{"a": "The job must not\\', "json")] == ["The job must not"]
    assert list(C.markup_spans('{"a": "x", "' + "\\\\" * 20000, "json"))
