import functools
import random

from lintmill.llm import markup_states as M
from lintmill.llm import syntax_check as C
from lintmill.syntax import lexer as L

PIECES = ["SELECT a FROM t;\n", "-- it's ( x\n", "/* a /* (b */ c */", "N'a''b(\r\nc'", "[x]]y(]", '"q("', "(\n", ")\n", "GO\n", "  go 2 -- x\r\n", "x = 1 ", "\r", "BEGIN SELECT 1 END\n", "'", "/*", "*/", "["]


def whole(text):
    """The summary of a text lexed at once."""
    return C._from_code(text, True)[0]


def direct(text):
    """Verdict on a text without chunks."""
    lexemes, open_ = L.split(text)
    if open_ or any(k.count("(") != k.count(")") for _, _, _, k in C.batches(lexemes)):
        return "not balanced"
    return C.parse_lexemes(lexemes)


def test_summaries_compose_to_the_whole():
    rng = random.Random(4)
    for _ in range(1500):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(1, 14)))
        maps = [c.map(k == 0) for k, c in enumerate(C.sql_chunks(text, rng.randint(3, 12)))]
        total = C.apply_map(C.reduce_pairs(maps, C.join_maps), L.CODE)
        one = C.apply_map(functools.reduce(C.join_maps, maps), L.CODE)
        want = whole(text)
        assert total == one
        assert total[0] == want[0] or (total[0], want[0]) in ((L.CODE, L.LINE_COMMENT), (L.LINE_COMMENT, L.CODE)), (text, total, want)
        assert C.verdict_of_summary(total) == C.verdict_of_summary(want), (text, total, want)


def test_composition_is_associative():
    rng = random.Random(9)
    for _ in range(300):
        a, b, c = (C.SqlChunk("".join(rng.choice(["(", ")", "\nGO\n", " x ", "((", "/*", "*/", "'", "]", "--"]) for _ in range(6)) + "\n", True).map(False) for _ in range(3))
        left, right = C.join_maps(C.join_maps(a, b), c), C.join_maps(a, C.join_maps(b, c))
        states = {s for m in (left, right) for s in m if s != "block"} | {L.BLOCK + 20}
        assert all(C.apply_map(left, s) == C.apply_map(right, s) for s in states) and left["block"][1] == right["block"][1]


MARKUP = {
    "json": ["{", "}", "[", "]", '"a"', '"b\\\\"', '"c\\"d"', ":", ",", "1", '"', "\\", "\n"],
    "xml": ["<a>", "</a>", "<b x='>\">'>", "</b>", "<c/>", "<!-- <a> -->\n", "<![CDATA[<b>]]>", "<?p <a> ?>", "text\n", "<d y=\"a'b\n\"/>", "<!--", "<!DOCTYPE a [<!ENTITY e '<b>'>]>"],
}


def test_markup_maps_compose_to_the_whole():
    rng = random.Random(5)
    for language, first in (("json", "value"), ("xml", "text")):
        for _ in range(800):
            text = "".join(rng.choice(MARKUP[language]) for _ in range(rng.randint(0, 14)))
            want = M.maps(text, 10**6, language)[0][first]
            maps = M.maps(text, rng.randint(2, 9), language)
            assert C.reduce_pairs(maps, M.join_maps)[first][0] == want[0], (text, maps)
            assert M.verdict(C.reduce_pairs(maps, M.join_maps)[first]) == M.verdict(want)
            assert functools.reduce(M.join_maps, maps)[first] == C.reduce_pairs(maps, M.join_maps)[first]


def test_maps_reject_nothing_valid():
    good = '<?xml version="1.0"?><!DOCTYPE a [<!ENTITY e "<b>"><!-- ] -->]><a x=">" y=\'"/\'><!-- <q> --><b/><c>]]&gt;</c ><![CDATA[</a>]]></a><!-- end -->'
    for size in (5, 20, 10**6):
        assert C.xml_error(good, size) is None
        assert C.xml_error(good.replace("</c >", "</d >"), size) == "elements don't balance"
        assert C.json_error('{"a\\\\": [1, {"b": "}\\""}], "c": {}}', size) is None
        assert C.json_error('{"a": [1, 2}', size) == "brackets don't balance"
        assert C.json_error('{"a": "x', size) == "ends inside string"


def test_chunks_change_nothing(spark):
    rng = random.Random(2)
    good = ["SELECT a\nFROM dbo.t\nWHERE b IN (1, 2);\n", "GO\n", "/* x\n /* y */ z */\n", "PRINT N'a\n''b';\n", "BEGIN\n SELECT 1;\nEND\n", "-- (\n"]
    rows = []
    for i in range(150):
        text = "".join(rng.choice(good) for _ in range(40))
        if i % 3 == 0:
            at = rng.randint(0, len(text))
            text = text[:at] + rng.choice(["(", "'", "/*", ")", " FORM ", "]"]) + text[at:]
        rows.append((i, "r", "a.sql", text))
    df = spark.createDataFrame(rows, "script_id long, repo string, file_path string, text string")
    want = {i for i, _, _, t in rows if direct(t)}
    for size in (60, 200, 10**6):
        assert {r[0] for r in C.invalid_scripts(df, size).collect()} == want


def test_languages_and_edges(spark):
    rows = [
        (1, "r", "a.JSON", '{"a": 1}'), (2, "r", "a.json", "{'a': 1}"), (3, "r", "a.json", "﻿[1]"), (4, "r", "a.json", "[NaN]"), (5, "r", "a.json", ""),
        (6, "r", "a.xml", "<a><b/></a>"), (7, "r", "a.Xml", "<a><b></a>"), (8, "r", "<stdin>", "SELECT 1"), (9, "r", None, "SELECT FROM"), (10, None, "a.sql", None),
        (11, "r", "a.sql", ""), (12, "r", "a.sql", "﻿SELECT 1"), (13, "r", "a.sql", "SELECT " + "(" * 9000 + "1" + ")" * 9000), (9, "r", None, "SELECT FROM"),
        (14, "r", "a.sql", "SELECT 1;\n" * 30000), (14, "r", "a.sql", "SELECT 1;\n" * 30000), (15, "r", "a.sql", "SELECT (1;\n" * 3000), (15, "r", "a.sql", "SELECT (1;\n" * 3000),
    ]
    df = spark.createDataFrame(rows, "script_id long, repo string, file_path string, text string").selectExpr("*", "'x' AS error", "1 AS n")
    got = sorted(r[0] for r in C.invalid_scripts(df).collect())
    assert got == [2, 4, 5, 7, 9, 9, 13, 15, 15]
    rates = {(r["repo"], r["language"]): (r["scripts"], r["invalid"]) for r in C.invalid_rates(df).collect()}
    assert rates[("r", "json")] == (5, 3) and rates[("r", "xml")] == (2, 1) and rates[(None, "tsql")] == (1, 0)
    assert C.invalid_scripts(df.limit(0)).count() == 0


def test_long_files_have_the_separators_of_short_ones():
    for between in ("/* a\n b */ GO\n", "GO 5 5\n", "GO;;\n", "GO 5;\n", "\nGO\n", "x GO\n"):
        for text in ("SELECT x\n" + between + "SELECT 1\n", "SELECT (x\n" + between + ")\n"):
            assert all((C.sql_error(text, size) is None) == (direct(text) is None) for size in (4, 9, 15, 10**6)), text
    first, second = whole("SELECT (1\n"), whole(")\n/* a\n b */ GO\nSELECT 1\n")
    assert C.verdict_of_summary(C.compose(first, second)) is None
    summary, head, rest = C.SqlChunk("a\n b */ GO\nSELECT 1\n", True).at(L.BLOCK)
    assert (summary[:2], head, "".join(rest)) == ((L.CODE, 1), "a\n b */", " GO\nSELECT 1\n")
