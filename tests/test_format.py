import pytest

from lintmill.formatting.formatter import FormatOptions, format_sql
from lintmill.operators.format import PASSES as FUNCTIONS
from lintmill.plans.generated import DEFAULT_FORMAT, PASSES
from lintmill.sources.scripts import decode, glob_regex, ignore_patterns, matches
from lintmill.sources.settings import editor_settings, layered_options, parse_config, print_config, print_format_config, starter_config


@pytest.mark.parametrize("name", sorted(PASSES))
def test_passes(name):
    for before, after in PASSES[name]:
        assert FUNCTIONS[name](before, FormatOptions()) == after


def test_default():
    for before, after in DEFAULT_FORMAT:
        assert format_sql(before) == after


TEMPLATES = ["select {c} from {t}", "insert into {t} ( {c} ) values (1 ,2)", "update {t} set {c}=1 where a!=-1", "select count (*),{c} from {t} left  outer join u on a=b"]


@pytest.mark.parametrize("template", TEMPLATES)
@pytest.mark.parametrize("column", ["a", "[a b]", '"q"', "t.a , b", "'it''s  ,x'", "/* c , d */ a"])
@pytest.mark.parametrize("options", [FormatOptions(), FormatOptions(comma_style="leading", indent_style="tabs", keyword_casing="pascal", max_blank_lines=1)])
def test_idempotent_and_protects(template, column, options):
    once = format_sql(template.format(c=column, t="dbo.T"), options)
    assert format_sql(once, options) == once
    if column[0] in "['\"/":
        assert column.split(" a")[0] in once


def test_empty_and_line_ends():
    assert format_sql("") == "\r\n"
    assert format_sql("", FormatOptions(insert_final_newline=False)) == ""
    assert format_sql("select 1\r\nselect 2", FormatOptions(line_ending="lf")) == "SELECT 1\nSELECT 2\n"


def test_decode():
    assert decode("aé".encode("utf-8-sig"))[0] == "aé"
    assert decode("aé".encode("utf-16"))[0] == "aé"
    assert decode("表".encode("shift_jis")) == ("表", "shift_jis")


def test_ignore_globs():
    assert ignore_patterns("# x\n*.bak.sql # y\n\n") == ["*.bak.sql"]
    assert matches("a/b/C.BAK.sql", "*.bak.sql") and matches("x/gen/a/b.sql", "**/gen/**") and not matches("a.sql", "b*.sql")
    assert glob_regex("a?")


def test_layers():
    e = editor_settings("root = true\n[*]\nindent_style = tab\n[*.{sql,ddl}]\nindent_size = 2\nend_of_line = lf\n", "x/a.sql")
    o, source = layered_options({"indentSize": 8, "commaStyle": "leading"}, e, {"indent_style": "spaces"})
    assert (o.indent_size, o.indent_style, o.comma_style, o.line_ending) == (2, "spaces", "leading", "lf")
    assert (source["indent_size"], source["indent_style"], source["comma_style"], source["keyword_casing"]) == ("editor", "command", "config", "default")
    assert "commaStyle" in print_format_config(o, source) and parse_config(starter_config()).preset == "recommended" and "compatLevel" in print_config(parse_config("{}"))
    with pytest.raises(ValueError):
        parse_config('{"compatLevel": 90}')
