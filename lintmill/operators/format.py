"""Formatting of script collections: one Arrow-batched pass, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lintmill.arrow import map_lists
from lintmill.formatting import formatter
from lintmill.formatting.formatter import FormatOptions
from lintmill.syntax import lexer as L


def format_scripts(scripts: DataFrame, options: FormatOptions = FormatOptions()) -> DataFrame:
    """``script_id, formatted, changed``; a null text gives no row."""

    def run(ids, texts):
        for i, t in zip(ids, texts):
            if t is not None:
                new = formatter.format_sql(t, options)
                yield i, new, new != t

    return map_lists(scripts, ["script_id", "text"], run, "script_id long, formatted string, changed boolean")


#: Single passes by name, as functions of text and options.
PASSES = {
    "strip_lone_cr": lambda t, o: formatter.strip_lone_cr(t),
    "keyword_spacing": lambda t, o: "".join(formatter.keyword_spacing(L.split(t)[0])),
    "element_casing": lambda t, o: "".join(formatter.element_casing(L.split(t)[0], o)),
    "whitespace": lambda t, o: formatter.whitespace(t, o, formatter.line_ending(t, o.line_ending)),
    "blank_lines": lambda t, o: formatter.blank_lines(t, o, formatter.line_ending(t, o.line_ending)),
    "inline_spacing": lambda t, o: "".join(formatter.inline_spacing(L.split(t)[0])),
    "function_spacing": lambda t, o: "".join(formatter.function_spacing(L.split(t)[0])),
    "operator_spacing": lambda t, o: "".join(formatter.operator_spacing(L.split(t)[0])),
    "leading_commas": lambda t, o: formatter.comma_style(t, "leading", formatter.line_ending(t, o.line_ending)),
    "trailing_commas": lambda t, o: formatter.comma_style(t, "trailing", formatter.line_ending(t, o.line_ending)),
}


def format_pass(scripts: DataFrame, name: str, options: FormatOptions = FormatOptions()) -> DataFrame:
    """``script_id, formatted`` after a single pass."""
    f = PASSES[name]

    def run(ids, texts):
        for i, t in zip(ids, texts):
            if t is not None:
                yield i, f(t, options)

    return map_lists(scripts, ["script_id", "text"], run, "script_id long, formatted string")
