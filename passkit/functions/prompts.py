"""Prompt templates as column expressions.

The template engine is not needed: each template is a fixed text around
the problem's fields, so rendering is a ``concat`` that Catalyst compiles
into the scan's projection. Unknown template names raise at plan time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template texts and marker phrases (rendered without
# auto-escaping; only the template file's own final newline is dropped).
HUMANEVAL_PREAMBLE = '"""You are an expert q/kdb+ programmer.\nWrite idiomatic q function to complete the following task:\n'
HUMANEVAL_CLOSE = '\n"""'
MBPP_PREAMBLE = '"""Complete the following task in q (KDB+) language:\n'
MBPP_MIDDLE = "\n\n"
MBPP_CLOSE = '\n"""'
GENERIC_PREAMBLE = '"""You are an expert q (KDB+) programmer. Here is your task:\n'
GENERIC_CLOSE = '\n"""\n'
GENERIC_MARKERS = ("q (KDB+)", "q programmer")


def _txt(c: Column) -> Column:
    # the engine renders a missing value as the text "None"
    return F.coalesce(c.cast("string"), F.lit("None"))


def render_humaneval(prompt: Column) -> Column:
    return F.concat(F.lit(HUMANEVAL_PREAMBLE), _txt(prompt), F.lit(HUMANEVAL_CLOSE))


def render_mbpp(text: Column, tests: Column) -> Column:
    """Description, blank line, the first test (or nothing)."""
    first = F.coalesce(F.get(tests, 0), F.lit(""))
    return F.concat(F.lit(MBPP_PREAMBLE), _txt(text), F.lit(MBPP_MIDDLE), first, F.lit(MBPP_CLOSE))


def render_generic(prompt: Column) -> Column:
    """Adds the expert preamble only if neither marker phrase occurs (case-sensitive)."""
    p = _txt(prompt)
    needs = ~F.contains(p, F.lit(GENERIC_MARKERS[0])) & ~F.contains(p, F.lit(GENERIC_MARKERS[1]))
    return F.when(needs, F.concat(F.lit(GENERIC_PREAMBLE), p, F.lit(GENERIC_CLOSE))).otherwise(p)


# name -> (fields read, renderer over those fields)
TEMPLATES: dict[str, tuple[tuple[str, ...], Callable[..., Column]]] = {
    "q_humaneval": (("prompt", "entry_point"), lambda df: render_humaneval(F.col("prompt"))),
    "q_mbpp": (("text", "q_test_list"), lambda df: render_mbpp(F.col("text"), F.col("q_test_list"))),
    "generic": (("prompt",), lambda df: render_generic(F.col("prompt"))),
}
# dataset schema labels map onto templates (the detector says mbpp/humaneval)
SCHEMA_TO_TEMPLATE = {"mbpp": "q_mbpp", "humaneval": "q_humaneval", "q_mbpp": "q_mbpp",
                      "q_humaneval": "q_humaneval", "generic": "generic"}


def template(name: str) -> tuple[tuple[str, ...], Callable[..., Column]]:
    try:
        return TEMPLATES[name]
    except KeyError:
        raise ValueError(f"Unknown template: {name}") from None


def missing_fields(df: DataFrame, required: tuple[str, ...]) -> Column:
    """Names of required fields that are absent from the table or NULL in the row."""
    items = [F.lit(f) if f not in df.columns else F.when(F.col(f).isNull(), F.lit(f)) for f in required]
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def render(df: DataFrame, name: str, out: str = "rendered", errors: str = "error") -> DataFrame:
    """Render every row; rows missing a field get NULL ``out`` and an ``errors`` message."""
    fields, fn = template(name)
    present = [f for f in fields if f in df.columns]
    miss = missing_fields(df, fields)
    t = df
    for f in fields:
        if f not in present:
            t = t.withColumn(f, F.lit(None).cast("array<string>" if f == "q_test_list" else "string"))
    t = t.withColumn("_missing", miss)
    return (t.withColumn(out, F.when(F.size("_missing") == 0, fn(t)))
            .withColumn(errors, F.when(F.size("_missing") > 0,
                                       F.concat(F.lit("Missing required fields: "), F.array_join("_missing", ", "))))
            .drop("_missing", *[f for f in fields if f not in present]))


def registry(spark) -> DataFrame:
    """The template registry as a table: (schema, template, fields), a row for each schema label of a dataset."""
    rows = [(label, name, list(TEMPLATES[name][0])) for label, name in sorted(SCHEMA_TO_TEMPLATE.items())]
    return spark.createDataFrame(rows, "schema string, template string, fields array<string>")


def render_by_schema(df: DataFrame, schema: str, out: str = "rendered", errors: str = "error") -> DataFrame:
    """Render every row with the template of its own schema label; an unknown label is an error of its row."""
    t = df
    for f in ("prompt", "entry_point", "text", "q_test_list"):
        if f not in df.columns:
            t = t.withColumn(f, F.lit(None).cast("array<string>" if f == "q_test_list" else "string"))
    text, why = F.lit(None).cast("string"), F.concat(F.lit("Unknown template: "), F.coalesce(F.col(schema), F.lit("None")))
    for label, name in sorted(SCHEMA_TO_TEMPLATE.items()):
        fields, fn = TEMPLATES[name]
        miss, here = missing_fields(t, fields), F.col(schema) == label
        text = F.when(here & (F.size(miss) == 0), fn(t)).otherwise(text)
        why = F.when(here, F.when(F.size(miss) > 0, F.concat(F.lit("Missing required fields: "), F.array_join(miss, ", ")))).otherwise(why)
    return t.withColumns({out: text, errors: why}).select(*df.columns, out, errors)
