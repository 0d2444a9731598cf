"""Cutting candidate code out of free-text completions, as column expressions.

Each completion is split into lines once; the scanners are array
functions and one ``aggregate`` fold over line numbers, so extraction is
row-local (no shuffle) and runs inside the JVM. The fold carries only line
numbers and a brace depth; the body is sliced out afterwards, so the cost
is linear in the number of lines.

Rules kept from the original scanner:

* a code block opens at the first line that strips to exactly ```` ```q ````
  and closes at the next line stripping to ```` ``` ````; lines stripping to
  ```` ```q ```` inside it are dropped; an unclosed block runs to the end; an
  empty first block counts as none;
* a function starts at the first line (blank and ``//`` lines skipped before
  capture) that contains ``name:`` as a substring *and* a ``{``; the body
  is copied from that line's first ``{``; later non-blank lines are kept
  with their original indentation until the brace depth returns to 0;
  lines starting with ```` ``` ```` are skipped even while capturing; braces
  inside strings or comments count; an unbalanced body is returned as read;
* otherwise the first line holding ``{``, ``}`` and the name gives the text
  from its first ``{`` to its last ``}``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passkit.functions.text import PY_SPACE, py_strip

# The code-fence lines the scanner recognises.
FENCE_OPEN = "```q"
FENCE = "```"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _sql(template: str, **names: str) -> F.Column:
    """Spark SQL text -> Column: one parse on the JVM instead of hundreds of py4j calls."""
    for k, v in names.items():
        template = template.replace("<" + k + ">", v)
    return F.expr(template)


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, r'^{PY_SPACE}+|{PY_SPACE}+\\z', '')"


def _count_sql(s: str, ch: str) -> str:
    return f"(length({s}) - length(replace({s}, '{ch}', '')))"


def _last_sql(s: str, ch: str) -> str:
    """1-based position of the last ``ch`` in ``s`` (0 when absent)."""
    return f"(CASE WHEN instr(reverse({s}), '{ch}') = 0 THEN 0 ELSE length({s}) - instr(reverse({s}), '{ch}') + 1 END)"


def _stripped_lines(lines: str) -> F.Column:
    return _sql(f"transform(<L>, x -> {_strip_sql('x')})", L=lines)


def _block_from(lines: str, st: str) -> F.Column:
    """First ```q block's content from line array ``lines`` and stripped lines ``st``."""
    opened = "CAST(array_position(<S>, '```q') AS INT)"
    close_rel = f"CAST(array_position(slice(<S>, {opened} + 1, greatest(size(<L>) - {opened}, 0)), '```') AS INT)"
    length = f"(CASE WHEN {close_rel} = 0 THEN size(<L>) - {opened} ELSE {close_rel} - 1 END)"
    body = (f"filter(slice(<L>, {opened} + 1, greatest({length}, 0)), "
            f"(l, j) -> element_at(<S>, {opened} + 1 + j) != '```q')")
    return _sql(f"CASE WHEN {opened} > 0 AND size({body}) > 0 THEN array_join({body}, '\\n') END", L=lines, S=st)


def _function_fold(lines: str, st: str, name: str) -> F.Column:
    """Fold over line numbers -> struct(cap, done, depth, start, end); start = 0 when nothing starts."""
    s = "element_at(<S>, i)"
    part = f"substring({s}, instr({s}, '{{'))"
    d0 = f"({_count_sql(part, '{')} - {_count_sql(part, '}')})"
    d1 = f"(acc.depth + {_count_sql(s, '{')} - {_count_sql(s, '}')})"
    return _sql(f"""aggregate(sequence(1, greatest(size(<L>), 1)),
        named_struct('cap', false, 'done', false, 'depth', 0, 'start', 0, 'end', 0),
        (acc, i) -> CASE
          WHEN acc.done OR (NOT acc.cap AND ({s} = '' OR startswith({s}, '//'))) OR startswith({s}, '```') THEN acc
          WHEN NOT acc.cap AND contains({s}, concat(<N>, ':')) AND instr({s}, '{{') > 0 THEN
            named_struct('cap', true, 'done', {d0} = 0, 'depth', {d0}, 'start', i,
                         'end', CASE WHEN {d0} = 0 THEN i ELSE 0 END)
          WHEN acc.cap AND {s} != '' THEN
            named_struct('cap', true, 'done', {d1} = 0, 'depth', {d1}, 'start', acc.start,
                         'end', CASE WHEN {d1} = 0 THEN i ELSE 0 END)
          ELSE acc END)""", L=lines, S=st, N=name)


def _parts_from(lines: str, st: str, fold: str, name: str) -> F.Column:
    """struct(body, how) from the fold's line numbers; ``fold`` is a column name."""
    start, end = "<FO>.start", "<FO>.end"
    last = f"(CASE WHEN {end} > 0 THEN {end} ELSE size(<L>) END)"
    first = f"element_at(<S>, greatest({start}, 1))"
    head = f"substring({first}, instr({first}, '{{'))"
    tail = (f"filter(slice(<L>, {start} + 1, greatest({last} - {start}, 0)), "
            f"(l, j) -> element_at(<S>, {start} + 1 + j) != '' AND NOT startswith(element_at(<S>, {start} + 1 + j), '```'))")
    # array_join keeps assembly linear in the body length (a concat fold would copy it per line)
    captured = f"concat({head}, CASE WHEN size({tail}) > 0 THEN concat('\\n', array_join({tail}, '\\n')) ELSE '' END)"
    cands = (f"filter(<S>, x -> instr(x, '{{') > 0 AND instr(x, '}}') > 0 AND contains(x, <N>) "
             f"AND {_last_sql('x', '}')} > instr(x, '{{'))")
    one = f"element_at({cands}, 1)"
    one_body = f"substring({one}, instr({one}, '{{'), {_last_sql(one, '}')} - instr({one}, '{{') + 1)"
    return _sql(f"""CASE WHEN {start} > 0 THEN named_struct('body', {captured}, 'how', 'braces')
                         WHEN size({cands}) > 0 THEN named_struct('body', {one_body}, 'how', 'oneliner')
                         ELSE named_struct('body', CAST(NULL AS STRING), 'how', CAST(NULL AS STRING)) END""",
                L=lines, S=st, FO=fold, N=name)


# The scanners reference their line arrays and the fold result many times;
# inlined, each reference would copy the whole fold into the expression tree.
# So every stage is its own column: Catalyst keeps non-trivial expressions
# in separate projections instead of duplicating them.

def _emit(t: DataFrame, fields: dict[str, F.Column]) -> DataFrame:
    """Add ``fields`` through a one-row generator (``inline`` of a 1-element array).

    A filter on a generator's output is not pushed below the generator, so
    a later ``where`` on an extracted column cannot copy the fold (and the
    line arrays it reads) into the filter condition.
    """
    tmp = {out: f"_xo_{i}" for i, out in enumerate(fields)}
    st = F.struct(*[c.alias(tmp[out]) for out, c in fields.items()])
    t = t.select("*", F.inline(F.array(st)))
    for out, name in tmp.items():
        t = t.withColumnRenamed(name, out)
    return t


def with_code_block(df: DataFrame, text: str, out: str = "code_block") -> DataFrame:
    """Add the first ```q block's content (NULL when none or empty)."""
    t = df.withColumn("_x_lines", _lines(F.col(text))).withColumn("_x_st", _stripped_lines("_x_lines"))
    return _emit(t, {out: _block_from("_x_lines", "_x_st")}).drop("_x_lines", "_x_st")


def with_function(df: DataFrame, text: str, name: str, out: str = "function", how: str | None = None,
                  prefix: str = "_xf") -> DataFrame:
    """Add the function body extracted from ``text`` for entry point ``name`` (NULL when none)."""
    L, S, FO, P = f"{prefix}_lines", f"{prefix}_st", f"{prefix}_fold", f"{prefix}_parts"
    q = lambda c: f"`{c}`"
    t = (df.withColumn(L, _lines(F.col(text)))
         .withColumn(S, _stripped_lines(q(L)))
         .withColumn(FO, _function_fold(q(L), q(S), q(name)))
         .withColumn(P, _parts_from(q(L), q(S), q(FO), q(name))))
    fields = {out: F.col(f"{P}.body")}
    if how:
        fields[how] = F.col(f"{P}.how")
    return _emit(t, fields).drop(L, S, FO, P)


def with_extracted(df: DataFrame, text: str, name: str, code: str = "code", path: str = "path") -> DataFrame:
    """Add ``code`` and ``path`` ('block' | 'full' | 'oneliner' | 'whole').

    Block first (a function found inside the first ```q block), then the
    whole text, else the stripped text itself.
    """
    t = with_code_block(df, text, "_x_block")
    t = t.withColumn("_x_block", F.when(F.coalesce(F.col("_x_block"), F.lit("")) != "", F.col("_x_block")))
    t = with_function(t, "_x_block", name, "_x_in_block", prefix="_xb")
    t = with_function(t, text, name, "_x_full", "_x_how", prefix="_xt")
    t = t.withColumn(code, F.coalesce(F.col("_x_in_block"), F.col("_x_full"), py_strip(F.coalesce(F.col(text), F.lit("")))))
    t = t.withColumn(path, F.when(F.col("_x_in_block").isNotNull(), F.lit("block"))
                     .when(F.col("_x_how") == "braces", F.lit("full"))
                     .when(F.col("_x_how") == "oneliner", F.lit("oneliner"))
                     .otherwise(F.lit("whole")))
    return t.drop("_x_block", "_x_in_block", "_x_full", "_x_how")


def with_solution_code(df: DataFrame, completion: str, name: str, code: str = "code", path: str = "path") -> DataFrame:
    """What the evaluator tests: blank completions pass through untouched, others are extracted."""
    t = with_extracted(df, completion, name, code, path)
    raw = F.coalesce(F.col(completion), F.lit(""))
    blank = py_strip(raw) == ""
    return (t.withColumn(code, F.when(blank, raw).otherwise(F.col(code)))
            .withColumn(path, F.when(blank, F.lit("blank")).otherwise(F.col(path))))
