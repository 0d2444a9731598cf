"""Extraction goldens: every answer shape plus the scanner's edge rules."""

import pytest

from passkit.functions.extraction import with_code_block, with_extracted, with_function, with_solution_code

CASES = [
    ("```q\nspread:{[v]\n  (max v)-min v\n }\n```\nThe range of a vector.", "spread", "{[v]\n  (max v)-min v\n }"),
    ("One way to write `spread`:\n\n```q\nspread:{[v]\n  (max v)-min v\n }\n```\n\nIt needs one pass for each bound.",
     "spread", "{[v]\n  (max v)-min v\n }"),
    ("twice:{2*x}", "twice", "{2*x}"),
    ("Without a fence:\n\nclip:{[lo;hi;v]\n    v:lo|v;\n    hi&v\n}\n\nBoth bounds are kept.", "clip",
     "{[lo;hi;v]\n    v:lo|v;\n    hi&v\n}"),
    ("No code here, only words.", "absent", "No code here, only words."),
    # edge rules
    ("text\nfoo:{[x]\n  a:1;\n\n  // c\n  ```\n  x+a\n }\nafter", "foo", "{[x]\n  a:1;\n  // c\n  x+a\n }"),
    ("call foo{x+1} now", "foo", "{x+1}"),
    ("```q\n```\nfoo:{x}", "foo", "{x}"),  # empty first block counts as none
    ("```q\nbar:{x}\n```\nfoo:{[x]\n x\n", "foo", "{[x]\n x"),  # unbalanced: what was read
    ("barfoo:{1}", "foo", "{1}"),  # 'name:' is a substring test
    ("foo: no brace here\nfoo:{2}", "foo", "{2}"),  # a name line without a brace does not start
    ("// foo:{3}\nfoo:{4}", "foo", "{4}"),  # comment lines are skipped before capture
    ("```Q\nfoo:{5}\n```", "foo", "{5}"),  # fence tag is case-sensitive: found in full text
    ("  \u00a0padded text\u00a0  ", "foo", "padded text"),  # Python strip removes NBSP
    ("}{foo\nfoo{6}", "foo", "{6}"),  # one-liner needs last } after first {
]


@pytest.mark.parametrize("text,name,want", CASES)
def test_extract_code(spark, text, name, want):
    df = spark.createDataFrame([(text, name)], "t string, n string")
    got = with_extracted(df, "t", "n").first().code
    assert got == want


def test_paths_and_blocks(spark):
    rows = [("```q\nf:{1}\n```", "f"), ("f:{1}", "f"), ("x f{1} y", "f"), ("plain", "f"), ("", "f"), ("  ", "f")]
    df = spark.createDataFrame(rows, "t string, n string")
    out = with_solution_code(with_function(with_code_block(df, "t", "b"), "t", "n", "fn", "how"), "t", "n")
    got = [(r.path, r.b, r.code) for r in out.collect()]
    assert got == [("block", "f:{1}", "{1}"), ("full", None, "{1}"), ("oneliner", None, "{1}"),
                   ("whole", None, "plain"), ("blank", None, ""), ("blank", None, "  ")]
