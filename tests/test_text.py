import itertools

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verdigraph.functions import rewrite as W
from verdigraph.functions import text as X


def values(spark, rows, expression, schema="s string"):
    df = spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema)
    return [r[0] for r in df.select(expression).collect()]


def without_comments(code):
    """Straight-line model: five states."""
    out, i, state = [], 0, "code"
    while i < len(code):
        two = code[i : i + 2]
        if state == "code" and two in ("//", "/*"):
            state, i = ("line" if two == "//" else "block"), i + 2
        elif state == "block" and two == "*/":
            out.append(" ")
            state, i = "code", i + 2
        elif state in '"\'' and code[i] == "\\" and i + 1 < len(code):
            out.append(two)
            i += 2
        else:
            c = code[i]
            if state not in ("line", "block") or c == "\n":
                out.append(c)
            if state == "code" and c in "\"'":
                state = c
            elif state == c or state == "line" and c == "\n":
                state = "code"
            i += 1
    return "".join(out)


def test_strip_comments_small_alphabet(spark):
    codes = ["".join(p) for n in range(6) for p in itertools.product("/*\"'\\\na", repeat=n)]
    assert values(spark, codes, X.strip_comments(F.col("s"))) == [without_comments(c) for c in codes]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet='/*"\'\\\nab é;{}', max_size=60), min_size=20, max_size=40))
def test_strip_comments_random(spark, codes):
    assert values(spark, codes, X.strip_comments(F.col("s"))) == [without_comments(c) for c in codes]


def test_labels(spark):
    told = {
        '{"label": "tp"}': "TP", '{"label": "FP", "x": 1}': "FP", '{"label": " TP"}': None, '{"label": 3}': None, '{"label": null}': None, '{"label": null} ': None,
        '{"other": 1} "label": "fp"': "FP", '{"other": 1}': None, '[{"label": "FP"}]': "FP", '```json\n{"label": "UNKNOWN"}\n```': "UNKNOWN", '{"label": "TP"': "TP",
        "plain": None, "": None, None: None, "{'label': 'TP'}": None, '{"label": "maybe", "x": "\\"label\\": \\"TP\\""}': None,
    }
    assert values(spark, list(told), X.extract_label(F.col("s"))) == list(told.values())


def test_white_space_of_any_kind(spark):
    assert values(spark, ["  a b\x85 ", "\t\n"], X.strip(F.col("s"))) == ["a b", ""]


def test_numbered_lines(spark):
    text = "\n".join("abcdefghij")
    got = values(spark, ["a", "a\n", "", "a\n\nb", text], X.number_lines(F.col("s")))
    assert got == ["L1: a", "L1: a", "", "L1: a\nL2: \nL3: b", "\n".join(f"L{i:02d}: {c}" for i, c in enumerate("abcdefghij", 1))]


def test_path_variants(spark):
    got = values(spark, ["../a/b.c", ".x.c", "d\\e.c"], X.path_variants(F.col("s")))
    assert got == [["../a/b.c", "a/b.c", "b.c"], [".x.c", "x.c"], ["d/e.c", "e.c"]]
    assert values(spark, ["./a.c"], X.path_variants(F.col("s"), F.lit("/r/"))) == [["./a.c", "a.c", "/r/a.c", "r/a.c"]]


def test_signature_text(spark):
    df = spark.sql("""SELECT named_struct('ftype', 'func', 'name', n, 'return_type', 'void', 'is_static', b, 'param_types', p) AS s FROM VALUES
        ('f', false, array('char*')), ('it''s', true, array()), ('a''b"c', true, array('int', 'x')) AS t(n, b, p)""")
    assert [r[0] for r in df.select(X.signature_text(F.col("s"))).collect()] == [
        repr(("func", "f", "void", False, ("char*",))), repr(("func", "it's", "void", True, ())), repr(("func", "a'b\"c", "void", True, ("int", "x"))),
    ]


def test_names(spark):
    df = spark.createDataFrame([("a b/c", "0123456789abcdef"), ("p", None), ("p", "")], "p string, c string")
    assert [r[0] for r in df.select(X.checkout_key(F.col("p"), F.col("c"))).collect()] == ["a_b_c__0123456789ab", "p", "p"]
    assert values(spark, ["x:1"], X.report_name(F.lit("m/1"), F.col("s"))) == ["m_1/x__1.json"]
    assert values(spark, ["http://h/a.TAR.gz/", "http://h/a.git"], X.is_tarball(F.col("s"))) == [True, False]
    assert values(spark, ["a/b/c.c", "c.c"], X.parent_name(F.col("s"))) == ["b", ""]
    assert values(spark, [" const   char\t* "], X.normalize_type(F.col("s"))) == ["const char *"]
    assert values(spark, [" **&p", "p"], X.pointer_prefix(F.col("s"))) == ["**&", ""]


def test_bug_types_and_lines(spark):
    df = spark.createDataFrame([([" a ", "", "b"],), ([" "],), (None,)], "b array<string>")
    assert [r[0] for r in df.select(X.bug_type(F.col("b"))).collect()] == ["a, b", "unknown", "unknown"]
    assert values(spark, ["\n x \n", " ", None], X.warning_line(F.col("s"), F.lit("second"))) == [" x ", "second", "second"]


def test_function_section_keeps_ordinals(spark):
    df = spark.createDataFrame([([" ", "a\nb ", None, "c"],), ([],), ([" "],)], "b array<string>")
    assert [r[0] for r in df.select(X.function_section(F.col("b"))).collect()] == ["// Enclosing function body 2\nL1: a\nL2: b\n\n// Enclosing function body 4\nL1: c", None, None]


def test_tokens_and_rate_limits(spark):
    df = spark.createDataFrame([("abcd", "efgh"), ("", "")], "a string, b string")
    assert [r[0] for r in df.select(X.estimated_tokens(F.col("a"), F.col("b"))).collect()] == [2, 1]
    assert values(spark, ["RateLimitError: x", "HTTP 429", "x429"], X.is_rate_limit(F.col("s"))) == [True, True, False]


def test_rewrites():
    assert W.is_nested("f({a}(b))") and not W.is_nested("(}") and not W.is_nested("(")
    assert W.statements_from('a; __asm__("x(" ); b', "__asm__")[0].startswith("__asm__(")
    assert W.statements_like("({a}) ({b)", r"\(\{.*?\)") == ["({a})"]
    assert W.without_call("int f(void) __attribute__((x(1))) ;", "__attribute__") == "int f(void)  ;"
    assert W.joined_literals('a("x" \n "y", \'"\', "z")') == 'a("xy"\n, \'"\', "z")'
    assert W.code_parts('a; b("; "); // c;\n#d;\ne') == ["a;", ' b("; ");', " // c;", "\n#d;", "\ne"]
    assert W.plain_c('f("a" "b") __attribute__((x));') == 'f("ab") ;'
    assert W.insert_before("a;\nb\nc", "c", "N") == "a;\nN\nb\nc"
    text, defines, n = W.replaced_statements("a;\nx(1,\n2);\n", ["x(1,\n2)"])
    assert text == "a;\n#define statement_0_replacement x(1,\\\n2)\nstatement_0_replacement\n;\n" and not defines and n == 1
    assert W.without_asm("__asm__(a);\n") == "#define statement_0_replacement __asm__(a)\nstatement_0_replacement;\n"
    assert W.blanked_ranges("abc\ndef\nghi\n", [((0, 1), (1, 1))], False) == "a    ef\nghi\n".replace("a    ef", "a   " + " ef")
    assert W.blanked_ranges("abc\n\nd\n", [((0, 0), (0, 3))]) == "d\n"
    assert W.marked("a\nb\nc", 1).split("\n") == ["// clang-format off", "/*target_line*/a", "// clang-format on", "b", "c"]
    assert W.with_suffix("a/b.c", ".o") == "a/b.o" and W.file_stem("a/b.c") == "b"


def test_rewrite_column(spark):
    assert values(spark, ["a; b", None], W.column(W.plain_c)(F.col("s"))) == ["a; b", None]
