from __future__ import annotations

import re

import random

import pytest
from pyspark.sql import functions as F

from codelabels.functions import paths, text, values

NEL, NBSP, PS = chr(0x85), chr(0xA0), chr(0x2029)
E_ACUTE, SQUARED, COMBINING = chr(0xE9), chr(0xB2), chr(0x301)

GOLDEN = {
    text.remove_imports: [
        ("import a.b;\nx", "\nx"),
        ('s = "import q;";', 's = "";'),
        ("import a\n.b;", "import a\n.b;"),
        ("reimport a; y", "re y"),
    ],
    text.remove_packages: [("package p;x", "x"), ("package\tp;", "package\tp;")],
    text.clean: [("import package x;", ""), ("package import x;", "package ")],
    (lambda c: text.clean(c, packages_first=True)): [("import package x;", "import "), ("package import x;", "")],
    text.remove_comments: [
        ("a; // b\nc", "a; \nc"),
        ("a; // b\r\nc", "a; // b\r\nc"),
        ("a; // b", "a; "),
        ("x /* 1\n2 */ y", "x  y"),
        ('"// no" // yes\n', '"// no" \n'),
        ("'\"' // q\n\"", "'\"' \n\""),
        ('"open\n// kept" z', '"open\n// kept" z'),
        ('"open // gone\nx', '"open \nx'),
        ("/* never closed", "/* never closed"),
        ("'/*' a '*/'", "'/*' a '*/'"),
    ],
    text.remove_blank_lines: [
        ("a \n\n b\t\n", "a\n b"),
        ("\r\n a\r\nb\rc", " a\nb\nc"),
        (f"a{NEL}b{PS}c\x0bd\x1ce", "a\nb\nc\nd\ne"),
        (f"{NBSP}\n x{NBSP}", " x"),
        ("", ""),
        ("   ", ""),
    ],
    text.replace_strings: [
        ('"a" + \'b\'', "<$STRING> + <$STRING>"),
        ('"""x"""', "<$STRING>"),
        ('"a\nb"', '"a\nb"'),
        ("\"it's\"", "<$STRING>"),
        ("no", "no"),
    ],
    text.replace_numbers: [
        ("f(1.5f,-2,3e5,0x1F,10L,a-1)", "f(<$NUMBER>.5f,<$NUMBER>,<$NUMBER>,0x1F,10L,a-<$NUMBER>)"),
        ("x = -1.5e-3;", "x = <$NUMBER>;"),
        ("1 2 3", "<$NUMBER> <$NUMBER> <$NUMBER>"),
        (f"{E_ACUTE}1 {SQUARED}2 4{SQUARED}", f"{E_ACUTE}1 {SQUARED}2 4{SQUARED}"),
        (f"3{COMBINING}", f"<$NUMBER>{COMBINING}"),
        ("v1_2", "v1_2"),
    ],
    text.replace_booleans: [
        ("TRUE untrue false_ False", "<$BOOLEAN> untrue false_ <$BOOLEAN>"),
        (f"{E_ACUTE}true", f"{E_ACUTE}true"),
    ],
    text.normalise: [("a = 1;\n\n  b = \"x\"; \ntrue", "a = <$NUMBER>;\n  b = <$STRING>;\n<$BOOLEAN>")],
    text.token_text: [("a.b($c, 1)", "a b $c $NUMBER")],
    (lambda c: F.array_join(text.tokenize(c), "|")): [("a_b$ + c1-2", "a_b$|c1|2"), ("", "")],
    (lambda c: F.array_join(text.significant_lines(c), "|")): [
        ("a\n{\n } \n\n  b {\n\t\r\nc\r", "a|  b {|c\r"),
        ("{}\n}", "{}"),
        (f"{NBSP}{{{NEL}\nx", "x"),
    ],
    text.strip: [(f" \t{NBSP}a b{NEL}\x1f", "a b")],
}


@pytest.mark.parametrize("number", range(len(GOLDEN)))
def test_text_cases(apply, number):
    make, cases = list(GOLDEN.items())[number]
    assert apply(make, [given for given, _ in cases]) == [wanted for _, wanted in cases]


def test_strip_agrees_for_every_blank(apply):
    chars = [chr(i) for i in range(1, 0xD7FF) if not chr(i).isalnum()]
    assert apply(text.strip, [f"{c}x{c}" for c in chars]) == [f"{c}x{c}".strip() for c in chars]


def test_line_functions_follow_splitlines(apply):
    rng = random.Random(7)
    alphabet = ["a", "b ", "\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1e", NEL, PS, " "]
    items = ["".join(rng.choices(alphabet, k=rng.randrange(12))) for _ in range(400)]
    assert apply(text.line_count, items) == [len(s.splitlines()) for s in items]
    assert apply(text.all_line_numbers, items) == [list(range(1, len(s.splitlines()) + 1)) for s in items]
    kept = [[x.rstrip() for x in s.splitlines() if x.strip()] for s in items]
    assert apply(text.remove_blank_lines, items) == ["\n".join(x) for x in kept]


def test_normalising_lines_equals_normalising_the_window(apply):
    rng = random.Random(11)
    parts = ['"', "'", "1", "-2.5", "true", " ", "x", "\r", "\x0b", "é", "// c", "=", "\t", '"""']
    files = ["\n".join("y" + "".join(rng.choices(parts, k=8)) for _ in range(5)) for _ in range(200)]
    lines = apply(lambda c: F.array_join(text.normalise_lines(F.split(c, "\n")), "\n"), files)
    assert lines == apply(text.normalise, files)


def test_paths(apply):
    sha = F.lit("abcdef0123456")
    key = lambda c: paths.file_key(c, sha)
    assert apply(key, ["a/b.java", "a_b.java", "x.y/C.d.java", ".java", "q/.java"]) == [
        "a_b_abcdef0.java", "a_b_abcdef0.java", "x-y_C-d_abcdef0.java", "_abcdef0", "q__abcdef0",
    ]
    urls = ["https://h/o/r.git", "https://h/o/r/", "https://h/x.github.io", "r"]
    assert apply(paths.repository_name, urls) == ["r", "", "xhub.io", "r"]
    assert apply(paths.stem, ["/t/a.b.java", "plain", "/t/.java"]) == ["a", "plain", ""]
    assert apply(paths.path_fits, ["x" * 250, "x" * 251]) == [True, False]
    assert apply(paths.has_type, ["a.java", "a.JAVA", "ajava", ".java"]) == [True, False, False, True]


def test_relevant_path(spark):
    rows = spark.createDataFrame([("a", "b"), ("a", ""), ("a", None)], "x string, y string")
    out = rows.select(paths.relevant_path(F.col("x"), F.col("y")).alias("p")).collect()
    assert [r["p"] for r in out] == ["b", "a", "a"]


def test_times_and_figures(spark, apply):
    stamps = ["2024-01-02 03:04:05", "2024-01-02 03:04:05.25", None]
    iso = apply(lambda c: values.iso(c.cast("timestamp_ntz")), stamps)
    assert iso == ["2024-01-02T03:04:05", "2024-01-02T03:04:05.250000", None]
    assert apply(lambda c: values.iso_or_none(c.cast("timestamp_ntz")), stamps)[2] == "None"
    back = apply(lambda c: values.from_iso(c), iso)
    assert [b and b.isoformat() for b in back] == iso
    moments = [0, 1700000000, 1730613600]
    assert [str(t) for t in apply(values.from_epoch, moments, "bigint")][:2] == ["1970-01-01 00:00:00", "2023-11-14 22:13:20"]
    east = apply(lambda c: values.from_epoch(c, "America/New_York"), moments, "bigint")
    assert str(east[2]) == "2024-11-03 01:00:00"
    done = spark.range(1, 101).select(values.progress(F.col("id"), F.lit(100)).alias("p")).collect()
    assert [r["p"] for r in done] == [int(k / 100 * 100) for k in range(1, 101)]
    assert done[28]["p"] == 28 and done[56]["p"] == 56 and done[57]["p"] == 57


def test_times_do_not_depend_on_the_session_zone(spark, apply):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        stamps = ["2024-03-10 02:30:00", "2024-11-03 01:30:00.000007"]
        ntz = lambda make: (lambda c: make(c.cast("timestamp_ntz")))
        assert apply(ntz(values.iso), stamps) == ["2024-03-10T02:30:00", "2024-11-03T01:30:00.000007"]
        assert apply(ntz(values.plain_time), stamps)[0] == "2024-03-10 02:30:00"
        assert str(apply(values.from_epoch, [1710037800], "bigint")[0]) == "2024-03-10 02:30:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_threshold_is_strict(apply):
    assert apply(lambda c: values.decide(c), [[0.0, 1e-9, -1.0, 40.0, -800.0]], "array<double>") == [[0, 1, 0, 1, 0]]


def test_maps(apply):
    texts = ['{"K1":1,"K2":0}', "{}", None]
    assert apply(lambda c: values.encode_map(values.decode_map(c)), texts) == texts


def test_short_classes_take_in_the_same_characters(apply):
    """Java's own classes stand for the spelled-out ones: every character up to U+30FF, beside Python's ranges."""
    from codelabels.operators.scoring import token_initials

    points = [p for p in range(1, 0x3100)]
    assert text.JAVA_TOKENS == r"[\w$]+"
    texts = [f"Ab {chr(p)}c{chr(p)}{chr(p)} d" for p in points]
    assert apply(text.tokenize, texts) == [re.findall(text.TOKENS, t) for t in texts]
    firsts = ["".join(w[0] for w in re.findall(text.TOKENS, t)).lower() for t in texts]
    assert apply(token_initials, texts) == firsts
    breaks = {0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x85, 0x2028, 0x2029}
    assert [len(x) for x in apply(text.split_lines, [f"a{chr(p)}b" for p in points])] == [2 if p in breaks else 1 for p in points]


def test_tokens_by_what_lies_between(apply):
    items = ["", " ", "a", " a  b\n", "é_1$x-y", "(a.b)c", None, "\u0661a", "--"]
    assert apply(text.token_words, items) == apply(lambda c: text.join_words(text.tokenize(c)), items)


def test_lines_normalised_as_one_text(spark):
    """A file's lines together give what each gives alone, whatever ends or breaks them."""
    bits = ["a", "true", "FALSE", "-2.5e3", "0x1F", "7", "'", '"', '"""', " ", "\t", "\r", "\x85", "\x0b", "\u2028", "{", "}", "\u0301", "é"]
    rng = random.Random(11)
    texts = ["\n".join("".join(rng.choice(bits[: rng.choice((10, 12, 19))]) for _ in range(rng.randrange(9))) for _ in range(rng.randrange(6))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in [*texts, "", "x\r\ny\r\n", None]], "c string").select(text.significant_lines(F.col("c")).alias("l"))
    found = rows.select(F.transform("l", text.normalise).alias("alone"), text.normalise_lines(F.col("l")).alias("whole")).collect()
    assert all(r["alone"] == r["whole"] for r in found)


def test_lines_are_bound_once(spark):
    """The clean-up before is one expression of the plan, however often its lines are looked at."""
    frame = spark.createDataFrame([("x",)], "c string").select(text.normalise_lines(text.significant_lines(text.clean(F.col("c")))).alias("l"))
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("import ") == 1
