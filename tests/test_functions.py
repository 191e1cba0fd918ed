import pytest
from pyspark.sql import functions as F

from weftwork.functions import paths, patterns

#: Patterns, paths and results that every engine of these patterns has to agree on, as are
#: those of EXTRACT and NORMAL.
MATCH = [
    (True, "//*.c", "foo/bar/baz.c"), (True, "**/*.c", "foo/bar/baz.c"), (True, "*.c", "baz.c"), (False, "*.c", "foor/bar.c"), (False, "*/*.c", "foo/bar/baz.c"),
    (False, "foo//bar", "foobar"), (False, "foo/**/bar", "foobar/bar"), (True, "foo//bar", "foo/bar"), (True, "//*", "/bar"), (False, "**/*", "/bar"),
    (True, "/bob//foo", "/bob/this/test/foo"), (False, "/bob/**/foo", "bob/this/test/foo"), (True, "bob//foo/", "bob/this/test/foo/"), (False, "bob//foo/", "bob/this/test/foo"),
    (True, "a//", "a"), (True, "///a//", "/a"), (False, "**/a/**", "/a"), (False, "///", ""), (True, "///", "/"), (True, "/**", "/"), (True, "**/", "a/"), (True, "////", ""), (True, "**/**", ""),
    (True, "x///y", "x/y"), (False, "x///", "x"), (True, "x///", "x/foo/"), (False, "x/**/", "x/foo/bar"), (True, "x/**/*/y", "x/z/y"), (True, "", ""), (False, "", "y"), (False, "", "/"),
    (True, "*/*", "x/y"), (False, "*/*", "x"), (True, "//*", ""), (True, "*//", ""), (False, "*//*", "x"), (False, "*//*//*", "x/y"), (True, "//*/", "/"), (False, "**/*/", "/"), (True, "*/////", "/"),
    (False, "b*b*b*//", "bb"), (False, "**", "/"), (True, "**", "x/"), (True, "**", "C:drive"), (True, "./file", "file"), (True, "foo/./bar", "foo/bar"), (True, "foo/./bar", "foo/./bar"), (False, "foo/./bar", "foo/bob"),
]
EXTRACT = [
    ("//*a.txt", "foo/bar/testa.txt", ["foo/bar/", "test"]), ("**/*a.txt", "testa.txt", ["", "test"]), ("//a.txt", "/a.txt", ["/"]), ("a//b", "a/b", [""]), ("a///b", "a/x/y/b", ["x/y/"]),
    ("a/**/**/b", "a/x/y/b", ["", "x/y/"]), ("//*a*.txt", "testada.txt", ["", "test", "da"]), ("**/*.c", "test.txt", None), ("**/*.c", "bar/baz/foo.c", ["bar/baz/", "foo"]),
]
NORMAL = {
    "": ".", ".": ".", "/": "/", "./": "./", "/.": "/.", "/./": "/", "a/.": "a", "./a": "a", "./a/.": "a", "./a/./": "a/", "a/..": ".", "a/./..": ".", "a/../": "./", "/a/../": "/", "/a/./../": "/",
    "../a": "../a", "/../a/": "/../a/", "pat//./test/moo/../bar/bob/../foo": "pat/test/bar/foo", "bar/foo/": "bar/foo/", "../../foo": "../../foo", "foo/../..///": "../", "foo/bar/../../pat": "pat",
    "foo/../bar/../pat": "pat", "/foo/bar": "/foo/bar", "//./": "/", "//foo/./bar": "/foo/bar",
}


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_match(spark):
    got = spark.range(1).select(*[patterns.matches(p, F.lit(x)).alias(f"c{i}") for i, (_, p, x) in enumerate(MATCH)]).first()
    assert [(p, x, g) for (_, p, x), g in zip(MATCH, got)] == [(p, x, w) for w, p, x in MATCH]


@pytest.mark.parametrize("pattern,path,want", EXTRACT)
def test_extract(spark, pattern, path, want):
    assert one(spark, patterns.captures(pattern, F.lit(path))) == want
    if want:
        assert one(spark, patterns.substitute([F.lit(x) for x in want], pattern)) == path


def test_shapes():
    assert patterns.simple("/a/b/cccc_") and not patterns.simple("a*b") and not patterns.simple("a//b")
    assert patterns.compatible([]) and patterns.compatible(["//*a.txt", "foo/**/a*.txt"]) and not patterns.compatible(["//*a.txt", "foo//a*.*txt"])


def test_normalise(spark):
    rows = spark.createDataFrame(list(NORMAL.items()), "p string, want string")
    assert {r.p: r.got for r in rows.select("p", paths.normalise(F.col("p")).alias("got")).collect()} == NORMAL


def test_text(spark):
    assert one(spark, paths.show_time(F.lit(1.5))) == "1.50s" and one(spark, paths.show_time(F.lit(62.0))) == "1m02s" and one(spark, paths.show_time(F.lit(3720.0))) == "1h02m"
    assert one(spark, paths.uri_parameters(F.lit("?a=1&b=%20x&a=2"))) == {"a": "2", "b": " x"}


def test_relative_paths(spark):
    rows = [("/x/y/", "/x/y/z", "z"), ("/w/c", "../b/file.out", "../b/file.out"), ("a", "b/file.out", "b/file.out"), ("/w/a", "/w/b/file.out", "../b/file.out"), ("/", "/a/b", "a/b"), ("/a/b", "/", "../.."), ("/a/b", "/a/b", "."), ("a", "/b", None), ("/a/./b/../c", "/a//d", "../d")]
    frame = spark.createDataFrame(rows, "base string, path string, want string")
    got = frame.select("want", paths.make_relative(F.col("base"), F.col("path")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_shown_numbers(spark):
    show = lambda f, x: one(spark, f(F.lit(x)))
    assert [show(paths.show_percent, x) for x in (0.5, 0.12345, 1.0)] == ["50.00%", "12.35%", "100.00%"]
    assert [show(paths.show_int, x) for x in (0, 999, 1000, 1234567)] == ["0", "999", "1,000", "1,234,567"]
    assert [show(paths.show_run, x) for x in (0, 1, 2)] == ["Latest run", "1 run ago", "2 runs ago"]
    assert [show(paths.show_duration_secs, x) for x in (0.4, 4.6, 2.5, 65.2, 3720.0)] == ["0s", "5s", "2s", "1m05s", "1h02m"]
    assert show(paths.trim, " \t a b\n") == "a b"


def test_abbreviations(spark):
    short = [("ab", "1"), ("abc", "2"), ("bc", "3"), ("", "x"), ("ab", "9"), ("c.d*", "4"), ("1", "ab")]
    show = lambda x: one(spark, paths.abbreviate(F.lit(x), short))
    assert [show(x) for x in ("abcab", "aab", "c.d*c.dd", "", "b1a", "\nab\n")] == ["21", "a1", "4c.dd", "", "baba", "\n1\n"]
    assert one(spark, paths.abbreviate(F.lit("ab"), [])) == "ab"
