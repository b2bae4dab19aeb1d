import pytest

from factloom.sources.csv import SurplusFields, _has_open_quote, scan_csv, unique_names


def read(spark, tmp_path, text, **options):
    path = tmp_path / "data.csv"
    path.write_text(text)
    return scan_csv(spark, str(path), **options)


def test_types_and_missing_values(spark, tmp_path):
    df = read(
        spark, tmp_path,
        "i,g,f,b,bn,s,d,e,big\n"
        "1,1,1.5,True,true,x,2020-01-01,,9223372036854775807\n"
        "-2,NA,2e3,False,,NULL,2020-01-02,,1\n"
        "3,,inf,True,false,1d,n/a,nan,2\n",
    )
    assert dict(df.dtypes) == {
        "i": "bigint", "g": "double", "f": "double", "b": "boolean", "bn": "string", "s": "string",
        "d": "string", "e": "double", "big": "bigint",
    }
    rows = df.orderBy("i").collect()
    assert [r["g"] for r in rows] == [None, 1.0, None]
    assert [r["s"] for r in rows] == [None, "x", "1d"]
    assert [r["b"] for r in rows] == [False, True, True]
    assert [r["f"] for r in rows] == [2000.0, 1.5, float("inf")]
    assert [r["e"] for r in rows] == [None, None, None]


def test_numbers_beyond_bigint(spark, tmp_path):
    df = read(
        spark, tmp_path,
        "long,unsigned,mixed,gap\n99999999999999999999,18446744073709551615,-1,18446744073709551615\n"
        "99999999999999999998,1,18446744073709551615,\n",
    )
    assert dict(df.dtypes) == {"long": "string", "unsigned": "decimal(20,0)", "mixed": "string", "gap": "string"}
    assert {r["long"] for r in df.collect()} == {"99999999999999999999", "99999999999999999998"}


def test_booleans_with_gaps_are_one_text_each(spark, tmp_path):
    rows = read(spark, tmp_path, "k,b\n1,true\n2,TRUE\n3,NA\n4,False\n5,false\n").orderBy("k").collect()
    assert [r["b"] for r in rows] == ["True", "True", None, "False", "False"]


def test_rows_with_more_fields_than_the_header_fail(spark, tmp_path):
    with pytest.raises(SurplusFields, match="2 rows"):
        read(spark, tmp_path, 'a,b\n1,2\n3,4,5\n6,7,\n')
    short = read(spark, tmp_path, 'a,b\n1,"x,y"\n3\n')
    assert [tuple(r) for r in short.orderBy("a").collect()] == [(1, "x,y"), (3, None)]


def test_inch_marks_do_not_stop_the_split(spark, tmp_path):
    path = tmp_path / "inch.csv"
    path.write_text('a,b\n5" pipe,1\n"a ""b"" c",2\n')
    assert not _has_open_quote(spark, str(path), ",")
    assert [r["a"] for r in scan_csv(spark, str(path)).orderBy("b").collect()] == ['5" pipe', 'a "b" c']
    path.write_text('a,b\nx,"two\nlines"\n')
    assert _has_open_quote(spark, str(path), ",")


def test_quotes_and_line_breaks_inside_fields(spark, tmp_path):
    df = read(spark, tmp_path, 'a,b\n"say ""hi"", you",1\n"two\nlines",2\n')
    assert [tuple(r) for r in df.orderBy("b").collect()] == [('say "hi", you', 1), ("two\nlines", 2)]


def test_repeated_headers(spark, tmp_path):
    df = read(spark, tmp_path, "x,y,x,x.1\n1,2,3,4\n")
    assert df.columns == ["x", "y", "x.2", "x.1"]
    assert tuple(df.first()) == (1, 2, 3, 4)


@pytest.mark.parametrize(
    "names, expected",
    [(["a", "a", "a"], ["a", "a.1", "a.2"]), (["a", "b"], ["a", "b"]), (["a", "a", "a.1"], ["a", "a.2", "a.1"])],
)
def test_unique_names(names, expected):
    assert unique_names(names) == expected


def test_other_separator(spark, tmp_path):
    assert tuple(read(spark, tmp_path, "a;b\n1;x,y\n", separator=";").first()) == (1, "x,y")


def test_header_without_a_name(spark, tmp_path):
    assert read(spark, tmp_path, ',b\n1,2\n').columns == ["Unnamed: 0", "b"]


def test_scan_order_defines_the_first_rows(spark, tmp_path):
    """Without an order the first 20 rows of the file decide about derived columns."""
    from factloom import Workspace

    good = "".join(f"{a},{b},{a}-{b}\n" for a, b in zip("ab" * 10, "xy" * 10))
    bad = "".join("a,x,zz\n" for _ in range(40))
    for name, body, expected in (("early", good + bad, True), ("late", bad + good, False)):
        (tmp_path / f"{name}.csv").write_text("first,second,joined\n" + body)
        space = Workspace(spark, str(tmp_path / "space"))
        space.process(space.register(str(tmp_path / f"{name}.csv"), "csv", dataset_id=name))
        flags = {r["name"]: r["is_derived"] for r in space.schema(name).collect()}
        assert flags == {"first": False, "second": False, "joined": expected}
