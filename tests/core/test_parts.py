"""Script text, expressions, data files, history parsing, streams, command line."""

import datetime as dt

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from statloom.cli import compile_script, main
from statloom.corpus import history
from statloom.errors import CommandError
from statloom.plans.expressions import Scope, to_sql
from statloom.plans.script import logical_lines, parse, unrolled
from statloom.sources import dta
from statloom.streaming import pipeline


def test_lines():
    assert logical_lines('use "http://x//y" // c\n* gone\nkeep ///\n a b;\n/* x\n y */ drop c') == ['use "http://x//y"', "keep   a b", "drop c"]


def test_loops_and_macros():
    script = """local k 2
foreach v in a b {
forvalues i = 1/`k' {
generate `v'`i' = `v' + `i'
}
}
forvalues i = 9(-3)3 {
drop x`i'
}
keep `k'"""
    assert list(unrolled(logical_lines(script))) == ["generate a1 = a + 1", "generate a2 = a + 2", "generate b1 = b + 1", "generate b2 = b + 2", "drop x9", "drop x6", "drop x3", "keep 2"]
    with pytest.raises(CommandError, match="closing"):
        list(unrolled(["foreach v in a {", "drop `v'"]))


def test_commands():
    c = parse('merge m:1 a b using "f.csv", keep(match master) nogen')
    assert (c.verb, c.options, c.names()[-1]) == ("merge", {"keep": "match master", "nogen": None}, "f.csv")
    c = parse('bysort g h (t): generate x = cond(a, ",if", b) if z == "a, if b"')
    assert (c.by, c.by_sort, c.cond, c.head) == (("g", "h"), ("t",), 'z == "a, if b"', 'x = cond(a, ",if", b)')
    with pytest.raises(CommandError, match="not a command"):
        parse("select 1")
    with pytest.raises(CommandError, match="unmatched"):
        parse("generate x = (1")


SCOPE = {"a": "bigint", "b": "bigint", "s": "string"}


@pytest.mark.parametrize("text,sql", [
    ("a + b * 2", "(`a` + (`b` * 2))"),
    ("a == 1 & !(b > 2) | s != \"x\"", "(((`a` = 1) AND (NOT ((`b` > 2)))) OR (`s` <> 'x'))"),
    ("missing(a, b)", "(`a` IS NULL OR `b` IS NULL)"),
    ("cond(missing(a), cond(b > 1, 1, 2), 3)", "(CASE WHEN (`a` IS NULL) THEN (CASE WHEN (`b` > 1) THEN 1 ELSE 2 END) ELSE 3 END)"),
    ("a NOT IN (1, 2)", "(`a` NOT IN (1, 2))"),
    ("a / b % 2 ^ 2", "try_mod(try_divide(`a`, `b`), pow(2, 2))"),
    ("s LIKE \"it's\"", "(`s` LIKE 'it\\'s')"),
    (".", "NULL"),
])
def test_expressions(text, sql):
    assert to_sql(text, Scope(dict(SCOPE))) == sql


@pytest.mark.parametrize("text", ["a +", "cond(a, b)", "inrange(a, 1)", "nothing", "a b", "L.a", "inlist(a)", "a[b]"])
def test_bad_expressions(text):
    with pytest.raises(CommandError):
        to_sql(text, Scope(dict(SCOPE)))


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.sampled_from(["1", "2", "3", "7"]), lambda x: st.tuples(x, st.sampled_from("+-*"), x).map(lambda t: f"({t[0]} {t[1]} {t[2]})"), max_leaves=8))
def test_arithmetic_keeps_its_value(text):
    assert eval(to_sql(text, Scope({}))) == eval(text)


@pytest.mark.parametrize("version", [117, 118, 119])
def test_dta_read(spark, tmp_path, version):
    path = f"{tmp_path}/a.dta"
    data = pd.DataFrame({"id": [1, 2, 3], "name": ["Acme", "Bé ta", ""], "v": [1.5, None, 3.0], "d": [dt.datetime(2020, 1, 2), None, dt.datetime(1959, 12, 31)], "txt": ["x" * 3000, "", "y"]})
    data.to_stata(path, version=version, write_index=False, variable_labels={"v": "A value"}, convert_dates={"d": "td"}, convert_strl=["txt"])
    got = dta.read(spark, path)
    rows = got.orderBy("id").collect()
    assert [r["name"] for r in rows] == ["Acme", "Bé ta", ""] and [r["v"] for r in rows] == [1.5, None, 3.0]
    assert [r["d"] for r in rows] == [dt.date(2020, 1, 2), None, dt.date(1959, 12, 31)]
    assert [len(r["txt"]) for r in rows] == [3000, 0, 1]
    assert got.schema["v"].metadata == {"label": "A value"}


def test_dta_write_and_value_labels(spark, tmp_path):
    path = f"{tmp_path}/b.dta"
    df = spark.createDataFrame([(1, "a", 2.5, True, dt.date(2021, 5, 6), "z" * 2500), (None, None, None, None, None, None)], "i int, s string, x double, b boolean, d date, t string")
    dta.write(df, path, {"x": "An x"})
    back = pd.read_stata(path)
    assert back["x"].tolist()[0] == 2.5 and back["s"].tolist() == ["a", ""] and len(back["t"][0]) == 2500
    assert pd.io.stata.StataReader(path).variable_labels()["x"] == "An x"
    again = dta.read(spark, path).collect()
    assert again[0]["d"] == dt.date(2021, 5, 6) and again[1]["i"] is None
    labelled = pd.DataFrame({"k": pd.Categorical(["low", "high", "low"])})
    labelled.to_stata(f"{tmp_path}/c.dta", version=118, write_index=False)
    assert sorted(set(dta.value_labels(f"{tmp_path}/c.dta")["k"].values())) == ["high", "low"]
    assert [r["k"] for r in dta.read(spark, f"{tmp_path}/c.dta", with_value_labels=True).collect()] == ["low", "high", "low"]


def test_dta_keeps_labels_order_and_strings(spark, tmp_path, monkeypatch):
    from statloom.session import Session

    monkeypatch.setattr(dta, "RANGE", 40)
    rows = [(i, i % 3, "s" * (i % 9), None if i % 5 == 0 else f"é{i}" * (1000 if i % 4 == 0 else 1), i / 7, dt.date(1950 + i, 1, 2), dt.datetime(1955, 3, 4, 5, 6, i % 60), i % 2 == 0) for i in range(150)]
    spark.createDataFrame(rows, "id int, k int, s string, t string, x double, d date, at timestamp_ntz, b boolean").repartition(7).write.parquet(f"{tmp_path}/in.parquet")
    s = Session(spark)
    s.script(f"""use "{tmp_path}/in.parquet", clear
sort id
label variable x "An x"
label define kinds 0 "none" 1 "öne" 2 "two"
label values k kinds
save "file://{tmp_path}/out.dta", replace
use "file://{tmp_path}/out.dta", clear""")
    assert s.labels == {"x": "An x"} and s.value_labels == {"kinds": {0: "none", 1: "öne", 2: "two"}} and s.attached == {"k": "kinds"}
    got = [tuple(r) for r in s.current().collect()]
    assert got == [(i, k, a, t or "", x, d, at, int(b)) for i, k, a, t, x, d, at, b in rows]
    assert {r["k"] for r in s.decoded("k").collect()} == {"none", "öne", "two"}
    back = pd.read_stata(f"{tmp_path}/out.dta")
    assert back["k"].tolist()[:3] == ["none", "öne", "two"] and back["t"].tolist()[4] == "é4" * 1000 and back["id"].tolist() == list(range(150))
    s.script(f'keep if id < 0\nsave "{tmp_path}/none.dta", replace\nuse "{tmp_path}/none.dta", clear')
    assert s.current().count() == 0 and len(pd.read_stata(f"{tmp_path}/none.dta")) == 0


def test_dta_versions_120_and_121(spark, tmp_path):
    path = f"{tmp_path}/v.dta"
    dta.write(spark.createDataFrame([(1, "a")], "i int, s string"), path, {})
    with open(path, "rb") as f:
        raw = f.read()
    with open(path, "wb") as f:
        f.write(raw.replace(b"<release>118<", b"<release>120<"))
    assert [tuple(r) for r in dta.read(spark, path).collect()] == [(1, "a")]
    with open(path, "wb") as f:
        f.write(raw.replace(b"<release>118<", b"<release>115<"))
    with pytest.raises(CommandError):
        dta.header(path)


def test_history_lines():
    assert history.strip_comment('x <- "a # b" # c') == 'x <- "a # b"'
    assert history.parse_text("a <- f(1,\n  2)\nb %>%\n  g() # c\nh(); k(';')\n\n# only\n") == ["a <- f(1, 2)", "b %>% g()", "h()", "k(';')"]
    assert history.parse_text("x\n  |> f()\ny") == ["x |> f()", "y"]
    assert history.calls("if (a::b(x)) for (i in seq(3)) print('f(x)')") == ["a::b", "seq", "print"]
    assert history.pipe_of("a |> b() %>% c()") == "|>" and history.pipe_of("'%>%'") == ""
    assert [history.target_of(x) for x in ("x <- 1", "x <<- 1", "y = 2", "f(y = 2)", "1 -> z", "a == b")] == ["x", "x", "y", "", "z", ""]
    assert history.parse_text(None) == []
    assert history.calls("base::return(f(1)); base::if(x)") == ["f"]


def test_history_files_of_one_name(spark):
    files = spark.createDataFrame([(".Rhistory", "a()\nb()", "o", 1), (".Rhistory", "x <- c()", "p", 2), (".Rhistory", None, "q", 3), ("z.R", "a()\nb()", "o", None)], "source_file string, text string, owner string, cmds long").repartition(3)
    table, commands, calls = history.parse_history(files)
    owner = {r["file_id"]: r["owner"] for r in table.collect()}
    assert sorted(owner) == [0, 1, 2] and owner[2] == "o" and {owner[0], owner[1]} == {"o", "p"}
    got = sorted((owner[r["file_id"]], r["file_id"] == 2, r["command_index"], r["command"]) for r in commands.collect())
    assert got == [("o", False, 0, "a()"), ("o", False, 1, "b()"), ("o", True, 0, "a()"), ("o", True, 1, "b()"), ("p", False, 0, "x <- c()")]
    assert calls.count() == 5


def test_single_commands(spark):
    df = spark.createDataFrame([(1, "x <- stats::lm(y ~ z) |> summary()"), (2, None), (3, "")], "k long, command string")
    rows = {r["k"]: r for r in history.parse_commands(df).collect()}
    assert (rows[1]["primary_function"], rows[1]["pipe_type"], rows[1]["assignment_target"], rows[1]["calls"]) == ("stats::lm", "|>", "x", ["stats::lm", "summary"])
    assert rows[2]["calls"] is None and rows[3]["calls"] == []


def test_history_tables(spark):
    files = spark.createDataFrame([("b.R", "plot(x)\n", "o"), ("a.R", "y <- g(h(1)) %>% k()\n# c", "p"), ("c.R", "# nothing\n", "q"), ("d.R", None, "r")], "source_file string, text string, owner string")
    assert {r[0] for r in history.non_empty(files).select("source_file").collect()} == {"a.R", "b.R"}
    table, commands, calls = history.parse_history(files)
    assert sorted((r["file_id"], r["source_file"]) for r in table.collect()) == [(0, "a.R"), (1, "b.R")]
    first = commands.filter("file_id = 0").first()
    assert (first["primary_function"], first["pipe_type"], first["assignment_target"]) == ("g", "%>%", "y")
    assert [r["function_name"] for r in calls.filter("file_id = 0").orderBy("call_order").collect()] == ["g", "h", "k"]
    assert history.indexed(files).filter("source_file = 'a.R'").first()["line_count"] == 2


def test_stream(spark, tmp_path):
    spark.range(10).selectExpr("id", "id * 2 AS v").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, v long").parquet(f"{tmp_path}/in")
    out = pipeline.transform(stream, "keep if v > 6\ngenerate w = v / 2\ndrop v")
    q = out.writeStream.format("memory").queryName("streamed").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["w"] for r in spark.table("streamed").collect()) == [4, 5, 6, 7, 8, 9]
    for bad in ("sort v", "generate n = _n", "bysort v: keep if _n == 1"):
        with pytest.raises(CommandError):
            pipeline.transform(stream, bad)


def test_command_line(spark, fixtures, tmp_path, capsys):
    script = tmp_path / "s.do"
    script.write_text(f'use "{fixtures}/firms.csv", lazy\nkeep if year == 2018\nlist\n')
    assert main([str(script), "--annotate"]) == 0
    shown = capsys.readouterr().out
    assert shown.startswith("-- use ") and shown.rstrip().endswith(";") and "WHERE (`year` = 2018)" in shown
    assert "SELECT * FROM _s1;" in compile_script(spark, script.read_text())
    assert main([str(script), "--run"]) == 0
    assert "Delta" in capsys.readouterr().out
    assert main([str(script), "-o", str(tmp_path / "o.sql")]) == 0 and (tmp_path / "o.sql").read_text().startswith("WITH")
