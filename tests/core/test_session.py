"""The command language end to end, against results known by hand."""

import pandas as pd
import pytest

from statloom.errors import CommandError
from statloom.session import Session


@pytest.fixture
def open_(spark, fixtures):
    def made(name="firms.csv", **kw):
        s = Session(spark, **kw)
        s.run(f'use "{fixtures}/{name}", clear')
        return s

    return made


def rows(s, command="list"):
    return [tuple(r) for r in s.run(command).data.collect()]


def col(s, name):
    return [r[0] for r in rows(s, f"list {name}")]


def test_keep_drop_rename_order(open_):
    s = open_()
    s.run("keep if revenue >= 1000")
    s.run("rename name firm")
    assert s.frame.columns == ["id", "revenue", "year", "firm"]
    s.run("order year firm")
    assert s.frame.columns == ["year", "firm", "id", "revenue"]
    s.run("drop year")
    assert rows(s)[0] == ("Acme", 1, 1000)
    with pytest.raises(CommandError):
        s.run("drop nothing")


def test_drop_if_also_drops_null_conditions(open_):
    s = open_("nulls.csv")
    s.run("drop if x > 5")
    assert sorted(col(s, "x")) == [1, 5]


def test_generate_replace(open_):
    s = open_()
    s.run("generate d = revenue * 2 if year == 2018")
    assert col(s, "d") == [None, 4000, None, 6000, 1000]
    s.run("replace d = 0 if missing(d)")
    assert col(s, "d") == [0, 4000, 0, 6000, 1000]
    with pytest.raises(CommandError, match="already defined"):
        s.run("generate D = 1")
    with pytest.raises(CommandError):
        s.run("replace nothing = 1")


def test_int_rounds_and_functions(open_):
    s = open_()
    s.run("generate i = int(revenue/3)")
    assert col(s, "i") == [333, 667, 500, 1000, 167]
    s.run('generate c = cond(inlist(year, 2017, 2019), "odd", strupper(substr(name, 1, 2)))')
    assert col(s, "c") == ["odd", "BE", "odd", "DE", "EP"]
    s.run("generate z = revenue / (year - 2017)")
    assert col(s, "z") == [None, 2000.0, None, 3000.0, 500.0]
    s.run('generate t = "year(x) _n L.x"')
    assert col(s, "t")[0] == "year(x) _n L.x"


def test_sort_head_tail_nulls_last(open_):
    s = open_()
    s.run("sort revenue, desc")
    assert col(s, "id") == [4, 2, 3, 1, 5]
    assert [r[0] for r in rows(s, "head 2")] == [4, 2]
    assert [r[0] for r in rows(s, "tail 2")] == [1, 5]
    s = open_("nulls.csv")
    s.run("sort x")
    assert col(s, "x") == [1, 5, 7, None, None]
    s.run("sort x, desc")
    assert col(s, "x") == [7, 5, 1, None, None]


def test_sort_key_may_change_afterwards(open_):
    s = open_()
    s.run("sort revenue")
    s.run("replace revenue = -revenue")
    s.run("generate n = _n")
    assert rows(s, "list id n") == [(5, 1), (1, 2), (3, 3), (2, 4), (4, 5)]
    s.run("drop revenue")
    assert col(s, "id") == [5, 1, 3, 2, 4]


def test_summaries(open_):
    s = open_()
    assert rows(s, "summarize revenue") == [(5, 1600.0, 961.7692030835673, 500, 1000.0, 1500.0, 2000.0, 3000)]
    assert len(rows(s, "summarize revenue year")) == 2
    assert rows(s, "tabulate year") == [(2017, 2), (2018, 3)]
    assert rows(s, "count if revenue > 1000") == [(3,)]
    assert rows(open_("nulls.csv"), "tabulate g") == [("a", 2), ("b", 1), (None, 2)]


def test_collapse(open_):
    s = open_()
    s.run("collapse (mean) m=revenue (sum) revenue (count) n=id (first) f=name (last) l=name (median) md=revenue top=max(revenue) if id < 5, by(year)")
    assert rows(s) == [(2017, 1250.0, 2500, 2, "Acme", "Gamma", 1250.0, 1500), (2018, 2500.0, 5000, 2, "Beta", "Delta", 2500.0, 3000)]
    s = open_()
    s.run("sort revenue, desc")
    s.run("collapse (first) f=name (last) l=name")
    assert rows(s) == [("Delta", "Epsilon")]


def test_first_does_not_skip_nulls_unless_asked(open_):
    for strict, want in ((False, [("a", None), ("b", None), (None, 7)]), (True, [("a", 1), ("b", None), (None, 7)])):
        s = open_("nulls.csv", strict_nm=strict)
        s.run("collapse (lastnm) x, by(g)")
        assert rows(s) == want


def test_egen(open_):
    s = open_()
    s.run("egen m = mean(revenue), by(year)")
    s.run("egen top = max(revenue) if year == 2017")
    s.run("bysort year: egen n = count(id)")
    assert rows(s, "list id m top n") == [(1, 1250.0, 3000, 2), (2, pytest.approx(5500 / 3), None, 3), (3, 1250.0, 3000, 2), (4, pytest.approx(5500 / 3), None, 3), (5, pytest.approx(5500 / 3), None, 3)]
    s = open_("nulls.csv")
    s.run("egen t = sum(x), by(g)")
    assert col(s, "t") == [1, 1, None, 12, 12]


def test_positions_over_the_whole_dataset(open_):
    s = open_()
    for c in ("generate n = _n", "generate t = _N", "generate p = revenue[_n-1]", "generate q = revenue[_n+1]", "generate s = sum(revenue)", "generate m = mean(revenue)", "generate f = name[1]"):
        s.run(c)
    assert rows(s, "list n t p q s m f")[1] == (2, 5, 1000, 1500, 3000, 1500.0, "Acme")
    assert rows(s, "list n t p q s m f")[4] == (5, 5, 3000, None, 8000, 1600.0, "Acme")
    s.run("keep if _n > 3")
    assert col(s, "id") == [4, 5]


def test_panel(open_):
    s = open_("panel_ts.csv")
    with pytest.raises(CommandError, match="xtset"):
        s.run("generate l = L.revenue")
    s.run("xtset id year")
    for c in ("generate l = L.revenue", "generate f = F.revenue", "generate d = D.revenue", "generate l2 = L2.revenue"):
        s.run(c)
    assert col(s, "l") == [None, 100, 120, None, None, 500, 550]
    assert col(s, "f") == [120, 150, None, None, 550, 600, None]
    assert col(s, "d") == [None, 20, 30, None, None, 50, 50]
    # the second row before, and only if it is two years back
    assert col(s, "l2") == [None, None, 100, None, None, None, 500]


def test_bysort(open_):
    s = open_("panel_ts.csv")
    for c in ("bysort id (year): generate k = _n", "bysort id: generate c = _N", "bysort id (year): generate run = sum(revenue)", "bysort id (year): generate p = revenue[_n-1]"):
        s.run(c)
    assert col(s, "run") == [100, 220, 370, 570, 500, 1050, 1650]
    assert col(s, "p") == [None, 100, 120, 150, None, 500, 550]
    s.run("bysort id (year): keep if _n == _N")
    assert rows(s, "list id k c") == [(1, 4, 4), (2, 3, 3)]
    with pytest.raises(CommandError, match="colon"):
        s.run("bysort id generate k = _n")


def test_groups_too_large_for_a_task(open_, spark, tmp_path, monkeypatch):
    from statloom.operators import windows

    monkeypatch.setattr(windows, "BLOCK", 7)
    data = [(None if i % 5 == 4 else min(i % 5, 1), (i * 37) % 101, i if i % 3 else None, i) for i in range(100)]
    spark.createDataFrame(data, "g long, t long, v long, id long").write.parquet(f"{tmp_path}/g.parquet")
    commands = ["n = _n", "c = _N", "p = v[_n-1]", "q = v[_n+2]", "f = id[1]", "s = sum(v)", "m = mean(v)", "k = count(v)", "lo = min(v)", "hi = max(v)"]
    out = []
    for spread in (False, True):
        s = Session(spark, spread_groups=spread)
        s.run(f'use "{tmp_path}/g.parquet"')
        for c in commands:
            s.run(f"bysort g (t): generate {c}")
        s.run("sort id")
        out.append(rows(s))
        s.run("bysort g (t): keep if _n == _N | _n == 1")
        out.append(sorted(rows(s), key=str))
    assert out[0] == out[2] and out[1] == out[3] and len(out[0]) == 100 and len(out[1]) == 6


def test_merge(open_, fixtures):
    s = open_()
    s.run(f'merge m:1 year using "{fixtures}/yeargdp.csv"')
    assert s.frame.columns == ["id", "name", "revenue", "year", "gdp", "_merge"]
    assert rows(s, "list id gdp _merge") == [(1, 100, 3), (2, 110, 3), (3, 100, 3), (4, 110, 3), (5, 110, 3), (None, 120, 2)]
    for keep, want in (("match", [3] * 5), ("using", [2]), ("using match", [2, 3, 3, 3, 3, 3]), ("master", []), ("1 3", [3] * 5), ("master using", [2])):
        s = open_()
        s.run(f'merge m:1 year using "{fixtures}/yeargdp.csv", keep({keep})')
        assert sorted(col(s, "_merge")) == want
    s = open_()
    s.run(f'merge m:1 year using "{fixtures}/yeargdp.csv", keep(match) keepusing(gdp) nogen')
    assert s.frame.columns == ["id", "name", "revenue", "year", "gdp"]
    s = open_(validate=True)
    with pytest.raises(CommandError, match="identify"):
        s.run(f'merge 1:1 year using "{fixtures}/yeargdp.csv"')


def test_null_keys_never_match(open_, spark):
    spark.createDataFrame([("a", 1), (None, 2)], "g string, y int").createOrReplaceTempView("other")
    s = open_("nulls.csv")
    s.run("merge m:1 g using other")
    assert sorted((r[0] or "", r[1]) for r in rows(s, "list g _merge")) == [("", 1), ("", 1), ("", 2), ("a", 3), ("a", 3), ("b", 1)]


def test_append_duplicates_expand(open_, fixtures):
    s = open_()
    s.run(f'append using "{fixtures}/yeargdp.csv"')
    assert rows(s)[5] == (None, None, None, 2017, 100) and len(rows(s)) == 8
    s.run("duplicates drop year")
    assert col(s, "id") == [1, 2, None]
    s.run("expand 2, generate(copy)")
    assert rows(s, "list year copy") == [(2017, 0), (2017, 1), (2018, 0), (2018, 1), (2019, 0), (2019, 1)]
    s.run("generate n = cond(year == 2017, 0, cond(year == 2018, -3, NULL))")
    s.run("expand n")
    assert rows(s) == []


def test_duplicates_keep_the_first_by_order(open_):
    for order, want in (("sort revenue", [5, 1]), ("sort revenue, desc", [4, 3]), ("sort id", [1, 2])):
        s = open_()
        s.run(order)
        s.run("duplicates drop year")
        assert col(s, "id") == want


def test_reshape(open_):
    s = open_("panel.csv")
    s.run("reshape long revenue, i(id) j(year)")
    assert rows(s, "list id year revenue old_revenue_2019") == [(1, "2017", 1000, 9), (1, "2018", 1100, 9), (2, "2017", 2000, 9), (2, "2018", 2200, 9), (3, "2017", 1500, 9)]
    s.run("reshape wide revenue, i(id name) j(year)")
    assert s.frame.columns == ["id", "name", "2017", "2018"]
    assert rows(s)[2] == (3, "Gamma", 1500, None)


def test_mvencode_and_recode(open_):
    s = open_("nulls.csv")
    s.run("mvencode x, mv(-1)")
    assert col(s, "x") == [1, -1, -1, 5, 7]
    s.run("recode x (-1=0) (7=70), generate(y)")
    assert col(s, "y") == [1, 0, 0, 5, 70]


def test_state(open_, fixtures, tmp_path):
    s = open_()
    s.run("keep if year == 2018")
    s.run("drop year")
    s.run("undo")
    assert "year" in s.frame.columns
    s.run("redo")
    assert "year" not in s.frame.columns
    with pytest.raises(CommandError, match="Nothing to redo"):
        s.run("redo")
    s.run("undo 10")
    assert len(rows(s)) == 5
    assert [tuple(r)[2] for r in s.run("history").data.orderBy("step_id").collect()] == [False, True, True]
    s.run("preserve")
    s.run("drop name")
    with pytest.raises(CommandError):
        s.run("preserve")
    s.run(f'use "{fixtures}/yeargdp.csv", clear')
    s.run("restore")
    assert "name" in s.frame.columns
    s.run("clear")
    with pytest.raises(CommandError, match="no dataset"):
        s.run("list")


def test_labels_describe(open_):
    s = open_()
    assert rows(s, "describe") == [("id", "BIGINT"), ("name", "VARCHAR"), ("revenue", "BIGINT"), ("year", "BIGINT")]
    s.run('label variable revenue "Annual revenue"')
    s.run('label define yr 2017 "old" 2018 "new"')
    s.run("label values year yr")
    assert rows(s, "codebook")[2:] == [("revenue", "BIGINT", "Annual revenue", ""), ("year", "BIGINT", "", "yr")]
    assert ("yr", "2017", "old") in rows(s, "label list")
    assert [r["year"] for r in s.decoded("year").orderBy("id").collect()][:2] == ["old", "new"]
    with pytest.raises(CommandError):
        s.run("label values year nothing")


def test_tables_and_files(open_, tmp_path, fixtures, spark):
    s = open_()
    s.run("tempfile a")
    s.run("keep id revenue")
    s.run("save a")
    s.run(f'use "{fixtures}/firms.csv", clear')
    s.run("keep id name")
    s.run("merge 1:1 id using a, nogen")
    assert rows(s)[0] == (1, "Acme", 1000)
    s.run("save kept_firms, replace table")
    s.run("use kept_firms, clear")
    s.run('merge 1:1 id using "_tempfiles.a", keep(match) nogen')
    assert len(rows(s)) == 5
    s.run("collapse avg = mean(revenue)")
    assert rows(s) == [(1600.0,)]
    s.run("use kept_firms, clear")
    for kind in ("parquet", "json", "csv", "dta"):
        path = f"{tmp_path}/out.{kind}"
        s.run(f'save "{path}", replace')
        again = Session(spark)
        again.run(f'use "{path}"')
        assert sorted((int(r[again.frame.columns.index("id")]), r[again.frame.columns.index("name")]) for r in rows(again)) == [(1, "Acme"), (2, "Beta"), (3, "Gamma"), (4, "Delta"), (5, "Epsilon")]
    # a dataset may be saved onto its own source
    own = Session(spark)
    own.run(f'use "{tmp_path}/out.parquet", lazy')
    own.run("keep if id < 3")
    own.run(f'save "{tmp_path}/out.parquet", replace')
    assert spark.read.parquet(f"{tmp_path}/out.parquet").count() == 2
    with pytest.raises(CommandError, match="cannot open"):
        own.run('use "/nowhere/at/all.csv"')


def test_script(spark, fixtures, tmp_path):
    path = tmp_path / "clean.do"
    path.write_text(f'* a comment\nuse "{fixtures}/firms.csv", clear // loads\n/* a block\nof comments */ keep if year == 2018 ///\n  AND revenue > 600;\nlist\nunknown words\ngenerate lr = log(revenue)\nsort revenue\n')
    s = Session(spark)
    s.run(f'do "{path}"')
    assert col(s, "id") == [2, 4]
    assert "lr" in s.frame.columns and len(s.steps) == 4


def test_shown_sql_gives_the_same_rows(spark, tmp_path, open_):
    p = f"{tmp_path}/firms.parquet"
    s = open_()
    s.run(f'save "{p}", replace')
    s = Session(spark)
    s.script(f'''use "{p}", clear
keep if revenue > 500
generate d = revenue / 7 if year == 2018
replace d = 0 if missing(d)
bysort year (revenue): generate k = _n
bysort year (revenue): generate run = sum(revenue)
egen m = mean(revenue), by(year)
rename name firm
mvencode d, mv(1)
merge m:1 id using "{p}", keep(match) keepusing(name) nogen
collapse (sum) d run (max) k m, by(year firm)''')
    assert sorted(map(tuple, spark.sql(s.sql()).collect())) == sorted(map(tuple, s.current().collect()))
    assert s.sql().count("-- [source]") == 11


def test_conditions_with_other_rows_everywhere(open_):
    s = open_()
    assert rows(s, "count if _n > 2") == [(3,)]
    assert [r[0] for r in rows(s, "list id if revenue > revenue[_n-1]")] == [2, 4]
    s.run("collapse (count) n=id if _n > 1")
    assert rows(s) == [(4,)]


def test_regress(open_):
    s = open_()
    s.run("generate x = id")
    s.run("generate y = 3 * id + 2")
    out = {r[0]: r[1] for r in rows(s, "regress y x")}
    assert out["x"] == pytest.approx(3) and out["_cons"] == pytest.approx(2)


def test_empty_data(spark, tmp_path):
    spark.createDataFrame([], "id long, g string, v double").write.parquet(f"{tmp_path}/e.parquet")
    for c in ("generate n = _n", "egen m = mean(v), by(g)", "collapse (mean) v, by(g)", "duplicates drop g", "expand 2", "sort v", "generate s = sum(v)", "egen t = max(v)"):
        s = Session(spark)
        s.run(f'use "{tmp_path}/e.parquet"')
        s.run(c)
        assert rows(s) == []
    assert rows(s, "count") == [(0,)]


@pytest.mark.parametrize("limit", [None, 0])
def test_results_do_not_depend_on_the_size_rules(spark, tmp_path, monkeypatch, limit):
    """Windows and one-task aggregates, or positions and joins: the same rows."""
    from statloom.operators import windows

    if limit is not None:
        monkeypatch.setattr(windows, "ONE_TASK_BYTES", limit)
        monkeypatch.setattr(windows, "ONE_TASK_ROWS", limit)
    rows = [(u, t, float(((u or 5) * 7 + t * 3) % 11) if t % 4 else None) for u in (1, 2, None) for t in range(1, 12) if (u or 0) + t != 5]
    spark.createDataFrame(rows, "u long, t long, x double").write.parquet(f"{tmp_path}/p.parquet")
    by = {u: sorted((t, x) for v, t, x in rows if v == u) for u in (1, 2, None)}

    def session(text):
        s = Session(spark)
        s.run(f'use "{tmp_path}/p.parquet", clear')
        s.script(text)
        return s

    got = {(r["u"], r["t"]): (r["a"], r["b"], r["c"], r["n"]) for r in session("xtset u t\ngenerate a = L.x\ngenerate b = F2.x\ngenerate c = D.x\nbysort u (t): generate n = _n").current().collect()}
    for u, own in by.items():
        at = {t: x for t, x in own}
        for k, (t, x) in enumerate(own):
            before = at.get(t - 1)
            later = at.get(t + 2) if k + 2 < len(own) and own[k + 2][0] == t + 2 else None
            assert got[u, t] == (before, later, x - before if x is not None and before is not None else None, k + 1), (u, t)
    r = session("summarize x").run("summarize x").data.first()
    xs = sorted(x for _, _, x in rows if x is not None)
    want = pd.Series(xs).quantile([0.25, 0.5, 0.75]).tolist()
    assert [r["p25"], r["p50"], r["p75"]] == pytest.approx(want)
    medians = {u: pd.Series([x for _, x in own if x is not None]).median() for u, own in by.items()}
    got = {r["u"]: (r["m"], r["n"]) for r in session("collapse (median) m=x (count) n=x, by(u)").current().collect()}
    assert got == {u: (m, sum(x is not None for _, x in by[u])) for u, m in medians.items()}
    assert {(r["u"], r["m"]) for r in session("egen m = median(x), by(u)").current().collect()} == set(medians.items())
    assert session("collapse (median) m=x").current().first()["m"] == pd.Series(xs).median()
    assert session("keep if x > 99\ncollapse (median) m=x").current().first()["m"] is None
    # the first row of each group in a descending order
    assert sorted((r["u"] or 0, r["t"], len(r)) for r in session("sort t, desc\nduplicates drop u").current().collect()) == [(0, 11, 3), (1, 11, 3), (2, 11, 3)]
    # time without a unit
    s = session("keep if u == 1\ntsset t\ngenerate a = L.x")
    assert {(r["t"], r["a"]) for r in s.current().collect()} == {(t, dict(by[1]).get(t - 1)) for t, _ in by[1]}
    assert "SinglePartition" not in s.current()._jdf.queryExecution().toString() and "lag(`x`, 1)" in s.sql()
