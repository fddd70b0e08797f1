import math
import warnings

import pytest

from seriesloom.functions.frequency import Monthly, Quarterly
from seriesloom.functions.period import PeriodRange, mm, qq
from seriesloom.x13 import read, run
from seriesloom.x13 import spec as S
from seriesloom.x13.spec import Arima, ArimaModel, Data, OpenSpan, Problem, new_spec
from seriesloom.x13.validate import validate
from seriesloom.x13.write import block_text, wrapped, write

Q = Data.of(qq(1990, 1), range(80))
M = Data.of(mm(2000, 1), range(240))


def base(data=Q, *blocks):
    return new_spec(data, S.transform(power=0.5), S.x11(mode="mult"), *blocks)


@pytest.mark.parametrize(
    ("variable", "text"),
    [
        (S.ao(mm(2020, 7)), "ao2020.jul"), (S.ls(qq(2020, 3)), "ls2020.3"), (S.tc(qq(2020, 3)), "tc2020.3"), (S.so(qq(2020, 3)), "so2020.3"), (S.aos(qq(2020, 1), qq(2020, 3)), "aos2020.1-2020.3"),
        (S.rp(mm(2020, 1), mm(2021, 2)), "rp2020.jan-2021.feb"), (S.easter(8), "easter[8]"), (S.tdstock(31), "tdstock[31]"), (S.thank(-3), "thank[-3]"), (S.sincos((1, 2)), "sincos[1 2]"), (S.td(), "td"),
        (S.td(mm(2020, 7)), "td/2020.jul/"), (S.lom(mm(2020, 7), "zerobefore"), "lom//2020.jul/"), (S.seasonal(mm(2020, 7), "zeroafter"), "seasonal/2020.jul//"),
    ],
)
def test_regressors(variable, text):
    assert str(variable) == text


def test_regressor_errors():
    for bad, error in ((lambda: S.td(None, "both"), ValueError), (lambda: S.td(mm(2020, 1), "sometimes"), ValueError), (lambda: S.sincos([1]), TypeError), (lambda: S.ao(3), TypeError), (lambda: Arima(True), TypeError), (lambda: ArimaModel(()), ValueError)):
        with pytest.raises(error):
            bad()


@pytest.mark.parametrize(
    ("block", "lines"),
    [
        (S.arima(ArimaModel.of(1, 1, 1)), ["model = (1 1 1)"]), (S.arima(ArimaModel.of(0, 1, 1, 0, 1, 1)), ["model = (0 1 1)(0 1 1)"]), (S.arima(Arima(1, 1, 1, 12)), ["model = (1 1 1)12"]), (S.arima(Arima((2, 3), 0, 0)), ["model = ([2 3] 0 0)"]),
        (S.arima(Arima(1, 1, 1), ar=[0.3, 0.5], fixar=[True, False]), ["model = (1 1 1)", "ar = (0.3f,0.5)"]), (S.arima(Arima(1, 1, 1), ma=[0.3, None, 0.5], fixma=[True, False, True]), ["model = (1 1 1)", "ma = (0.3f,,0.5f)"]),
        (S.transform(func="log"), ["function = log"]), (S.transform(power=0.5), ["power = 0.5"]), (S.regression(variables=[S.ao(qq(1995, 2)), "td"]), ["variables = (ao1995.2 td)"]), (S.regression(variables="td", aictest=["td"], b=[0.1, 0.2], fixb=[False, True]), ["variables = td", "aictest = (td)", "b = (0.1,0.2f)"]),
        (S.x11(mode="mult", title="Decomposition"), ["mode = mult", 'title = "Decomposition"']), (S.seats(), ["out = 0"]), (S.seats(printphtrf=True, tabtables=["xo", "n"]), ["out = 0", "printphtrf = 1", 'tabtables = "xo,n"']), (S.outlier(types=["ao", "ls"]), ["types = (ao ls)"]), (S.automdl(maxorder=[3, 2]), ["maxorder = (3, 2)"]),
        (S.forecast(maxlead=12), ["maxlead = 12"]), (S.force(lambda_=0.5), ["lambda = 0.5"]), (S.check(maxlag=10, print=["acf", "pacf"]), ["maxlag = 10", "print = (acf + pacf)"]), (S.estimate(exact="arma", outofsample=False), ["exact = arma", "outofsample = no"]), (S.history(start=mm(2010, 1)), ["start = 2010.jan"]),
        (S.outlier(span=OpenSpan(qq(1995, 1), None)), ["span = (1995.1, )"]), (S.identify(diff=[0, 1], maxlag=5), ["diff = (0, 1)", "maxlag = 5"]), (S.metadata([("a", "b")]), ['key = "a"', 'value = "b"']), (S.metadata([("a", "b"), ("c", "d")]), ["key = (", '        "a"', '        "c"', ")", "value = (", '        "b"', '        "d"', ")"]),
    ],
)
def test_blocks(block, lines):
    body = ("\n" + " " * 8).join(lines)
    assert block_text(block) == f"{block.kind} {{\n{' ' * 8}{body}\n}}"


def test_whole_text(tmp_path):
    out = write(base(Q, S.automdl()), outputs=False)
    assert out.startswith("series {\n") and "data = (0.0 1.0" in out and "period = 4" in out and "start = 1990.1" in out and out.index("transform {") < out.index("automdl { }") < out.index("x11 {")
    monthly = write(new_spec(S.series(M, name="GNP", print=["default"])))
    assert "start = 2000.jan" in monthly and 'name = "GNP"' in monthly and "period" not in monthly and "print = (default)" in monthly
    assert "print" not in write(new_spec(S.series(M, print=["default"])), outputs=False)
    models = [ArimaModel.of(0, 1, 1, 0, 1, 1, default=True), ArimaModel.of(0, 1, 2), ArimaModel.of(2, 1, 0)]
    text = write(base(Q, S.pickmdl(models)), folder=str(tmp_path))
    assert (tmp_path / "pickmdl.mdl").read_text() == "(0 1 1)(0 1 1) *\n(0 1 2) X\n(2 1 0)\n" and f'file = "{tmp_path}/pickmdl.mdl"' in text
    two = Data(qq(1990, 1), {"u": (1.0, 2.0), "v": (3.0, 4.0)})
    assert "data = (        1.0        3.0\n                2.0        4.0        )" in block_text(S.transform(data=two))


def test_saving_all():
    assert block_text(S.check(save="all")) == "check {\n        save = (acf pacf acfsquared)\n}"
    assert block_text(S.check(print="all")) == "check {\n        print = (all)\n}"
    with pytest.raises(Problem, match="tables"):
        S.x11(save=["all"])


def test_long_lines():
    parts = wrapped(" ".join(f"x{i}" for i in range(60)))
    assert len(parts) == 2 and all(len(p) <= 124 for p in parts) and parts[1].startswith(" " * 8)
    plus = wrapped("print = (" + " + ".join(f"table{i}" for i in range(30)) + ")")
    assert all(p.rstrip().endswith("+") for p in plus[:-1])
    assert wrapped("a = 1") == ["a = 1"] and len(wrapped("a b c d e f g h i j k l", 12)) > 1
    with pytest.raises(ValueError, match="Could not split"):
        wrapped("a" * 200)


@pytest.mark.parametrize(
    "make",
    [
        lambda: S.series(Q, span=PeriodRange(qq(1980, 1), qq(1995, 1))), lambda: S.series(Q, start=qq(2030, 1)), lambda: S.series(Q, divpower=10), lambda: S.series(Data.of(qq(2000, 1), [1.0, math.nan])), lambda: S.arima(Arima(1, 0, 0), ar=[0.1], fixar=[True, False]),
        lambda: S.automdl(diff=[1]), lambda: S.automdl(diff=[3, 0]), lambda: S.automdl(maxdiff=[2, 2]), lambda: S.automdl(maxorder=[5, 1]), lambda: S.transform(func="log", power=0.0), lambda: S.transform(adjust="lpyear", power=0.5), lambda: S.transform(mode=["diff", "ratio"]), lambda: S.transform(type="temporary"),
        lambda: S.regression(aicdiff=1.0, pvaictest=0.1), lambda: S.regression(usertype="odd"), lambda: S.regression(aictest="ao"), lambda: S.regression(variables=S.easter(26)), lambda: S.regression(variables=[S.tdstock(0)]), lambda: S.seats(epsiv=-1.0), lambda: S.seats(print="all"), lambda: S.x11(trendma=4), lambda: S.x11(sigmavec=[1]),
        lambda: S.force(rho=2.0), lambda: S.history(fstep=[1, 2, 3, 4, 5]), lambda: S.history(sadjlags=[0]), lambda: S.metadata([("k" * 133, "v")]), lambda: S.metadata([("k", "v")] * 21), lambda: S.outlier(critical=[1, 2, 3, 4]), lambda: S.outlier(lsrun=6), lambda: S.outlier(tcrate=1.5),
        lambda: S.pickmdl([ArimaModel.of(0, 1, 1)]), lambda: S.pickmdl([ArimaModel.of(0, 1, 1)] * 2, overdiff=0.5), lambda: S.x11regression(sigma=0), lambda: S.x11regression(tdprior=[1.0] * 6), lambda: S.x11regression(aictest="lom"),
    ],
)
def test_builder_rules(make):
    with pytest.raises(Problem):
        make()


@pytest.mark.parametrize(
    "spec",
    [
        lambda: base(Q, S.automdl(), S.arima(Arima(1, 0, 0))), lambda: base(Q, S.estimate(file="x"), S.automdl()), lambda: base(Q, S.regression(variables=["td", "lom"])), lambda: base(Data.of(qq(1990, 1), range(40)), S.regression(variables=S.labor(3))), lambda: new_spec(S.series(Q, type="stock"), S.transform(power=0.5), S.regression(variables="td")),
        lambda: new_spec(S.series(Q, type="flow"), S.transform(power=0.5), S.regression(variables=S.easterstock(3))), lambda: new_spec(Q, S.transform(adjust="lom"), S.regression(variables="td")), lambda: base(Q, S.regression(variables=S.ao(qq(2020, 1)))), lambda: base(Q, S.regression(variables=S.ls(qq(1990, 1)))), lambda: base(Q, S.regression(variables=S.aos(qq(1995, 1), qq(2020, 1)))),
        lambda: base(Q, S.regression(variables="td", aictest=["lom"])), lambda: base(Q, S.regression(data=Data.of(qq(1990, 1), range(80))), S.forecast(maxlead=4)), lambda: base(Q, S.history(fstep=[13])), lambda: base(Q, S.slidingspans(length=8)), lambda: new_spec(Q, S.transform(adjust="lom"), S.x11(mode="add")), lambda: new_spec(Q, S.transform(), S.x11()),
    ],
)
def test_rules_over_blocks(spec):
    with pytest.raises(Problem):
        validate(spec())


def test_warnings():
    for make in (lambda: S.series(Q, name="n" * 70), lambda: S.automdl(diff=[1, 1], maxdiff=[2, 1]), lambda: S.seats(hplan=1.0, hpcycle=True), lambda: S.regression(variables=[S.aos(qq(2000, 1), qq(2000, 4)), S.aos(qq(2000, 3), qq(2001, 1))]), lambda: validate(base(Q, S.spectrum(qcheck=True))), lambda: validate(base(Data.of(qq(2000, 1), range(20)), S.seats(hpcycle=True)))):
        with pytest.warns(UserWarning):
            make()
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        validate(base(M, S.regression(variables=["td", S.easter(8), S.ao(mm(2010, 1))], data=Data.of(mm(1999, 1), range(300))), S.forecast(maxlead=12)))
    cut = S.series(Q, start=qq(1995, 1), missingcode=-1.0)
    assert cut.data.first == qq(1995, 1) and cut.data.values[0] == 20
    filled = S.series(Data.of(qq(2000, 1), [1.0, math.nan]), missingcode=-99.0)
    assert filled.data.values == (1.0, -99.0)


def test_series_readers():
    one = read.series("date\td11\n------\t------\n199001\t1.5\n199002\t+0.2E+01\n199003\t****\n", Quarterly())
    assert one.first == qq(1990, 1) and one.columns["d11"][:2] == (1.5, 2.0) and math.isnan(one.columns["d11"][2])
    two = read.series("date\ta b\tc-d\n--\t--\t--\n200011\t1\t2\n200012\t3\t4\n", Monthly())
    assert two.first == mm(2000, 11) and two.columns == {"a_b": (1.0, 3.0), "c_d": (2.0, 4.0)}
    seats = read.seats_series("TITLE\n  DATE    SERIES    TREND\n  1 - 1990    1.0    2.0\n  2 - 1990    3.0    4.0\n", Quarterly())
    assert seats.first == qq(1990, 1) and seats.columns == {"SERIES": (1.0, 3.0), "TREND": (2.0, 4.0)}
    for bad in ("x", "date\ta\n--\t--\nabc\t1\n"):
        with pytest.raises(ValueError):
            read.series(bad, Quarterly())


def test_table_and_key_readers():
    assert read.table("Lag\tSample ACF\tname\n--\t--\t--\n1\t0.5\ta\n2\t-0.1\tb\n") == {"Lag": [1, 2], "Sample_ACF": [0.5, -0.1], "name": ["a", "b"]}
    assert list(read.table("a\tb\n-\t-\n1\t2\t3\n", "acm")) == ["a", "lag", "b"]
    flat = read.udg("date: May 20, 2026\nn: 5\nx: 1.5\nv: 1 2.5 *******\nok: yes\nbad: no\nt: some text\nroots.ar.01: 2\nroots.ma: 3\nk: 1\nk.a: 2\n")
    assert flat["date"] == "2026-05-20" and flat["n"] == 5 and flat["x"] == 1.5 and flat["v"][:2] == [1.0, 2.5] and math.isnan(flat["v"][2]) and flat["ok"] is True and flat["bad"] is False and flat["t"] == "some text"
    assert flat["roots"] == {"ma": 3, "ar": {"01": 2}} and flat["k"] == 1 and flat["k_"] == {"a": 2}
    found = read.messages("header\n WARNING: first\n  goes on\n ERROR: second thing\n NOTE: third thing\n")
    assert found.warnings == ["first\n  goes on"] and found.errors == ["second thing"] and found.notes == ["third thing"]
    estimates = read.estimates("$regression$estimates:\ngroup\tvariable\testimate\n--\t--\t--\nTD\tMon\t0.5\n$variance:\nmle\t0.01\n")
    assert estimates == {"regression_estimates": {"group": ["TD"], "variable": ["Mon"], "estimate": [0.5]}, "variance": {"mle": 0.01}}
    model = read.model("arima{\n model=(0 1 1)(0 1 1)12\n ma=(0.3f 0.5)\n}\nregression{ variables=(td easter[8]) b=(0.1 0.2f) }")
    assert model["arima"] == {"model": "(0 1 1)(0 1 1)12", "ma": [0.3, 0.5], "fixma": [True, False]} and model["regression"]["variables"] == ["td", "easter[8]"] and model["regression"]["fixb"] == [False, True]
    pages = read.identify("$diff=0\n$sdiff=1\nLag\tACF\n--\t--\n1\t0.5\n$diff=1\n$sdiff=1\nLag\tACF\n--\t--\n1\t0.25\n")
    assert pages == {"diff0_sdiff1": {"Lag": [1], "ACF": [0.5]}, "diff1_sdiff1": {"Lag": [1], "ACF": [0.25]}}


FAKE = """#!/bin/sh
# stands for the program: writes a d11 table and messages
base="$2"
[ -f "$base.spc" ] || exit 1
grep -q fail "$base.spc" && { echo " ERROR: told to fail"; exit 0; }
start=$(sed -n 's/.*start = \\([0-9]*\\)\\.\\([0-9]*\\).*/\\1 \\2/p' "$base.spc")
printf 'date\\td11\\n------\\t-----\\n' > "$base.d11"
set -- $start
printf '%s%02d\\t10.0\\n' "$1" "$2" >> "$base.d11"
printf ' WARNING: only a stand-in\\n' > "$base.err"
"""


def test_runs(spark, tmp_path):
    binary = tmp_path / "x13as"
    binary.write_text(FAKE)
    binary.chmod(0o755)
    result = run.run(base(Q), binary=str(binary))
    assert result.outputs["d11"].columns == {"d11": (10.0,)} and result.messages.warnings == ["only a stand-in"] and "d11" in result.outputs
    with pytest.raises(RuntimeError, match="told to fail"):
        run.run(new_spec(S.series(Q, name="fail")), binary=str(binary))
    from seriesloom.plans.frame import SeriesFrame

    df = spark.createDataFrame([(k, 8000 + 10 * k + i, 1.0) for k in range(2) for i in range(4)], "k int, mit long, value double")
    out = run.deseasonalize(SeriesFrame(df, Quarterly(), ("k",)), binary=str(binary)).df.orderBy("k", "mit").collect()
    assert [r["value"] for r in out if r["mit"] in (8000, 8010)] == [10.0, 10.0] and sum(math.isnan(r["value"]) for r in out) == 6
    with pytest.raises(RuntimeError, match="not found"):
        run.program(str(tmp_path / "nothing"))
    assert run.cleanup_folders(remove=True) and not run.cleanup_folders()
