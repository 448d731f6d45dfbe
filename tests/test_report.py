import pytest

from objtrail.api import Issue, Level, Report
from objtrail.schema import ISSUE


def report(spark, *rows):
    return Report(spark.createDataFrame(list(rows), ISSUE))


def test_levels(spark):
    r = report(spark, ("a", "m", "warning", ["x"]), ("b", "m", "error", ["x", ""]))
    assert not r.valid
    assert [x.code for x in r.errors.collect()] == ["b"]
    assert [x.code for x in r.warnings.collect()] == ["a"]
    assert r.collect()[1] == Issue("b", "m", Level.ERROR, ("x", ""))
    assert report(spark, ("a", "m", "warning", [])).valid
    assert report(spark).valid


def test_has(spark):
    r = report(spark, ("a", "m", "error", []))
    assert r.has("a")
    assert not r.has("b")
    with pytest.raises(ValueError, match="must not be empty"):
        r.has(" ")
    with pytest.raises(TypeError):
        r.has(1)


def test_issues_are_a_multiset(spark):
    row = ("a", "m", "error", ["x"])
    r = report(spark, row, row)
    assert len(r.collect()) == 2
    assert r.summary().first().n == 2


@pytest.mark.parametrize(
    "make",
    [
        lambda: Issue("", "m"),
        lambda: Issue("c", " "),
        lambda: Issue("c", "m", "error"),
        lambda: Issue("c", "m", at=["x"]),
        lambda: Issue("c", "m", at=(1,)),
        lambda: Report([]),
    ],
)
def test_contracts(make):
    with pytest.raises((TypeError, ValueError)):
        make()
