"""The command line prints whole results."""

import json

import pytest

from edgeweave import cli


@pytest.mark.parametrize("form", ["table", "json", "csv"])
def test_all_rows_are_printed(spark, capsys, form):
    df = spark.range(1500).selectExpr("id", "if(id = 7, null, concat('a,\"', id)) AS name")
    cli._print(df, form)
    out = capsys.readouterr().out
    if form == "json":
        rows = json.loads(out)
        assert len(rows) == 1500 and rows[7] == {"id": 7, "name": None}
    else:
        assert len(out.splitlines()) == 1501
    cli._print(df.limit(0), form)
    assert capsys.readouterr().out.strip() in ("[]", "id,name") or form == "table"
