"""Witness figures hold, and the command line reports them."""

from loomery import cli, witness
from loomery.errors import BadRequest, LoomeryError, NotThere, Stopped, TooLate


def test_all_witnesses_hold(spark):
    rows = witness.testify(spark).collect()
    assert len(rows) >= 18 and not [r for r in rows if not r["holds"]]


def test_command_line(capsys):
    assert cli.main([]) == 2
    assert cli.main(["list"]) == 0 and "asof" in capsys.readouterr().out.split()


def test_errors_are_one_family():
    assert all(issubclass(e, LoomeryError) for e in (BadRequest, NotThere, TooLate, Stopped))
