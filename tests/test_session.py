"""Where scratch data goes."""

from types import SimpleNamespace

import pytest

from driftline import session


def fake(master, configured=None):
    conf = SimpleNamespace(get=lambda key, default=None: configured or default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"))


def test_configured_folder_wins():
    assert session.shared_dir(fake("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    assert session.scratch_path(fake("local[2]", "/shared"), "x").startswith("/shared/driftline/x-")


def test_only_a_local_master_may_use_a_temporary_folder():
    with pytest.raises(RuntimeError):
        session.shared_dir(fake("yarn"))
    local = fake("local[2]")
    assert session.shared_dir(local) == session.shared_dir(local)
