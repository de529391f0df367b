"""Shared folder rules."""

import types

import pytest

from tickloom import session


def fake(master, named=None):
    return types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda key, default=None: named if key == "spark.checkpoint.dir" else default),
                                 sparkContext=types.SimpleNamespace(master=master, applicationId="app-of-test-session"))


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"])
def test_cluster_needs_a_named_folder(master):
    with pytest.raises(RuntimeError):
        session.shared_dir(fake(master))
    assert session.shared_dir(fake(master, "file:///shared/")) == "file:///shared"


def test_local_run_may_use_its_own_folder():
    assert session.shared_dir(fake("local[4]"))
