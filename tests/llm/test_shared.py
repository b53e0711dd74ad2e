from __future__ import annotations

import pytest

from streetbook.llm import shared


class Session:
    """The settings of a session."""

    def __init__(self, **values):
        self.conf, self.values = self, values

    def get(self, key, default=None):
        return self.values.get(key.rpartition(".")[2] if key == "spark.master" else "dir", default)

    def set(self, key, value):
        self.values["dir"] = value


def test_a_cluster_must_name_a_shared_folder():
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1000]"):
        with pytest.raises(RuntimeError):
            shared.shared_folder(Session(master=master))
        assert shared.shared_folder(Session(master=master, dir="hdfs://x")) == "hdfs://x"
    local = Session(master="local[4]")
    assert shared.shared_folder(local) == shared.shared_folder(local) != ""
