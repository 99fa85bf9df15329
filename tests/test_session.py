import subprocess
import sys
from types import SimpleNamespace

import pytest

from duelframe import session


def plain(master, app="app-1", root=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: root), sparkContext=SimpleNamespace(master=master, applicationId=app))


def test_named_folder_is_used():
    assert session.shared_root(plain("spark://x", root="/shared")) == "/shared"


def test_local_session_gets_one_folder():
    a, b = session.shared_root(plain("local[2]")), session.shared_root(plain("local[2]"))
    assert a == b and session.shared_root(plain("local[*]", "app-2")) != a


def test_cluster_has_to_name_one():
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_root(plain(master))


def test_lineage_is_cut_without_the_setting(tmp_path):
    """A fresh session without any settings file."""
    code = "from duelframe.session import build_session, cut_lineage; s = build_session('x', 'local[1]'); assert not s.conf.get('spark.checkpoint.dir', None); assert cut_lineage(s.range(3), 'x').count() == 3"
    import os
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    assert subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, timeout=120).returncode == 0
