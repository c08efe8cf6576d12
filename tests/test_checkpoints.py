"""Where intermediate results go."""

from types import SimpleNamespace

import pytest

from trailframe.plans.checkpoints import checkpoint_folder


def session(master, folder):
    seen = []
    sc = SimpleNamespace(master=master, getCheckpointDir=lambda: seen[-1] if seen else None, setCheckpointDir=seen.append)
    return SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda key, default: folder))


def test_checkpoint_folder():
    assert checkpoint_folder(session("spark://host:7077", "/shared/c")) == "/shared/c"
    assert checkpoint_folder(session("local[2]", None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_folder(session("spark://host:7077", None))
