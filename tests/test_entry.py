"""The entry file: with the whole tree, and without what may be removed from it."""

import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from tidemark.plans import registered as plans
from tidemark.sources.shared import shared_folder

from .conftest import ROOT


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(plans.QUERIES) <= set(entry.queries())


def test_entry_without_the_llm_folders(tmp_path):
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    shutil.copytree(ROOT / "tidemark", tmp_path / "tidemark", ignore=lambda folder, names: ["llm"] if folder.endswith("tidemark") else ["__pycache__"])
    code = "import __spark_entry__ as e; print(sorted(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout
    assert out.strip() == str(sorted(plans.QUERIES))


class Session:
    """A session's settings, without Spark."""

    def __init__(self, **settings):
        self.conf, self.settings = self, {k.replace("_", "."): v for k, v in settings.items()}

    def get(self, key, default=None):
        return self.settings.get(key, default)

    def set(self, key, value):
        self.settings[key] = value


def test_shared_folder():
    assert shared_folder(Session(spark_master="yarn", spark_checkpoint_dir="s3a://b/x/")) == "s3a://b/x"
    local = Session(spark_master="local[2]")
    assert shared_folder(local) == shared_folder(local) == local.settings["spark.checkpoint.dir"]
    with pytest.raises(ValueError):
        shared_folder(Session(spark_master="yarn"))
