"""A vector store in a folder, for the tests of the export."""

import json
import os
from pathlib import Path

from pyspark import TaskContext

from textloom.operators.export import VectorStore


class FolderStore(VectorStore):
    """Staged batches are files below `staged`, published ones below `seen`. fails: task attempts below this number break after their first batch."""

    def __init__(self, path, fails=0):
        self.path, self.fails = str(path), fails

    def create(self, dimension, properties):
        for name in ("staged", "seen"):
            (Path(self.path) / name).mkdir(exist_ok=True)
        (Path(self.path) / "schema.json").write_text(json.dumps([dimension, properties]))

    def stage(self, key, batch):
        n = len(list((Path(self.path) / "staged").glob(f"{key}.*")))
        (Path(self.path) / "staged" / f"{key}.{n}").write_text(json.dumps(batch))
        if TaskContext.get().attemptNumber() < self.fails and TaskContext.get().partitionId() == 1:
            raise RuntimeError("the connection broke")

    def publish(self, keys):
        for key in keys:
            for p in (Path(self.path) / "staged").glob(f"{key}.*"):
                os.replace(p, Path(self.path) / "seen" / p.name)

    def discard(self, prefix):
        for p in (Path(self.path) / "staged").glob(f"{prefix}*"):
            p.unlink()

    def batches(self, where="seen"):
        return [json.loads(p.read_text()) for p in (Path(self.path) / where).iterdir()]
