"""A store of finished stages: kept by their parameters and by the state of their input files, reused and expired."""

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from hotgrid.session import scratch_folder

MARK = "_COMPLETE"


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def fingerprint(inputs: Sequence[DataFrame]) -> str:
    """Hash of the path, length and time of every file the inputs are read from."""
    seen = []
    for df in inputs:
        for name in sorted(df.inputFiles()):
            path, fs = _path(df.sparkSession, name)
            status = fs.getFileStatus(path)
            seen.append((name, status.getLen(), status.getModificationTime()))
    return hashlib.sha256(json.dumps(seen).encode()).hexdigest()


def root(spark: SparkSession) -> str:
    """Where stages are kept: in the shared checkpoint folder, so that later sessions find them too."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    return f"{shared}/stages" if shared else f"{scratch_folder(spark, 'x').rsplit('/', 1)[0]}/stages"


def stored(
    spark: SparkSession, name: str, params: Mapping, inputs: Sequence[DataFrame], build: Callable[[str], None], at: str | None = None
) -> str:
    """The folder of a stage: built by ``build(folder)`` if there is none for these parameters and input files.

    A stage is built beside its place and moved there when it is whole, so a run that dies leaves nothing half done, and of
    two runs that build at once the first one counts.
    """
    key = hashlib.sha256(json.dumps([dict(params), fingerprint(inputs)], sort_keys=True, default=str).encode()).hexdigest()[:24]
    folder = f"{at or root(spark)}/{name}/{key}"
    target, fs = _path(spark, folder)
    if not fs.exists(_path(spark, f"{folder}/{MARK}")[0]):
        draft = f"{at or root(spark)}/{name}/draft-{uuid.uuid4().hex}"
        build(draft)
        fs.create(_path(spark, f"{draft}/{MARK}")[0]).close()
        if fs.exists(target) or not fs.rename(_path(spark, draft)[0], target):
            fs.delete(_path(spark, draft)[0], True)
    return folder


def expire(spark: SparkSession, name: str, older_than_sec: float, at: str | None = None) -> int:
    """Delete the stages of a name that were finished longer ago, drafts of dead runs included; returns how many."""
    folder, fs = _path(spark, f"{at or root(spark)}/{name}")
    if not fs.exists(folder):
        return 0
    limit, gone = (time.time() - older_than_sec) * 1000, 0
    for status in fs.listStatus(folder):
        if status.getModificationTime() <= limit:
            gone += bool(fs.delete(status.getPath(), True))
    return gone
