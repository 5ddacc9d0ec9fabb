"""Results of jobs, kept under a fingerprint of what they were made from."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from innsight.sources.scratch import file_system, move_new, remove_folder, scratch_folder, shared_folder


def fingerprint(spark: SparkSession, inputs: list[DataFrame], parameters: dict) -> str:
    """A digest of the files that frames read (name, length, time of change), of the
    frames' columns and of parameters. One listing for each folder; no file is opened."""
    files, seen = {}, []
    for df in inputs:
        if not df.inputFiles():
            raise ValueError("only stored tables have a fingerprint")
        for folder in sorted({os.path.dirname(f) for f in df.inputFiles()} - files.keys()):
            system, path = file_system(spark, folder)
            files[folder] = {
                s.getPath().getName(): [s.getLen(), s.getModificationTime()] for s in system.listStatus(path)
            }
        names = sorted(df.inputFiles())
        known = [files[os.path.dirname(f)].get(os.path.basename(f)) for f in names]
        seen.append([list(zip(names, known)), df.schema.json()])
    text = json.dumps([seen, parameters], sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:32]


def kept_run(
    spark: SparkSession,
    name: str,
    inputs: list[DataFrame],
    build: Callable[[str], None],
    root: str | None = None,
    **parameters,
) -> str:
    """The folder with what ``build`` has written for these inputs and parameters.

    ``build`` gets a folder to write to and runs only where no earlier run has done so.
    Its folder gets its name when all is written, so a run that fails leaves nothing
    that counts, and of two at once the first one counts. Changed input files give
    another fingerprint; results of former inputs stay until somebody clears them.
    """
    folder = f"{root or shared_folder(spark) + '/runs'}/{name}-{fingerprint(spark, inputs, parameters)}"
    files, path = file_system(spark, folder)
    if not files.exists(path):
        draft = scratch_folder(spark, f"draft-{name}")
        build(draft)
        files.mkdirs(path.getParent())
        if not move_new(spark, draft, folder):
            remove_folder(spark, draft)
    return folder
