"""Running the program: once on the driver, or for every key of a panel on the executors."""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from seriesloom.functions.frequency import Frequency
from seriesloom.functions.period import Period
from seriesloom.plans import options
from seriesloom.plans.frame import SeriesFrame
from seriesloom.x13 import read
from seriesloom.x13.spec import Data, Spec, new_spec, x11
from seriesloom.x13.write import write

PREFIX = "seriesloom-x13-"


def program(path: str | None = None) -> str:
    """The program's path: as given, else the option x13path, else x13as on the PATH."""
    found = path or options.get("x13path") or shutil.which("x13as") or shutil.which("x13as_ascii")
    if found and Path(found).is_dir():
        found = str(Path(found) / "x13as")
    if not found or not os.access(found, os.X_OK):
        raise RuntimeError("X-13ARIMA-SEATS was not found; set the option x13path to its binary")
    return found


class Outputs(Mapping):
    """Files of a run by extension, read when they are first asked for."""

    def __init__(self, files: dict[str, Path], freq: Frequency):
        self._files, self._freq, self._read = files, freq, {}

    def __getitem__(self, name: str) -> Any:
        if name not in self._read:
            self._read[name] = read.read(self._files[name], self._freq)
        return self._read[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._files)

    def __len__(self) -> int:
        return len(self._files)

    def __repr__(self) -> str:
        return f"Outputs({', '.join(self._files)})"


@dataclass
class Result:
    """What a run left: its outputs, messages and folder."""

    spec_text: str
    stdout: str
    outputs: Outputs
    messages: read.Messages = field(default_factory=read.Messages)
    folder: str = ""


def run_text(text: str, freq: Frequency, *, binary: str | None = None, folder: str | None = None) -> Result:
    """Run a specification's text in a folder; errors that the program reports raise RuntimeError."""
    folder = folder or tempfile.mkdtemp(prefix=PREFIX)
    Path(folder, "spec.spc").write_text(text, encoding="utf-8")
    Path(folder, "graphics").mkdir(exist_ok=True)
    command = [program(binary), "-I", str(Path(folder, "spec")), "-G", str(Path(folder, "graphics")), "-S"]
    done = subprocess.run(command, cwd=folder, capture_output=True, text=True, errors="replace", timeout=3600, check=False)
    files = {p.suffix[1:]: p for d in (Path(folder, "graphics"), Path(folder)) for p in sorted(d.glob("spec.*")) if p.suffix != ".spc"}
    outputs = Outputs(files, freq)
    found = outputs["err"] if "err" in files else read.Messages()
    errors = found.errors + [x.strip() for x in done.stdout.split("\n") if "ERROR:" in x]
    if errors or done.returncode:
        raise RuntimeError("X-13 reports: " + ("; ".join(errors) or done.stderr.strip() or f"status {done.returncode}"))
    return Result(text, done.stdout, outputs, found, folder)


def run(spec: Spec, *, binary: str | None = None) -> Result:
    folder = tempfile.mkdtemp(prefix=PREFIX)
    return run_text(write(spec, folder=folder), spec.series.data.freq, binary=binary, folder=folder)


def deseasonalize(s: SeriesFrame, *, binary: str | None = None) -> SeriesFrame:
    """The seasonally adjusted series (table d11 of the default x11 job) of every key.

    The program runs on the executors, once per key and variable, so it has to be installed there under the same path.
    """
    path, freq, keys, cols = program(binary), s.freq, list(s.keys), list(s.cols)

    def adjust(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("mit")
        out = {k: pdf[k] for k in [*keys, "mit"]}
        first = Period(freq, int(pdf["mit"].iloc[0]))
        for c in cols:
            result = run(new_spec(Data.of(first, pdf[c].tolist()), x11(save="d11")), binary=path)
            data = result.outputs["d11"]
            at = {data.first.value + i: v for i, v in enumerate(data.values)}
            out[c] = [at.get(t, np.nan) for t in pdf["mit"]]
            shutil.rmtree(result.folder, ignore_errors=True)
        return pd.DataFrame(out)

    types = dict(s.df.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "mit long", *(f"`{c}` double" for c in cols)])
    grouped = s.df.withColumn("_one", F.lit(0)).groupBy(*(keys or ["_one"]))
    return s.with_values(grouped.applyInPandas(adjust, schema))


def cleanup_folders(remove: bool = False) -> list[str]:
    """Folders that runs left on this machine; removes them if asked to."""
    found = sorted(str(p) for p in Path(tempfile.gettempdir()).glob(PREFIX + "*"))
    for p in found if remove else ():
        shutil.rmtree(p, ignore_errors=True)
    return found
