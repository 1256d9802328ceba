"""Exports that a service makes ready for fetching: asked for, confirmed, waited for, and fetched as an archive of files.

What talks to the service is passed in, so that the steps can be run against anything.
"""

from __future__ import annotations

import io
import time
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: States of an export (fixed values); all others are waited for.
READY, REFUSED = 3, 4


class Service(Protocol):
    """What an export needs of a service; each call may fail in any way."""

    def ask(self, request: dict) -> str: ...

    def confirm(self, token: str) -> None: ...

    def state(self, token: str) -> dict: ...

    def fetch(self, token: str) -> bytes: ...


@dataclass(frozen=True)
class Export:
    """``status``: ready, refused, late, or failed; ``archive`` only if ready, ``error`` if not."""

    status: str
    token: str | None = None
    archive: bytes | None = None
    error: str | None = None


def request(day: str, email: str = "", form: str = "XML") -> dict:
    """What is asked for: the acts published on a day, YYYY-MM-DD."""
    wanted = {"annoProvvedimento": int(day[:4]), "dataInizioPubProvvedimento": day, "dataFinePubProvvedimento": day, "filtriMap": {}, "orderType": "score", "limitaAnniVigenza": False}
    return {"formato": form, "richiestaExport": "M", "modalita": "C", "tipoRicerca": "A", "email": email, "parametriRicerca": wanted}


def export(service: Service, wanted: dict, every: float = 5.0, most: float = 300.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Export:
    """Ask, confirm, wait up to ``most`` seconds, fetch. A state that can't be read is asked for again; any other failure ends it."""
    token = None
    try:
        token = service.ask(wanted).strip().strip('"')
        service.confirm(token)
        end = clock() + most
        while clock() < end:
            try:
                state = service.state(token)
            except Exception:  # noqa: BLE001 the next one may be read
                state = {}
            if state.get("stato") == READY:
                return Export("ready", token, service.fetch(token))
            if state.get("stato") == REFUSED:
                return Export("refused", token, error=state.get("descrizioneErrore"))
            sleep(every)
    except Exception as e:  # noqa: BLE001 a service may fail in any way
        return Export("failed", token, error=f"{type(e).__name__}: {e}")
    return Export("late", token, error=f"not ready after {most:g} s")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("path", pa.string()), ("content", pa.binary()), ("error", pa.string())])
    for b in batches:
        for path, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            try:
                with zipfile.ZipFile(io.BytesIO(raw or b"")) as z:
                    for name in z.namelist():
                        if name.lower().endswith(".xml"):
                            yield pa.RecordBatch.from_pylist([{"path": f"{path}!{name}", "content": z.read(name), "error": None}], schema=schema)
            except (zipfile.BadZipFile, zipfile.LargeZipFile, RuntimeError, NotImplementedError, OSError) as e:
                yield pa.RecordBatch.from_pylist([{"path": path, "content": None, "error": str(e)}], schema=schema)


def members(archives: DataFrame) -> DataFrame:
    """``(path, content, error)`` of the XML files in archives (``path, content``); what is no archive gives one row that says so."""
    return archives.select("path", "content").mapInArrow(_members, "path string, content binary, error string")


def read(spark: SparkSession, directory: str) -> DataFrame:
    """The XML files of all archives below a directory, ready to be parsed."""
    return members(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(directory))


@dataclass(frozen=True)
class Outcome:
    source: str
    status: str
    rows: int | None
    error: str | None
    seconds: float


def run_all(sources: dict[str, Callable[[], int | None]]) -> list[Outcome]:
    """Run all sources one after the other, each on its own: one that fails is reported, and the others go on."""
    out = []
    for name, source in sources.items():
        began = time.monotonic()
        try:
            rows, error = source(), None
        except Exception as e:  # noqa: BLE001 a source may fail in any way
            rows, error = None, f"{type(e).__name__}: {e}"[:500]
        out.append(Outcome(name, "failed" if error else "done", rows, error, round(time.monotonic() - began, 3)))
    return out


def statuses(spark: SparkSession, outcomes: list[Outcome]) -> DataFrame:
    """Outcomes as a table."""
    return spark.createDataFrame([(o.source, o.status, o.rows, o.error, o.seconds) for o in outcomes], "source string, status string, `rows` bigint, error string, seconds double")
