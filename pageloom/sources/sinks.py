"""Writing what a resource yields."""

from __future__ import annotations

from pageloom.site import Result


def write_result(result: Result, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Data, warnings and meta as three folders under ``path``; pages are walked and parsed once for all."""
    result = result.staged()
    for name in ("data", "warnings", "meta"):
        getattr(result, name).write.mode(mode).format(fmt).save(f"{path}/{name}")
