"""What an analysis may be connected to, with implementations over files, and settings from the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Protocol

from .operators.advise import flatten_plan
from .operators.report import Options
from .operators.store import HistoryStore
from .sources.slowlog import filesystem
from .sql.fingerprint import statement_kind
from .sql.lexer import tokenize

__all__ = ["Explainer", "FileExplainer", "FileSchemaSource", "HistoryStore", "SchemaSource", "Settings"]


class SchemaSource(Protocol):
    def ddl(self) -> str: ...


class Explainer(Protocol):
    def explain(self, class_id: str, sql: str) -> list[dict]: ...


class FileSchemaSource:
    """The DDL of a file, or of all ``.sql`` files of a folder in name order."""

    def __init__(self, uri: str):
        self.uri = uri

    def ddl(self) -> str:
        from pyarrow import fs

        system, path = filesystem(self.uri)
        names = [path]
        if system.get_file_info(path).type == fs.FileType.Directory:
            names = sorted(x.path for x in system.get_file_info(fs.FileSelector(path)) if x.path.endswith(".sql"))
        texts = []
        for name in names:
            with system.open_input_file(name) as source:
                texts.append(source.read().decode("utf-8", "replace"))
        return "\n".join(texts)


class FileExplainer:
    """Plans that were saved as ``<class id>.json`` in a folder; only SELECT statements have plans."""

    def __init__(self, uri: str):
        self.uri = uri

    def explain(self, class_id: str, sql: str) -> list[dict]:
        from pyarrow import fs

        system, path = filesystem(f"{self.uri}/{class_id}.json")
        if statement_kind(tokenize(sql)) != "SELECT" or system.get_file_info(path).type != fs.FileType.File:
            return []
        with system.open_input_file(path) as source:
            return flatten_plan(source.read().decode("utf-8"))


@dataclass(frozen=True)
class Settings:
    """Settings of an analysis; ``from_env`` reads ``TIDEMARK_`` and the field's name in capitals."""

    top: int = 20
    sort: str = "time"
    database: str = ""
    min_severity: str = "info"
    disable: tuple[str, ...] = field(default=())

    @classmethod
    def from_env(cls, environment: Mapping[str, str] | None = None) -> Settings:
        environment, found = os.environ if environment is None else environment, {}
        for name, default in (("top", 20), ("sort", ""), ("database", ""), ("min_severity", ""), ("disable", ())):
            value = environment.get(key := f"TIDEMARK_{name.upper()}")
            if value is None:
                continue
            if name == "top" and not value.isdigit():
                raise ValueError(f"{key} must be a whole number, not {value!r}")
            found[name] = int(value) if name == "top" else tuple(x.strip() for x in value.split(",") if x.strip()) if default == () else value
        return cls(**found)

    def options(self) -> Options:
        return Options(self.top, self.sort, self.database, self.min_severity, self.disable)
