"""Typed configuration from command lines and INI files, and a log of JSON lines."""

from __future__ import annotations

import configparser
import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Entry:
    """One parameter: its type (str, int, float, bool), whether it is a list or required, its default and allowed values."""

    name: str
    kind: type = str
    required: bool = False
    default: object = None
    allowed: Sequence[object] = ()
    many: bool = False
    help: str = ""

    def read(self, text: str) -> object:
        if self.kind is bool:
            low = text.strip().lower()
            if low not in ("true", "false", "yes", "no", "1", "0"):
                raise ValueError(f"{self.name}: {text} is neither true nor false")
            value: object = low in ("true", "yes", "1")
        else:
            value = self.kind(text.strip())
        if self.allowed and value not in self.allowed:
            raise ValueError(f"{self.name}: {value} is not one of {', '.join(map(str, self.allowed))}")
        return value


@dataclass
class Description:
    entries: dict[str, Entry] = field(default_factory=dict)

    def add(self, name: str, **options: object) -> Description:
        self.entries[name] = Entry(name, **options)
        return self

    def _finish(self, found: dict[str, object]) -> dict[str, object]:
        for e in self.entries.values():
            if e.name not in found:
                if e.required:
                    raise ValueError(f"the required parameter {e.name} is missing")
                if e.default is not None:
                    found[e.name] = e.default
        return found

    def parse_arguments(self, arguments: Sequence[str]) -> dict[str, object]:
        """Parameters of "--name value ..." words; a list takes all words up to the next name."""
        words: dict[str, list[str]] = {}
        now = None
        for w in arguments:
            if w.startswith("--"):
                now = w[2:]
                if now not in self.entries:
                    raise ValueError(f"there is no parameter {now}")
                words[now] = []
            elif now is None:
                raise ValueError(f"{w} belongs to no parameter")
            else:
                words[now].append(w)
        return self._finish({n: self._values(n, v) for n, v in words.items()})

    def parse_ini(self, text: str) -> dict[str, object]:
        """Parameters of the lines "name = value" before any section; lists are split at commas."""
        parser = configparser.ConfigParser(interpolation=None)
        parser.optionxform = str
        parser.read_string("[global]\n" + text)
        found = {}
        for name, value in parser["global"].items():
            if name not in self.entries:
                raise ValueError(f"there is no parameter {name}")
            found[name] = self._values(name, value.split(",") if self.entries[name].many else [value] if value else [])
        return self._finish(found)

    def _values(self, name: str, words: list[str]) -> object:
        entry = self.entries[name]
        if not words:
            raise ValueError(f"the parameter {name} has no value")
        if entry.many:
            return [entry.read(w) for w in words]
        if len(words) > 1:
            raise ValueError(f"the parameter {name} has several values")
        return entry.read(words[0])


class JsonLines:
    """A log of one JSON object a line, with metadata that every line repeats."""

    def __init__(self, path: str, **metadata: object):
        self.path, self.metadata = path, metadata

    def write(self, **values: object) -> None:
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(json.dumps(self.metadata | values) + "\n")

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.json(self.path)
