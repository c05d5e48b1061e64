"""Session settings from a TOML file with a closed set of keys."""

from __future__ import annotations

import tomllib
from pathlib import Path

from pyspark.sql import SparkSession

#: Keys that a file may have, and flags that must not be on.
KEYS = {"spark": dict, "catalogue": str, "locale": str, "allow_network": bool, "overwrite": bool}
UNSAFE = ("allow_network", "overwrite")


def load(path: str) -> dict[str, object]:
    """The settings of a file; unknown keys, wrong types and unsafe flags are errors."""
    found = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    unknown = sorted(set(found) - set(KEYS))
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    wrong = sorted(k for k, v in found.items() if not isinstance(v, KEYS[k]))
    if wrong:
        raise ValueError(f"settings of a wrong type: {', '.join(wrong)}")
    unsafe = [k for k in UNSAFE if found.get(k)]
    if unsafe:
        raise ValueError(f"unsafe settings: {', '.join(unsafe)}")
    return found


def apply(spark: SparkSession, path: str) -> dict[str, object]:
    """Set the ``spark`` table of a file on the session and return all settings."""
    found = load(path)
    for key, value in found.get("spark", {}).items():
        spark.conf.set(key, str(value))
    return found
