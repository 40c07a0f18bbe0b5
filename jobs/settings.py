"""Config files of the jobs, and their log."""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path


def log(name: str) -> logging.Logger:
    return logging.getLogger(f"jobs.{name}")


def defaults(name: str) -> dict:
    """The config file that lies beside the job."""
    return json.loads(Path(__file__).with_name(f"{name}.json").read_text())


def from_command_line(name: str, about: str, argv: list[str] | None = None) -> dict:
    """Config of the file given by --config (or the job's own), with single values replaced by options of their name."""
    known = defaults(name)
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=about)
    parser.add_argument("--config", type=Path, help="JSON file; its values replace the job's own")
    for key, value in known.items():
        parser.add_argument(f"--{key.replace('_', '-')}", type=type(value), help=f"default {value!r}")
    given = vars(parser.parse_args(argv))
    file = given.pop("config")
    chosen = json.loads(file.read_text()) if file else {}
    if unknown := set(chosen) - set(known):
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return known | chosen | {k: v for k, v in given.items() if v is not None}
