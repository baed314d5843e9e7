"""What the jobs' command lines share: a small JSON config, overridden by arguments, and a log."""

from __future__ import annotations

import argparse
import json
import logging


def arguments(description: str, names: list[str]) -> dict:
    """The values of *names*: from ``--config FILE`` (a JSON object), and from ``--name VALUE``, which goes before it."""
    parser = argparse.ArgumentParser(description=description)
    parser.add_argument("--config", help="a JSON file")
    for name in names:
        parser.add_argument(f"--{name.replace('_', '-')}")
    given = vars(parser.parse_args())
    values = {}
    if given.pop("config", None):
        with open(parser.parse_args().config, encoding="utf-8") as f:
            values = json.load(f)
    if unknown := values.keys() - set(names):
        parser.error(f"unknown settings: {', '.join(sorted(unknown))}")
    values |= {k: v for k, v in given.items() if v is not None}
    return values


def start_log() -> None:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
