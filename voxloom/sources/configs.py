"""Run settings: YAML or JSON files, with placeholders filled in."""

from __future__ import annotations

import json

from voxloom.sources.files import read_bytes


def load(path: str) -> dict:
    """A settings file; YAML needs its package, JSON does not."""
    text = read_bytes(path).decode()
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs the yaml package") from e
    return yaml.safe_load(text)


def filled(urls: str | list[str], **values: object) -> str | list[str]:
    """Placeholders such as {num_codebooks} filled in, in one address or each of a list."""
    return urls.format(**values) if isinstance(urls, str) else [u.format(**values) for u in urls]


def output_address(urls: object, **values: object) -> str:
    """As filled, for an address to write to, of which there is one."""
    if not isinstance(urls, str):
        raise TypeError("an output address must be one string")
    return urls.format(**values)
