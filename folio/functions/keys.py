"""Keys, names and reading instructions: plain functions used before any plan is made."""

from __future__ import annotations

import hashlib
import random
import re
import warnings
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

_NAME = re.compile(r"^[^.,]+\.\d{4}-\d{2}-\d{2},\d{4}-\d{2}-\d{2}(\..+)?$")


def join_key(*parts: str | None) -> str:
    """The parts that are neither None nor blank, joined by slashes."""
    return "/".join(p for p in parts if p)


def with_prefix(key: str, prefix: str | None) -> str:
    """The key below a prefix, if there is one."""
    return join_key(prefix.strip("/") if prefix else None, key)


def draw(seed: int | None, n: int) -> int:
    """A place among ``n``, each as likely as the others: by the digest of the seed, which SQL has as well; without a seed, any."""
    return random.randrange(n) if seed is None else int(hashlib.md5(str(seed).encode()).hexdigest()[:15], 16) % n


def warn_if_unusual_name(name: str) -> bool:
    """Warns of a dataset name that isn't ``name.first-day,last-day[.comment]``; whether it is."""
    usual = bool(_NAME.match(name))
    if not usual:
        warnings.warn(f"dataset name {name!r} is not like 'name.2022-01-01,2022-02-01.comment'", stacklevel=2)
    return usual


@dataclass(frozen=True)
class Instruction:
    """Read a channel: all its columns, or those named."""

    channel: str
    columns: tuple[str, ...] | None = None

    @staticmethod
    def of(value: Instruction | Mapping | str) -> Instruction:
        if isinstance(value, Instruction):
            return value
        if isinstance(value, str):
            return Instruction(value)
        if not isinstance(value, Mapping) or not isinstance(value.get("channel"), str):
            raise TypeError(f"not a channel instruction: {value!r}")
        columns = value.get("columns")
        return Instruction(value["channel"], None if columns is None else tuple(columns))


def merge_instructions(instructions: Iterable[Instruction | Mapping | str]) -> list[Instruction]:
    """One instruction for each channel, by name: the union of the columns in order of first mention.

    An instruction without columns asks for all, and so does the merged one.
    """
    merged: dict[str, dict[str, None] | None] = {}
    for one in map(Instruction.of, instructions):
        if one.channel not in merged:
            merged[one.channel] = {}
        if one.columns is None:
            merged[one.channel] = None
        elif (held := merged[one.channel]) is not None:
            held.update(dict.fromkeys(one.columns))
    return [Instruction(c, None if cols is None else tuple(cols)) for c, cols in sorted(merged.items())]


def checked_instructions(instructions: Sequence | None) -> list[Instruction] | None:
    """Merged instructions; None stays None and means every channel."""
    if instructions is None:
        return None
    if isinstance(instructions, str | Mapping) or not isinstance(instructions, Sequence):
        raise TypeError("instructions must be a list")
    return merge_instructions(instructions)
