"""Registries of accounts: commands that are accepted or refused, and the account that is active after each.

Names are unique within a game version of a registry, so each outcome depends on all before it: commands are streamed over partitions sorted by registry and seq,
which keep one registry's accounts (what one user has on one device) at a time, however long its log.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

MOST = 80  # characters of a name
OUTPUT = "registry string, seq long, outcome string, active string, accounts int"
_NAMES = [c.split(" ")[0] for c in OUTPUT.split(", ")]


@dataclass
class Registry:
    """held: account -> (version, name), the oldest first; used: who has a (version, name)."""

    held: dict[str, tuple[str, str]] = field(default_factory=dict)
    used: dict[tuple[str, str], str] = field(default_factory=dict)
    active: str | None = None

    def take(self, command: str, account: str | None, name: str | None, version: str | None, versions: frozenset[str]) -> str:
        """accepted, or why not: unknown_command, exists, not_found, empty_name, unknown_version or name_taken."""
        if command not in ("create", "rename", "metadata", "activate", "delete"):
            return "unknown_command"
        if command == "create" and (account is None or account in self.held):
            return "exists"
        if command != "create" and account not in self.held:
            return "not_found"
        if command == "activate":
            self.active = account
        elif command == "delete":
            del self.used[self.held.pop(account)]
            if self.active == account:
                self.active = next(iter(self.held), None)
        else:
            key = (self.held[account][0] if command == "rename" else version, (name or "").strip()[:MOST])
            if not key[1]:
                return "empty_name"
            if key[0] not in versions:
                return "unknown_version"
            if self.used.get(key, account) != account:
                return "name_taken"
            if account in self.held:
                del self.used[self.held[account]]
            self.held[account], self.used[key] = key, account
            if command == "create":
                self.active = account
        return "accepted"


def registry_log(commands: DataFrame, versions: list[str]) -> DataFrame:
    """(registry, seq, command, account, name, version) -> registry, seq, outcome, active, accounts (how many there are).

    create makes an account and activates it; rename changes its name, metadata its name and version; delete of the active account falls back to the oldest that is left. Rows of a null registry or seq are
    no commands; seq is unique in a registry.
    """
    allowed = frozenset(versions)

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, Registry()
        for f in frames:
            out = []
            for row in f.itertuples(index=False):
                if row.registry != last:
                    last, state = row.registry, Registry()
                values = [None if x is None or x != x else x for x in (row.command, row.account, row.name, row.version)]
                out.append((row.registry, row.seq, state.take(*values, allowed), state.active, len(state.held)))
            yield pd.DataFrame(out, columns=_NAMES)

    c = commands.selectExpr("cast(registry as string) registry", "cast(seq as long) seq", "command", "cast(account as string) account", "name", "version").where("registry is not null and seq is not null")
    return c.repartition("registry").sortWithinPartitions("registry", "seq").mapInPandas(fold, OUTPUT)
