"""Registry logs against a list of accounts that is searched for every command."""

from tallyforge.operators import accounts
from tallyforge.plans import sessions

SHAPE = "registry string, seq long, command string, account string, name string, version string"


def plain(rows, versions):
    out, lists, current = [], {}, {}
    for reg, seq, command, account, name, version in sorted(rows, key=lambda r: (r[0], r[1])):
        held = lists.setdefault(reg, [])
        mine = [a for a in held if a["id"] == account]
        name = (name or "").strip()[:80]
        taken = lambda v: any(a["id"] != account and a["version"] == v and a["name"] == name for a in held)  # noqa: B023, E731
        target = mine[0]["version"] if command == "rename" and mine else version
        if command not in ("create", "rename", "metadata", "activate", "delete"):
            why = "unknown_command"
        elif command == "create" and (account is None or mine):
            why = "exists"
        elif command != "create" and not mine:
            why = "not_found"
        elif command in ("create", "rename", "metadata") and not name:
            why = "empty_name"
        elif command in ("create", "rename", "metadata") and target not in versions:
            why = "unknown_version"
        elif command in ("create", "rename", "metadata") and taken(target):
            why = "name_taken"
        else:
            why = "accepted"
            if command == "create":
                held.append({"id": account, "version": version, "name": name})
            elif command in ("rename", "metadata"):
                mine[0].update(version=target, name=name)
            elif command == "delete":
                held.remove(mine[0])
            if command in ("create", "activate"):
                current[reg] = account
            elif command == "delete" and current.get(reg) == account:
                current[reg] = held[0]["id"] if held else None
        out.append((reg, seq, why, current.get(reg), len(held)))
    return sorted(out)


def test_whole_table(spark):
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in sessions.account_commands(spark, d).collect()]
    got = sorted(map(tuple, sessions.account_registry(spark, d).collect()))
    assert got == plain(rows, sessions.VERSIONS) and len(rows) > 5000
    assert {r[2] for r in got} == {"accepted", "unknown_command", "exists", "not_found", "empty_name", "unknown_version", "name_taken"}


def test_nulls_and_falling_back(spark):
    rows = [("r", 1, "create", "a", "x", "one"), ("r", 2, "create", "b", "x", "two"), ("r", 3, "create", None, "y", "one"), ("r", 4, "metadata", "b", " x ", "one"), ("r", 5, "delete", "b", None, None), ("r", 6, "delete", "a", None, None), ("r", 7, None, "a", "x", "one"), (None, 1, "create", "a", "x", "one")]
    got = [(r.seq, r.outcome, r.active) for r in accounts.registry_log(spark.createDataFrame(rows, SHAPE), ["one", "two"]).orderBy("seq").collect()]
    assert got == [(1, "accepted", "a"), (2, "accepted", "b"), (3, "exists", "b"), (4, "name_taken", "b"), (5, "accepted", "a"), (6, "accepted", None), (7, "unknown_command", None)]
