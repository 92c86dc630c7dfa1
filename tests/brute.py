"""The rules in plain Python, one step at a time, for comparison on small inputs."""

from __future__ import annotations

from collections import defaultdict


def greedy(rows, group, axes, minimum, strict=True):
    """Rows are dicts with user_id, group columns and value. Events, statuses, causes."""
    status = {i: "A" for i in range(len(rows))}
    cause: dict[int, int] = {}
    events = []
    while True:
        totals = defaultdict(lambda: [0, 0])
        for i, row in enumerate(rows):
            if status[i] == "A":
                entry = totals[tuple(row[g] for g in group)]
                entry[0] += row["value"]
                entry[1] += 1
        best = min(totals, key=lambda g: (-totals[g][0], g), default=None)
        if best is None:
            break
        total, count = totals[best]
        if not (total > minimum if strict else total >= minimum):
            break
        rank = len(events) + 1
        events.append((rank, *best, total, count))
        taken = set()
        for i, row in enumerate(rows):
            if status[i] == "A" and tuple(row[g] for g in group) == best:
                status[i] = "B"
                cause[i] = rank
                taken.update((row["user_id"], axis, row[axis]) for axis in axes)
        for i, row in enumerate(rows):
            if status[i] == "A" and any((row["user_id"], a, row[a]) in taken for a in axes):
                status[i] = "C"
                cause[i] = rank
    return events, status, cause


def fold(machine, start, asked):
    """Verdicts and final status of requests on one key."""
    table = {(old, new): (ok, text) for old, new, ok, text in machine}
    verdicts = []
    for new in asked:
        ok, text = table.get((start, new), (False, "undefined transition"))
        verdicts.append((ok, text))
        if ok:
            start = new
    return verdicts, start
