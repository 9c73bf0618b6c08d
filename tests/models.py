"""Plain list models of the list operators, used as oracles in tests."""


def compute(old, new, same=lambda a, b: a == b):
    last = {r[0]: r for r in old}
    now = {r[0] for r in new}
    creates = [("create", r) for r in new if r[0] not in last]
    updates = [("update", r) for r in new if r[0] in last and not same(last[r[0]], r)]
    deletes = [("delete", r) for r in old if r[0] not in now]
    return creates + updates + deletes


def apply(base, entries):
    place = {r[0]: i for i, r in enumerate(base)}
    rows = list(base)
    added = []
    for op, r in entries:
        at = place.get(r[0])
        if op == "create" and at is None:
            added.append(r)
        elif op == "update" and at is not None:
            rows[at] = r
        elif op == "delete" and at is not None:
            rows[at] = None
            del place[r[0]]
    return [r for r in rows if r is not None] + added


def apply_all(base, deltas):
    for d in deltas:
        base = apply(base, d)
    return base


def sections(text):
    """(heading, content, first line, last line) of each kept section."""
    parts = text.split("\n")
    if parts and parts[-1] == "":
        parts.pop()
        parts = [p[:-1] if p.endswith("\r") else p for p in parts]
    else:
        parts = [p[:-1] if p.endswith("\r") else p for p in parts[:-1]] + parts[-1:]
    marks = [i for i, p in enumerate(parts) if p.startswith("## ")]
    cuts = ([0] if not marks or marks[0] else []) + marks + [len(parts)]
    out = []
    for a, b in zip(cuts, cuts[1:]):
        body = "\n".join(parts[a:b])
        if not body.strip():
            continue
        heading = None
        if parts[a].startswith("## "):
            heading = parts[a]
            while heading.startswith("## "):
                heading = heading[3:]
            heading = heading.strip()
        out.append((heading, body, a + 1, b))
    return out
