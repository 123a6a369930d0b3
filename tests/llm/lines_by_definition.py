"""Line dedup by definition, for small tables with distinct doc_ids."""

import re


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def kept_lines(rows, least=20):
    """(doc_id, text) without lines that repeat an earlier one, or are within two edits of one; nulls come first."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    first = {}
    for k, (_, t) in enumerate(rows):
        for n, x in enumerate((t or "").split("\n")):
            if re.search(r"[^\x20\x09-\x0D]", x):
                first.setdefault(x.strip(" "), (k, n))
    long = [x for x in first if len(x) >= least]
    late = {x for x in long for y in long if first[y] < first[x] and abs(len(x) - len(y)) <= 2 and edits(x, y) <= 2}
    out = []
    for k, (i, t) in enumerate(rows):
        keep = lambda n, x: x not in first or (first[x] == (k, n) and x not in late)  # noqa: B023, E731
        out.append((i, None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if keep(n, x.strip(" ")))))
    return out
