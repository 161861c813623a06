"""The similarity of labels in plain Python, which joins and resolutions are compared with."""

import re

from parley.functions import text as T


def norm(s):
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", " ", s.lower())).strip()


def toks(s):
    return [w for w in norm(s).split(" ") if len(w) >= 2 and w not in T.STOP_ENTITY]


def alike(a, b):
    x, y = toks(a), toks(b)
    if not x or not y:
        return 0.0
    g, h = ({s[i : i + 3] for i in range(len(s) - 2)} for s in (norm(a), norm(b)))
    dice = 2 * len(g & h) / (len(g) + len(h)) if g and h else 0.0
    return min(1.0, 0.6 * len({*x} & {*y}) / len({*x} | {*y}) + 0.4 * dice + 0.15 * (x[-1] == y[-1]))


def dashed(label):
    return re.sub("^-|-$", "", re.sub("[^a-z0-9]+", "-", label.lower()))
