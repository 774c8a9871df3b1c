"""Plain versions of the operators, row by row, to hold the results against."""

from __future__ import annotations

import hashlib
import re

SPACE = r"[^\x20\x09-\x0D]+"


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def shingle_set(text, k=5):
    w = re.findall(SPACE, lower(text))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < k else frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def link_classes(rows, percent=80):
    """[(doc_id, n_shingles, component_id)] of (doc_id, text) rows."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    return [(d, len(sets[i]), min((x for x in ids[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows)]


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text):
    text = text or ""
    out = []
    for rank, (kind, pattern) in enumerate(
        (
            ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
            ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"),
            ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
        )
    ):
        for m in re.finditer(pattern, text):
            v = m.group()
            digits = re.sub("[^0-9]", "", v)
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in v.split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{k}:{a}:{z}" for a, _, z, k in sorted(out))


def fill_middle(doc_id, text, seed=7):
    """(n, form, prefix_chars, middle_chars, output) by slicing strings."""
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in range(0, 32, 8)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    p, m, s = ("".join(units[x]) for x in (slice(a), slice(a, b), slice(b, None)))
    if h[3] % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def loads(sizes, shards):
    """Loads after longest-processing-time scheduling."""
    out = [0] * shards
    for size in sorted(sizes, reverse=True):
        out[out.index(min(out))] += size
    return sorted(out)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(row):
    """All levels of the tree over a list of hashes."""
    out = [row]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def merkle(rows, hit):
    """[(doc_id, leaf, subroot, root, siblings, folded root)] of (doc_id, source, lang, n_chars, text) rows; ``hit`` ids are tampered with."""
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {}
    for lang in order:
        trees[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        built[lang] = levels([leaf(r) for r in trees[lang]])
    top = levels([built[lang][-1][0] for lang in order])
    out = []
    for k, lang in enumerate(order):
        for i, r in enumerate(trees[lang]):
            changed = r[:3] + (None if r[3] is None else r[3] + 1,) + r[4:] if r[0] is not None and hit(r[0]) else r
            h, found = leaf(changed), []
            for tree, at in ((built[lang], i), (top, k)):
                for level in tree[:-1]:
                    other = level[at ^ 1] if at ^ 1 < len(level) else ""
                    found += [other] if other else []
                    h = sha(other + h if at % 2 else h + other)
                    at //= 2
            out.append((r[0], built[lang][0][i], built[lang][-1][0], top[-1][0], found, h))
    return out
