"""Plain Python versions of the operators, for small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash

PROSE = " ".join(f"w{i}" for i in range(120))
OTHER = " ".join(f"v{i}" for i in range(80))

EDGE_TEXTS = [
    (1, PROSE),
    (2, "before it all " + PROSE),
    (3, PROSE),
    (4, None),
    (5, ""),
    (6, " \t\n\x0b "),
    (7, "one"),
    (8, "One two three"),
    (9, "one two three"),
    (10, OTHER + " " + PROSE[:200]),
    (11, "x" * 70_000),
    (12, " ".join(["again"] * 300)),
    (13, "İ K É ß ünder the MIT License. CC BY-NC! Apache License, Version 2.0 \x00 end here"),
    (14, "under the mit license under the mit license, and cc by nc"),
    (15, " ".join(f"long{i}" for i in range(30_000))),
    (16, "you idiot, you 1diot"),
]

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return BLANK.findall(text or "")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def simhash(text):
    ws = words(ascii_lower(text))
    if not ws:
        return 0
    runs = [" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))]
    ones = Counter()
    for run in runs:
        h = xxhash.xxh64_intdigest(run.encode(), 42)
        ones.update(bit for bit in range(64) if h >> bit & 1)
    return sum(1 << bit for bit in range(64) if 2 * ones[bit] > len(runs))


def components(docs):
    """{doc_id: (fingerprint, component_id)} by comparing all pairs of fingerprints."""
    prints = {i: simhash(t) for i, t in docs}
    different = sorted(set(prints.values()))
    root = {p: p for p in different}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for n, a in enumerate(different):
        for b in different[:n]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for i, p in prints.items():
        least[find(p)] = min(i, least.get(find(p), i))
    return {i: (p, least[find(p)]) for i, p in prints.items()}


def removed_words(docs, window=50):
    """[(doc_id, n_words, n_removed, kept line)] in the order of the rows."""
    first = {}
    for i, text in docs:
        ws = words(text)
        for s in range(len(ws) - window + 1):
            key = tuple(ws[s : s + window])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, text in docs:
        ws = words(text)
        gone = set()
        for s in range(len(ws) - window + 1):
            if first[tuple(ws[s : s + window])] < i:
                gone.update(range(s, s + window))
        out.append((i, len(ws), len(gone), " ".join(w for n, w in enumerate(ws) if n not in gone)))
    return out


def targets(sizes, epochs=3):
    """{source: target} by filling, clamping and resharing until none is above its cap."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: n % 3 + 1 for n, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(epochs * sizes[s] for s in capped)
        free = sum(weight[s] for s in order if s not in capped)
        out = {s: epochs * sizes[s] if s in capped else rest * weight[s] / free for s in order}
        above = {s for s in order if s not in capped and out[s] > epochs * sizes[s]}
        if not above:
            return out
        capped |= above


PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


def license_places(text):
    """(n_words, [(place, label)]) of the base phrases."""
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))
    found = []
    for phrase, label in PHRASES:
        parts = phrase.split()
        found += [(n, label) for n in range(len(ws)) if ws[n : n + len(parts)] == parts]
    return len(ws), sorted(found)


def edited_texts(docs):
    """{doc_id: (n_chars, edited text, id of the next)} for different ids."""
    order = sorted(docs, key=lambda d: -d[0])
    out = {}
    for n, (i, text) in enumerate(order):
        j, following = order[(n + 1) % len(order)]
        text, following = text or "", following or ""
        half = len(text) // 2
        out[i] = (len(text), text[: len(text) - half] + following[:half], j)
    return out


def jaccard(a, b, n=5):
    def runs(text):
        ws = words(text)
        return {tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))} if ws else set()

    x, y = runs(a), runs(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def crc_held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def sha(line):
    return hashlib.sha256(line.encode()).hexdigest()


def grouped(rows, key):
    out = defaultdict(list)
    for row in rows:
        out[row[key]].append(row)
    return out


def license_labels(text, templates, gram=3, neighbours=3, coverage=0.6, stretch=2):
    """(labels, largest share) by looking at every template's runs in turn."""
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))
    at = defaultdict(list)
    for n in range(len(ws) - gram + 1):
        at[tuple(ws[n : n + gram])].append(n)
    labels, share, own = set(), 0.0, []
    for number, (phrase, label, base, names) in enumerate(templates):
        parts = phrase.split()
        runs = [tuple(parts[t : t + gram]) for t in range(len(parts) - gram + 1)]
        diagonals = defaultdict(set)
        for t, run in enumerate(runs):
            for n in at.get(run, ()):
                diagonals[n - t].add(t)
        spans, last = [], None
        for d in sorted(diagonals):
            if last is None or d - last > neighbours:
                spans.append([])
            spans[-1].append(d)
            last = d
        for span in spans:
            found = set().union(*[diagonals[d] for d in span])
            places = {d + t for d in span for t in diagonals[d]}
            whole = sum(len(diagonals[d]) == len(runs) for d in span)
            share = max(share, len(found) / len(runs))
            if base:
                labels |= {label} if whole else set()
            elif len(found) >= coverage * len(runs) and set(names) <= found:
                if max(places) - min(places) + gram <= len(parts) * stretch * max(whole, 1):
                    own.append((len(found), -number, label, places))
    for _, _, label, places in own:
        won = sum(max(s for s in own if n in s[3])[2] == label for n in places)
        labels |= {label} if 2 * won >= len(places) else set()
    return labels, share
