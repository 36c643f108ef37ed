"""Brute-force versions that several tests share."""


def brute_lines(docs, min_docs=3, min_chars=20):
    up = {c: c + 32 for c in range(65, 91)}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(up)
    held = {}
    for k, t in docs:
        for x in (t or "").split("\n"):
            held.setdefault(key(x), set()).add(k)
    drop = {x: max(v) for x, v in held.items() if len(x) >= min_chars and len(v) >= min_docs}
    return {k: "\n".join(x for x in (t or "").split("\n") if drop.get(key(x), k) == k) for k, t in docs}


def brute_components(fps):
    comp = list(range(len(fps)))
    while True:
        new = [min(comp[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 2) for i in range(len(fps))]
        if new == comp:
            return comp
        comp = new


def brute_near(docs):
    """Kept doc_ids: the smallest of each component of Jaccard >= 0.8 over five-word shingles."""
    sets = {}
    for k, t in docs:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        sets[k] = {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    comp = {k: k for k in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if comp[a] != comp[b] and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                low, high = sorted((comp[a], comp[b]))
                comp = {k: low if c == high else c for k, c in comp.items()}
    return sorted(set(comp.values()))
