"""Plain-Python statements of what the operators must return, for small inputs."""

import hashlib
import re

KINDS = ("email", "ip", "card", "phone")
BASE = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for k, p in enumerate(BASE):
        for m in re.finditer(p, text or ""):
            d = re.sub(r"[^0-9]", "", m[0])
            ok = (True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 13 <= len(d) <= 19 and luhn(d),
                  9 <= len(d) <= 15)[k]
            if ok:
                out.append((k, m.start(), m.end()))
    return sorted(out)


def shingles(text, k=5):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if x]
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))}


def near(texts, threshold=0.8):
    """Links (pairs of positions) of similarity at least the threshold."""
    sets = [shingles(t) for t in texts]
    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    pairs = {}
    for ids in where.values():
        for a in range(len(ids)):
            for b in ids[a + 1:]:
                pairs[ids[a], b] = pairs.get((ids[a], b), 0) + 1
    return {p for p, n in pairs.items() if n / (len(sets[p[0]]) + len(sets[p[1]]) - n) >= threshold}


def turns_digest(turns):
    h = hashlib.sha256()
    for role, text in turns:
        h.update(f"{role or ''}\n{text or ''}\n".encode())
    return h.hexdigest()


def best_match(pattern, text):
    """Smallest edit distance of the pattern to any substring of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)
