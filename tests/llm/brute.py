"""Plain versions of the operators' contracts, for comparison on small tables."""

import hashlib
import re
from collections import Counter, defaultdict

WS = " \t\n\x0b\x0c\r"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def quality(text):
    text = text or ""
    w = words(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(WS):
            dup += line in seen
            seen.add(line)
    n = len(w)
    return {
        "n_words": n,
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": dup,
        "n_repeat_words": len(covered),
        "base_failed": n < 50 or 100 * len(covered) > 50 * n,
    }


def lines(docs, min_docs=10):
    """docs: [(id, text)] -> [(id, n_lines, n_dropped, kept text)]"""
    key = lambda x: ascii_lower(x.strip(WS))
    count = Counter(k for _, t in docs for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for i, t in docs:
        every = (t or "").split("\n")
        stay = [x for x in every if not (key(x) and count[key(x)] >= min_docs)]
        out.append((i, len(every), len(every) - len(stay), "\n".join(stay)))
    return out


def exact(docs):
    groups = defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for i, t in docs:
        groups[norm(t)].append(i)
    keep = {t: min((i for i in v if i is not None), default=None) for t, v in groups.items()}
    return [(i, keep[norm(t)], len(groups[norm(t)]), i == keep[norm(t)], hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in docs]


def shingles(text):
    w = words(ascii_lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near(docs):
    """[(id, n_shingles, component id)]"""
    sets = [shingles(t) for _, t in docs]
    head = list(range(len(docs)))

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    by = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            by[x].append(k)
    for a, s in enumerate(sets):
        for b in {k for x in s for k in by[x] if k < a}:
            both = len(s & sets[b])
            if 100 * both >= 80 * (len(s) + len(sets[b]) - both):
                head[find(a)] = find(b)
    least = defaultdict(lambda: None)
    for k, (i, _) in enumerate(docs):
        r = find(k)
        least[r] = i if least[r] is None else min(least[r], i)
    return [(i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(docs)]


def links(docs):
    """{id: number of other rows linked with it}"""
    sets = [shingles(t) for _, t in docs]
    by = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            by[x].append(k)
    near = lambda s, o: 100 * len(s & o) >= 80 * len(s | o)
    return {i: sum(near(sets[k], sets[b]) for b in {b for x in sets[k] for b in by[x] if b != k}) for k, (i, _) in enumerate(docs)}


def licence_base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    places = {p: [i for i in range(len(w)) if w[i : i + len(p.split())] == p.split()] for p in phrases}
    every = [i for x in places.values() for i in x]
    return len(w), len(every), min(every, default=None), max(every, default=None), ",".join(sorted(phrases[p] for p in places if places[p]))


def licence_notices(text, index, least):
    """(labels, highest score) of the notices, each tried at every place."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))
    found = []
    for x in index:
        for b in range(-len(x["words"]), len(w)):
            right = [0 <= b + j < len(w) and w[b + j] == v for j, v in enumerate(x["words"])]
            if all(right[j] for j in x["places"]):
                score = min(1.0, sum(m for m, ok in zip(x["mass"], right) if ok))
                if score >= least:
                    found.append((x["label"], score))
    return {label for label, _ in found}, max((s for _, s in found), default=0.0)


def url_base(url):
    url = url or ""
    if "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = ascii_lower(host)
    best = None
    for verdict, rule in [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, *(best or (None, None))


def _luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (2 if k % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def private_base(text):
    """[(kind, start, end)] in the order of kinds, then starts."""
    text, out = text or "", []
    digits = lambda m: re.sub("[^0-9]", "", m)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and _luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    for kind, pattern, good in rules:
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if good(m.group())]
    return out
