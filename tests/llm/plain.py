"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

SF = "/root/testdata/sf0.001"
BLANK = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ENDS = " \t\n\x0b\f\r"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def blank_words(text):
    return BLANK.findall(text or "")


def alnum_words(text):
    return ALNUM.findall(lower(text))


def shingles(words, n):
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def components(rows, n=3, percent=90):
    """{doc: (set size, smallest connected doc)}; rows of one id are joined."""
    sets = [(d, shingles(blank_words(lower(t)), n)) for d, t in rows if d is not None]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {(d, len(s)): root(d) for d, s in sets}


def contamination(rows, items, window=10):
    spans = defaultdict(set)
    for item, text in items:
        w = alnum_words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            spans[tuple(w[i : i + n])].add(item)
    sizes = {len(s) for s in spans}
    out = []
    for d, text in rows:
        w = alnum_words(text)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if items_of := spans.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= {str(x) for x in items_of}
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def line_key(line):
    return lower(line.strip(ENDS))


def dedup_lines(rows, least_chars=40, least_docs=5):
    docs = defaultdict(set)
    for d, text in rows:
        for line in (text or "").split("\n"):
            if d is not None and len(line_key(line)) >= least_chars:
                docs[line_key(line)].add(d)
    out = []
    for d, text in rows:
        all_lines = (text or "").split("\n")
        kept = [x for x in all_lines if d is None or len(held := docs.get(line_key(x), ())) < least_docs or d == max(held)]
        out.append((d, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return out


def quality(rows, max_docs=20, least_left=0.2):
    """rows: (doc, text, host)."""
    base, held = [], defaultdict(lambda: (set(), []))
    for d, text, host in rows:
        w = blank_words(text)
        lines = [x for x in (text or "").split("\n") if x.strip(ENDS)]
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        count = Counter(grams)
        repeat = {j for i, g in enumerate(grams) if count[g] > 1 for j in (i, i + 1, i + 2)}
        failed = len(w) < 50 or 100 * len(repeat) > 50 * len(w)
        normal = {x.strip(ENDS).lower() for x in lines}
        for x in normal:
            texts, ids = held[host, x]
            texts.add(text)
            if d is not None and not failed:
                ids.append(d)
        base.append((d, host, normal, (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")),
                                       len(lines) - len(set(lines)), len(repeat), failed)))
    out = []
    for d, host, normal, facts in base:
        total = sum(map(len, normal))
        gone = sum(len(x) for x in normal if len((h := held[host, x])[0]) > max_docs and d != min(h[1], default=None))
        out.append((d, *facts, not facts[-1] and total > 0 and 1 - gone / total >= least_left))
    return out
