"""Plain versions of the operators for small inputs."""

import hashlib
import re
from collections import defaultdict


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingle_set(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    if not words:
        return set()
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))}


def similar(a, b, percent=75):
    if not a or not b:
        return False
    if min(len(a), len(b)) * 100 < max(len(a), len(b)) * percent:
        return False
    same = len(a & b)
    return 100 * same >= percent * (len(a) + len(b) - same)


def components(docs):
    """{doc_id: (set size, component)} of {doc_id: text}."""
    sets = {d: shingle_set(t) for d, t in docs.items()}
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if similar(sets[a], sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def removed_lines(docs, width=5, percent=75):
    """{doc_id: [line numbers]} that an earlier line matches."""
    seen, out = [], defaultdict(list)
    for d in sorted(docs):
        for pos, line in enumerate((docs[d] or "").split("\n")):
            words = line.lower().replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
            words = [w for w in words if w]
            s = {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()
            if any(similar(s, o, percent) for o in seen):
                out[d].append(pos)
            if s:
                seen.append(s)
    return dict(out)


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def contamination(docs, items, window=10):
    """{doc_id: (words, hit words, sorted items)}."""
    windows = defaultdict(set)
    for item, text in items:
        w = item_words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1) if w else ():
            windows[tuple(w[i:i + n])].add(item)
    sizes = {len(w) for w in windows}
    out = {}
    for d, text in docs.items():
        w, hit, found = item_words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (owners := windows.get(tuple(w[i:i + n]))):
                    hit.update(range(i, i + n))
                    found |= owners
        out[d] = (len(w), len(hit), sorted(map(str, found)))
    return out


def sha(text):
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def base_spans(text):
    """[(kind, start, end)] by the stated patterns."""
    def luhn(s):
        t = 0
        for i, c in enumerate(reversed(s)):
            v = int(c)
            if i % 2:
                v = v * 2 if v < 5 else v * 2 - 9
            t += v
        return t % 10 == 0

    kinds, out = ["email", "ip", "card", "phone"], []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.findall("[0-9]", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], kinds.index(s[0])))


def verdict(url):
    """(host, path, rule, verdict by rule or None) by the stated rules."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = lower(re.split("[/?#]", rest, maxsplit=1)[0])
        path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
    best = None
    for says, h, p in [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, says)
    return host, path, best and best[0], best and best[1]
