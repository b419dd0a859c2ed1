"""Plain restatements of what the operators return, for small inputs."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter, defaultdict


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode("utf-8", "surrogatepass") if isinstance(data, str) else data).hexdigest()


def words(text: str | None) -> list[str]:
    return "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in (text or "").lower()).split()


def shingles(text: str | None, n: int = 5) -> Counter:
    w = words(text)
    if len(w) < n:
        return Counter([("short", *w)] if w else [])
    return Counter(zip(*(w[i:] for i in range(n)), strict=False))


def contained(docs, items, threshold: float = 0.8) -> set[tuple]:
    """doc_id, item_id, shingles of the item, shared ones; items of fewer than five words by runs of as many."""
    out = set()
    for item_id, item in items:
        w = words(item)
        k = min(5, len(w))
        wanted = set(zip(*(w[i:] for i in range(k)), strict=False)) if k else set()
        for doc_id, text in docs if wanted else ():
            v = words(text)
            shared = wanted & set(zip(*(v[i:] for i in range(k)), strict=False))
            if len(shared) >= threshold * len(wanted) - 1e-9:
                out.add((doc_id, item_id, len(wanted), len(shared)))
    return out


def classes(docs, threshold: float = 0.8) -> dict:
    """doc_id to the smallest doc_id of its class of near-duplicates."""
    by_text = defaultdict(list)
    for doc_id, text in docs:
        by_text[text or ""].append(doc_id)
    texts = list(by_text)
    sets = [shingles(t) for t in texts]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sizes = [sum(s.values()) for s in sets]
    for i, s in enumerate(sets):
        shared = Counter()
        for x, n in s.items():
            for j in holders[x]:
                if j < i:
                    shared[j] += min(n, sets[j][x])
        for j, k in shared.items():
            if k >= threshold * (sizes[i] + sizes[j] - k) - 1e-12:
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, t in enumerate(texts):
        least[root(i)] += by_text[t]
    return {doc_id: min(least[root(i)]) for i, t in enumerate(texts) for doc_id in by_text[t]}


def removed(docs, size: int = 50) -> dict:
    """doc_id to n_bytes, n_removed, n_spans, kept_sha256; doc_ids differ."""
    seen, out = {}, {}
    for doc_id, text in sorted(docs, key=lambda d: d[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        mine = [data[i : i + size] for i in range(len(data) - size + 1)]
        for i, w in enumerate(mine):
            if w in seen:
                gone[i : i + size] = b"\1" * size
        seen |= dict.fromkeys(mine)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc_id] = (len(data), sum(gone), spans, sha(bytes(b for b, g in zip(data, gone, strict=True) if not g)))
    return out


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def passes_luhn(digits: str) -> bool:
    doubled = [int(d) * (2 if i % 2 else 1) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def pii(text: str | None) -> list[tuple[int, int, str]]:
    text = text or ""
    out = [(m.start(), 0, m.end(), "email") for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end(), "ip") for m in IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int("0" + x.lstrip("0")) <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 12 <= len(digits) <= 19 and passes_luhn(digits):
            out.append((m.start(), 2, m.end(), "card"))
    out += [(m.start(), 3, m.end(), "phone") for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return [(a, b, kind) for a, _, b, kind in sorted(out)]


ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text: str | None) -> list[tuple[int, int, str]]:
    text = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]
    return [(a, b, kind) for a, _, b, kind in sorted(out)]


def listed(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)
