"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text) if text else []


def substring_dedup(rows, window=20):
    """{doc_id: (n_words, n_removed, sha256)} of (doc_id, text) with distinct ids."""
    first, out = {}, {}
    for doc, text in sorted(rows):
        w = words(text)
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            key = tuple(w[s:s + window])
            if first.setdefault(key, (doc, s)) != (doc, s):
                gone[s:s + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[doc] = len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()
    return out


def fingerprint(text, n=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(low)
    shingles = [" ".join(w[i:i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def simhash_components(rows, bits=3):
    """{doc_id: (hex, component)} of (doc_id, text) with distinct ids."""
    fp = {d: fingerprint(t) for d, t in rows}
    values = sorted(set(fp.values()))
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if (a ^ b).bit_count() <= bits:
                parent[root(a)] = root(b)
    least = {}
    for d, v in fp.items():
        least[root(v)] = min(d, least.get(root(v), d))
    return {d: (f"{v:016x}", least[root(v)]) for d, v in fp.items()}


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def url_rule(host, path, rules):
    fits = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda r: len(r[0]), default=(None, None))


def token_rows(rows, tokenizer, end):
    """(doc_id, start, n, crc) in ascending id order."""
    out, start = [], 0
    for doc, text in sorted(rows):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end]
        out.append((doc, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out


def base_rules(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)"""
    w = words(text)
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    often = {}
    for x in windows:
        often[x] = often.get(x, 0) + 1
    covered = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)}
    seen, doubled = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            doubled += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), doubled, len(covered),
            len(w) < 50 or 100 * len(covered) > 50 * len(w))
