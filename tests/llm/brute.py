"""Plain Python versions of the operators' results, for small tables."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from html import unescape
from itertools import combinations

import xxhash

ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))


def contamination(docs, items, window=10):
    """doc_id -> (n_words, hit word numbers, items)."""
    windows = defaultdict(set)
    for item, text in items:
        w = words_of(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows[tuple(w[i : i + n])].add(item)
    sizes = {len(k) for k in windows}
    out = []
    for doc, text in docs:
        w = words_of(text)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                own = windows.get(tuple(w[i : i + n]))
                if own:
                    hit.update(range(i, i + n))
                    found |= own
        out.append((doc, len(w), sorted(hit), sorted(str(x) for x in found if x is not None)))
    return out


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, bits=2):
    """Smallest doc_id reachable, by comparing all pairs of distinct fingerprints."""
    by_print = defaultdict(list)
    for doc, fp in prints:
        by_print[fp].append(doc)
    parent = {fp: fp for fp in by_print}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(by_print, 2):
        if (a ^ b).bit_count() <= bits:
            parent[find(a)] = find(b)
    least = {}
    for fp, docs in by_print.items():
        least[find(fp)] = min(least.get(find(fp), docs[0]), *docs)
    return {doc: least[find(fp)] for doc, fp in prints}


def word_runs(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
    return {xxhash.xxh64_intdigest(" ".join(w[i : i + n])) for i in range(max(1, len(w) - n + 1))}


def similar_pairs(docs, least=0.8):
    """Pairs of rows whose sets of word runs have a Jaccard similarity of ``least``, by prefix filtering."""
    sets = [(doc, word_runs(text)) for doc, text in docs]
    often = Counter(h for _, own in sets for h in own)
    first, out = defaultdict(list), []
    for i, (doc, own) in enumerate(sets):
        rare = sorted(own, key=lambda h: (often[h], h))[: len(own) - math.ceil(least * len(own) - 1e-9) + 1]
        for j in {j for h in rare for j in first[h]}:
            other = sets[j][1]
            if min(len(own), len(other)) >= least * max(len(own), len(other)):
                both = len(own & other)
                if both >= least * (len(own) + len(other) - both):
                    out.append((sets[j][0], doc))
        for h in rare:
            first[h].append(i)
    return out


def smallest_reachable(ids, pairs):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in root}


def exact_groups(docs):
    groups = defaultdict(list)
    for doc, text in docs:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc))
    return {doc: (min(own)[1], len(own)) for own in groups.values() for _, doc in own}


def kept_lines(docs, least=10):
    """doc_id -> (n_lines, n_dropped, kept text)."""

    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(ASCII_LOWER)

    holders = defaultdict(set)
    for doc, text in docs:
        for line in (text or "").split("\n"):
            holders[key(line)].add(doc)
    out = {}
    for doc, text in docs:
        own = (text or "").split("\n")
        stay = [x for x in own if len(key(x)) < least or len(holders[key(x)]) < 2 or min(holders[key(x)]) == doc]
        out[doc] = (len(own), len(own) - len(stay), "\n".join(stay))
    return out


_BLOCK_TAG = re.compile(r"</?(?:p|h[1-6]|li|ul|ol|article|div|blockquote|section|header|table|tr|td|pre|figure|figcaption)\b[^>]*>")


def article_text(page):
    """Text of the page's article element by regular expressions; None where there is none."""
    inner = re.search(r"(?s)<article[^>]*>(.*)</article>", page or "")
    if not inner:
        return None
    bare = re.sub(r"(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>", "", inner.group(1))
    parts = _BLOCK_TAG.split(re.sub(r"<br[^>]*>", " ", bare))
    texts = [" ".join(unescape(re.sub(r"<[^>]+>", "", p)).split()) for p in parts]
    return "\n\n".join(t for t in texts if t)


def pieces(docs, tokenizer, length=4096, end=1):
    """(doc_id, piece) -> (start, length, crc32)."""
    out = {}
    for doc, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end]
        for k, at in enumerate(range(0, len(ids), length)):
            part = ids[at : at + length]
            out[doc, k] = (at, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)))
    return out
