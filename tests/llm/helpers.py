"""Brute-force versions of the operators, and rows with everything that can be odd about a document."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"
#: Names that the operators use inside; a table may have columns of the same name.
CLASHING = "score kept id key label component_id n_words spans ids _slot _group embedding_".split()
LONG = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna " * 9000


def odd_documents(spark):
    """Null ids, null, empty, blank and very long texts, repeated rows, clashing columns."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog and then it sleeps for a while in the warm sun of May", "en", "src0"),
        (1, "The quick brown fox jumps over the lazy dog and then it sleeps for a while in the warm sun of May", "en", "src0"),
        (2, None, "en", None),
        (3, "", None, "src1"),
        (4, " \n\t ", "de", "src1"),
        (5, "one two", "en", "unknown"),
        (6, "!!! ??? 123", None, "src0"),
        (7, LONG, "la", "src0"),
        (8, LONG, "la", "src2"),
        (None, "The quick brown fox jumps over the lazy dog and then it sleeps for a while in the warm sun of May", "en", "src0"),
        (None, None, None, None),
        (9, "one two", "en", ""),
        (10, "日本語 🙂 é́ <|endoftext|> ▁x", None, "src3"),
    ]
    extra = ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(*r, len(r[1] or ""), *(["x"] * len(CLASHING))) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")


def lower_ascii(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, size=5):
    words = WORD.findall(lower_ascii(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1)))


def components(ids, links):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def near_duplicates(rows, threshold):
    """``{doc_id: (n, component)}`` by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows if i is not None}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    found = components(ids, links)
    return {i: (len(sets[i]), found[i]) for i in ids}


def passages(rows, size=13):
    """``[(doc_id, words, removed flags)]``."""
    cut = [(i, WORD.findall(t or "")) for i, t in rows]
    first = collections.defaultdict(lambda: None)
    for i, words in cut:
        if i is not None:
            for k in range(len(words) - size + 1):
                w = tuple(words[k : k + size])
                first[w] = i if first[w] is None else min(first[w], i)
    out = []
    for i, words in cut:
        gone = [False] * len(words)
        if i is not None:
            for k in range(len(words) - size + 1):
                if first[tuple(words[k : k + size])] < i:
                    gone[k : k + size] = [True] * size
        out.append((i, words, gone))
    return out


def digest(words, gone):
    return hashlib.sha256(" ".join(w for w, g in zip(words, gone, strict=True) if not g).encode()).hexdigest()
